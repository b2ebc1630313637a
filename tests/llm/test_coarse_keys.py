import random

from pyspark.sql import functions as F

from tramline.llm import lines as module
from tramline.llm.lines import LEAST, MOST_WORDS, WORDS_AN_EDIT, coarse_keys, line_classes, parted


def keys(spark, texts):
    rows = spark.createDataFrame(sorted(enumerate(texts)), "h long, line string")
    return {r["h"]: set(r["k"]) for r in coarse_keys(parted(rows)).groupBy("h").agg(F.collect_list("k").alias("k")).collect()}


def test_near_lines_share_a_coarse_key(spark):
    """Two edits at all places, at the bounds of all steps: of characters, spaces among them, and of words, as many as a line may have."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 1, 3, 6])))
    pairs = []

    def add(x, y):
        x, y = x.strip(), y.strip()
        if min(len(x), len(y)) >= LEAST and x != y:
            pairs.append((x, y))

    def edited(x, places):
        for i in sorted(places, reverse=True):
            c = rng.choice(["Z", " "])
            x = rng.choice([x[:i] + c + x[i:], x[:i] + x[i + 1 :], x[:i] + c + x[i + 1 :]])
        return x

    for n in range(LEAST, LEAST + 20):
        x = "".join(rng.choice("abcdefghé") for _ in range(n))
        for i in range(n):
            add(x, edited(x, [i, rng.randrange(n)]))
            add(x, edited(x, [i, n - 1 - rng.randrange(n // 3)]))
    for n in range(WORDS_AN_EDIT - 3, WORDS_AN_EDIT * MOST_WORDS + 20):
        for _ in range(12):
            base = [word() for _ in range(n)]
            x = rng.choice([" ", " ", "  "]).join(base)
            spaces = [i for i, c in enumerate(x) if c == " "]
            for of in (range(len(x)), spaces):
                add(x, edited(x, rng.sample(of, 2)))
                add(x, edited(x, [rng.choice(of[: len(of) // 3]), rng.choice(of[-len(of) // 3 :])]))
            places = [rng.randrange(n // 3), n - 1 - rng.randrange(n // 3), rng.randrange(n)]
            rng.shuffle(places)
            new = list(base)
            for i in places[: min(MOST_WORDS, (n - 3) // WORDS_AN_EDIT)]:
                i = min(i, len(new) - 1)
                new[i : i + rng.randrange(2)] = rng.choice([[], ["Z" + word()]])
            if len(new) >= WORDS_AN_EDIT:
                add(x, " ".join(new))
    of = keys(spark, [t for p in pairs for t in p])
    assert len(pairs) > 3000 and [p for i, p in enumerate(pairs) if not of[2 * i] & of[2 * i + 1]] == []


def test_keys_of_all_places_are_made_for_few_lines(spark, monkeypatch):
    """Lines that are near no other have coarse keys only, few of them; near lines are linked as before."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    alone = [" ".join(word() for _ in range(rng.randrange(5, 90))) for _ in range(300)]
    near = [alone[0], alone[0] + "s", alone[1], "x" + alone[1][:-1]]
    made = []
    real = module.line_keys
    monkeypatch.setattr(module, "line_keys", lambda lines, tau: made.append(lines.count()) or real(lines, tau))
    got = line_classes(spark.createDataFrame(list(enumerate(alone + near)), "doc_id long, text string")).collect()
    assert {r["doc"] for r in got if r["n_links"]} == {0, 1, 300, 301, 302, 303} and len(got) == 304
    assert made == [4]
    assert sum(map(len, keys(spark, alone).values())) < 7 * len(alone)
