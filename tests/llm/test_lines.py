import random
from itertools import combinations

from tramline.llm.lines import BLOCK, CODED, LEAST, SHORT, coded, line_classes, may_be_near, near, op3_lines, remove_duplicate_lines


def classes(df):
    return sorted(tuple(r) for r in line_classes(df).drop("body").collect())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, tau=2):
    lines = [(d, i, s.strip()) for d, t in docs for i, s in enumerate((t or "").split("\n")) if s.strip()]
    texts = sorted({s for *_, s in lines})
    root, links = {s: s for s in texts}, dict.fromkeys(texts, 0)

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(texts, 2):
        if min(len(a), len(b)) >= LEAST and abs(len(a) - len(b)) <= tau and edits(a, b) <= tau:
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    first = {}
    for d, i, s in lines:
        first[top(s)] = min(first.get(top(s), (d, i)), (d, i))
    return sorted((d, i, links[s], *first[top(s)], (d, i) == first[top(s)]) for d, i, s in lines)


def mutated(rng, s, n):
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice("abcé")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


def test_against_brute_force(spark):
    rng = random.Random(3)
    docs = []
    base = ["".join(rng.choice("abcd ef") for _ in range(rng.randrange(26, 50))) for _ in range(25)]
    for d in range(60):
        docs.append((d, "\n".join(mutated(rng, rng.choice(base), rng.randrange(5)) for _ in range(4)) + "\nshort\n\n"))
    assert classes(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_bucket_of_several_blocks(spark):
    """Lines that share segments and are two edits apart at most from a common one, more than BLOCK of them."""
    rng = random.Random(4)
    base = "a line that very many documents have with one or two edits in it"
    docs = [(d, mutated(rng, base, rng.randrange(3))) for d in range(3 * BLOCK)]
    got = classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute(docs) and len({r[2] for r in got}) > 5


def test_removal_and_edges(spark):
    line = "this line repeats in more than one document"
    docs = [(1, f"{line}\nfirst own line of some length here", 0, "e"), (2, f"{line}!\nshort\n{line}", 0, "e"), (3, None, 0, "e"), (4, "", 0, "e"), (None, line, 0, "e"), (5, "a line of a document that is in twice", 0, "e"), (5, "a line of a document that is in twice", 0, "e"), (6, "x" * 200_000, 0, "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars int, line string")
    out = sorted(((r["doc_id"] or 0, r["text"]) for r in remove_duplicate_lines(df).collect()), key=str)
    assert len(out) == len(docs)
    assert (1, docs[0][1]) in out and (2, "short") in out and (0, line) in out and (3, None) in out and (4, "") in out and out.count((5, docs[5][1])) == 2
    assert remove_duplicate_lines(spark.createDataFrame([], df.schema)).count() == 0
    assert line_classes(spark.createDataFrame([], df.schema)).count() == 0


def test_rows_of_one_id_keep_their_own_lines(spark):
    """Rows with the same id and different texts lose only what is repeated; columns may have any name."""
    shared = "a line that all three rows of the document have in them"
    docs = [(5, f"own line of the first\n{shared}", "x", "y"), (5, f"{shared}\nown line of the second", "x", "y"), (5, shared, "x", "y"), (6, f"{shared}.", "x", "y")]
    out = remove_duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string, gone string, body string")).collect()
    texts = [t for r in out for t in r["text"].split("\n") if t]
    assert sorted(texts) == sorted(["own line of the first", "own line of the second", shared]) and {(r["gone"], r["body"]) for r in out} == {("x", "y")}


def test_alike_at_both_ends(spark):
    """What two lines begin and end with is left out before they are compared; overlaps and whole words must come right."""
    docs = [(1, "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (2, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (4, "one  two three four five six seven"), (5, "one two three four five six  seven"), (6, "ne two three four five six seven e")]
    assert classes(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_short_lines_are_exact_nodes(spark, tmp_path):
    docs = [(1, "Les.\n\nAll rights reserved."), (2, " Les. \nLes\n"), (3, "All rights reserved.\nAll rights reserved!")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, 0, 0, 1, 0, True), (1, 2, 0, 1, 2, True), (2, 0, 0, 1, 0, False), (2, 1, 0, 2, 1, True), (3, 0, 0, 1, 2, False), (3, 1, 0, 3, 1, True)]
    assert classes(df) == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in op3_lines(spark, str(tmp_path)).collect()) == want
    assert dict(remove_duplicate_lines(df).select("doc_id", "text").collect()) == {1: docs[0][1], 2: "Les\n", 3: "All rights reserved!"}


def test_longer_lines_have_more_room(spark):
    """Links of lines by words, against brute force; in lines of long words one replaced word is more than two edits."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    docs = []
    for n in (12, 19, 20, 21, 39, 40, 41, 59, 60, 61, 62, 90):
        base = [word() for _ in range(n)]
        for k in range(6):
            new = list(base)
            for _ in range(k):
                i = rng.randrange(len(new))
                new[i : i + rng.randrange(2)] = [word()] * rng.randrange(2)
            docs.append((len(docs), " ".join(new)))
    pairs = {(min(x, y), max(x, y)) for x, y in combinations({t for _, t in docs}, 2) if min(3, min(len(x.split(" ")), len(y.split(" "))) // 20) >= edits(x.split(" "), y.split(" ")) or (abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2)}
    want = {d: sum(t in p for p in pairs) for d, t in docs}
    assert sum(want.values()) > 40
    assert {r["doc"]: r["n_links"] for r in line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_letters_of_words_refuse_no_near_pair(spark):
    """The test by letters passes every near pair and refuses most others; parted and joined words, long lines and odd spaces included."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for n in (5, 12, 25, 45, 70):
        for _ in range(12):
            base = [word() for _ in range(n)]
            a, new = " ".join(base), list(base)
            for _ in range(rng.randrange(1, 5)):
                new[rng.randrange(len(new))] = word()
            rows += [(a, " ".join(new)), (a, mutated(rng, a, 2)), (a, a.replace(" ", "", 2)), (a, a.replace(" ", "  ", 1)), (a, " ".join(word() for _ in base))]
    df = spark.createDataFrame(rows, "a string, b string")
    sides = [f"named_struct('line', {c}, 'code', {coded(c)}, 'nw', length({coded(c)}))" for c in "ab"]
    got = df.selectExpr("a", "b", f"{sides[0]} as x", f"{sides[1]} as y").selectExpr("a", "b", f"{may_be_near('x', 'y')} as may", f"{near('x', 'y')} as near").collect()
    for r in got:
        a, b = r["a"].split(), r["b"].split()
        by_words = edits(a, b) <= min(3, min(len(a), len(b)) // 20)
        assert r["near"] == (by_words or (abs(len(r["a"]) - len(r["b"])) <= 2 and edits(r["a"], r["b"]) <= 2))
        assert r["may"] or not r["near"]
    assert sum(r["near"] for r in got) > 50 and sum(not r["may"] for r in got) > 50


def test_edits_far_apart_in_long_lines(spark):
    """What lies between the edits is longer than the built-in distance is used for, and one line has more words than are coded."""
    long, many = "ab" * 400, " ".join(f"w{i}" for i in range(CODED + 50))
    lines = [long, "X" + long[1:-1] + "Y", "X" + long[1:400] + "Z" + long[401:-1] + "Y", many, many.replace("w5 ", "q ").replace("w900 ", "q "), many.replace("w1 ", "q ", 1).replace("w500 ", "q ").replace("w700 ", "q ").replace("w1000 ", "q "), "😀" * 30, "😁" + "😀" * 28 + "😂"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r["n_links"] for r in line_classes(df).orderBy("doc").collect()] == [1, 2, 1, 1, 1, 0, 1, 1]
    assert (SHORT, CODED) == (256, 1024)
