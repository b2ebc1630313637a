"""The stages in a row, each against a plain version that works on what the stage before it kept."""

import random
from itertools import combinations

import public_tokenizers
from test_lines import brute as classes_of_lines
from tokenizers import Tokenizer

import corpus_pipeline
from tramline.llm.nearcopies import document_frequencies, feature_weights, similarity, weighted
from tramline.llm.toxicity import features, train


def tables(spark, path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(5, 12)))
    shared = [line() for _ in range(6)]
    texts = []
    for i in range(70):
        lines = [line() for _ in range(rng.randrange(3, 9))]
        if i % 4 == 0:
            lines.append(rng.choice(shared) + rng.choice(["", "x", "yz"]))
        if i % 5 == 0:
            lines[0] += " zzqxx wwxyy"
        texts.append("\n".join(lines))
    long = [word() for _ in range(120)]
    broken = lambda n: "\n".join(" ".join(long[i : i + n]) for i in range(0, 120, n))
    # the same words in other lines are near copies that no line gives away
    texts += [broken(9), broken(13).replace(long[60], "other", 1), "", "short\nshort"]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)] + [(80, None, None, None, 0), (81, "", "en", "web", 0), (5, texts[5], "en", "web", len(texts[5]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = lambda df: sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect()), key=str)

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/out-{name}")
        out[name], before = spark.read.parquet(f"{path}/out-{name}"), docs
        assert name == "packing" or out[name].columns == before.columns
        docs = out[name]

    first = spark.read.parquet(f"{path}/documents.parquet")
    model = train(first, spark.read.parquet(f"{path}/labels.parquet"))
    clean = [r for r in kept(first) if model.score(features(r[1])) < 0.5]
    assert kept(out["toxicity"]) == clean and 5 < len(first.collect()) - len(clean) < 30

    lines = classes_of_lines(sorted({(d, t) for d, t, _ in clean}, key=str))
    gone = {(d, i) for d, i, *_, keep in lines if not keep}
    cut = []
    for d, t, n in clean:
        new = t if t is None or not any(x == d for x, _ in gone) else "\n".join(s for i, s in enumerate(t.split("\n")) if (d, i) not in gone)
        cut.append((d, new, n if new is t else len(new)))
    assert kept(out["line_dedup"]) == sorted(cut, key=str) and len(gone) > 5

    weights = feature_weights(*document_frequencies(out["line_dedup"]))
    rows = sorted({(d, t or "") for d, t, _ in cut})
    sets = {d: weighted(t, weights) for d, t in rows}
    label = {d: d for d, _ in rows}
    texts = dict(rows)
    for a, b in combinations(sorted(sets), 2):
        if texts[a] == texts[b] or (len(sets[a][0]) and similarity(sets[a], sets[b]) >= 0.8):
            low, high = sorted((label[a], label[b]))
            label = {d: low if v == high else v for d, v in label.items()}
    single = sorted({r for r in cut if label[r[0]] == r[0]}, key=str)
    assert kept(out["near_dedup"]) == single and len(single) < len(cut)

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = out["packing"].collect()
    for d, t, _ in single:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == d)
        assert sum(m[1] for m in mine) == n and all(m[2] == n for m in mine) and [m[0] for m in mine] == [sum(x[1] for x in mine[:k]) for k in range(len(mine))]
        assert all(m[1] & (m[1] - 1) == 0 for m in mine)
    assert {r["doc_id"] for r in pieces} == {d for d, *_ in single} and sorted(r["sequence_id"] for r in pieces) == list(range(len(pieces)))
    assert corpus_pipeline.run(spark, path).count() == len(pieces)
