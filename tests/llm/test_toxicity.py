import math
import os
import random
import tracemalloc
import zlib
from itertools import combinations

import numpy as np

from tramline.llm import toxicity
from tramline.llm.toxicity import BUCKETS, Model, features, fit, held_out, op2_toxicity, score_documents, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    rows = op2_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    print(f"held out: {sum(toxic)} of {len(toxic)} toxic, {sum(clean)} of {len(clean)} clean called toxic")
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_pair_beyond_its_parts():
    """Toxic only where both words meet."""
    texts, y = [], []
    for i in range(240):
        a, b = i % 2, i // 2 % 2
        texts.append(f"{'zzq ' * a}{'wwx ' * b}filler{i % 7} text")
        y.append(int(a and b))
    model = fit([features(t) for t in texts], y)
    assert [model.score(features(t)) >= 0.5 for t in ("zzq wwx filler1 text", "zzq filler1 text", "wwx filler1 text", "filler1 text")] == [True, False, False, False]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b", 9), (3, "word " * 100_000, 9), (3, "word", 9)], "doc_id long, text string, score int")
    model = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert isinstance(model, Model)
    out = score_documents(docs, model).collect()
    assert len(out) == 5 and {r["predicted"] for r in out} == {0}
    assert score_documents(spark.createDataFrame([], docs.schema), model).count() == 0


def test_pairs_carry_part_of_the_score(spark):
    """On held-out labels the model without its factors finds fewer toxic texts; its score is the sum over all pairs, taken one by one."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = train(documents, labels)
    flat = Model(model.w0, model.index, model.w, model.v * 0)
    rows = documents.join(labels.where("toxic is not null").where(held_out()), "doc_id").select("text", "toxic").collect()
    found = [(features(r["text"]), r["toxic"]) for r in rows]
    hits = lambda m: sum(m.score(x) >= 0.5 for x, y in found if y)
    assert (model.v != 0).any() and hits(model) > hits(flat)
    place = {int(b): k for k, b in enumerate(model.index)}
    for x, _ in found[:200]:
        held = [place[int(b)] for b in x if int(b) in place]
        z = model.w0 + sum(model.w[i] for i in held) + sum(float(model.v[i] @ model.v[j]) for i, j in combinations(held, 2))
        assert abs(model.score(x) - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_neutral_words_stay_for_their_pairs():
    """An insult is toxic only beside a group's name that is as common in clean texts; thousands of other words are told apart by chance."""
    rng, texts, y = random.Random(2), [], []
    for i in range(900):
        insult, group = i % 3 == 0, i % 2 == 0
        texts.append(" ".join([f"q{rng.randrange(20_000)}q" for _ in range(25)] + ["zzqxx"] * insult + ["wwxyy"] * group))
        y.append(int(insult and group))
    model = fit([features(t) for t in texts[:700]], y[:700])
    right = [(model.score(features(t)) >= 0.5) == bool(v) for t, v in zip(texts[700:], y[700:], strict=True)]
    assert sum(right) >= 0.95 * len(right)


def test_training_takes_little_memory_beside_its_terms():
    """The driver holds all terms of the sample at once; what fit() takes beside them is bounded."""
    draw = np.random.default_rng(1)
    found = [np.unique(draw.zipf(1.3, 1200) % BUCKETS).astype(np.int32) for _ in range(3000)]
    labels = (np.arange(3000) % 7 == 0).astype(int)
    tracemalloc.start()
    fit(found, labels, rounds=2)
    most = tracemalloc.get_traced_memory()[1] / sum(map(len, found))
    tracemalloc.stop()
    assert most < 36  # bytes a term


def test_training_is_not_in_the_driver(spark, monkeypatch):
    """The driver gets the model only; it is the one that fits the same rows here."""
    texts = [f"{'zzq ' * (i % 3 == 0)}filler{i % 7} text{i % 11}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in labels.where(~held_out()).selectExpr("doc_id", "xxhash64(doc_id) as x").orderBy("x").collect()]
    want, driver = fit([features(texts[i]) for i in order], np.array([int(i % 3 == 0) for i in order])), os.getpid()

    def in_a_task(found, toxic):
        assert os.getpid() != driver
        return fit(found, toxic)

    monkeypatch.setattr(toxicity, "fit", in_a_task)
    got = train(docs, labels)
    assert len(got.index) and got.w0 == want.w0 and all((getattr(got, k) == getattr(want, k)).all() for k in ("index", "w", "v"))
