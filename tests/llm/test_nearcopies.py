import random
from itertools import combinations

import numpy as np

from tramline.llm.nearcopies import BANDS, BLOCK, ROWS, Sampler, _mix, document_frequencies, every_shingle, feature_weights, merge_bucket, near_duplicates, op8_nearcopies, shingles, similarity, weighted

SF = "/root/testdata/sf0.001"


def brute(spark, df):
    weights = feature_weights(*document_frequencies(df))
    rows = [(r["doc_id"], weighted(r["text"], weights)) for r in df.collect()]
    root = {k: k for k, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    margin = []
    for (a, x), (b, y) in combinations(rows, 2):
        s = similarity(x, y)
        if s >= 0.8:
            margin.append(s)
            u, v = sorted((top(a), top(b)))
            root[v] = u
    return {k: top(k) for k in root}


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute(spark, df)
    got = {r["doc_id"]: r for r in op8_nearcopies(spark, SF).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["class_id"]) for k, r in got.items())
    assert len(set(want.values())) < len(want)


def test_edges(spark):
    kind = "doc_id long, text string, class_id string"
    words = " ".join(f"w{i}" for i in range(300))
    data = [(5, words, ""), (3, words + " tail", ""), (3, words + " tail", ""), (4, None, ""), (6, "", ""), (7, "one two", ""), (8, "One, two!", ""), (9, words.replace("w1", "v1"), ""), (None, words, ""), (None, "lonely text here", ""), (11, "w " * 60_000, "")]
    got = near_duplicates(spark.createDataFrame(data, kind)).collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by == {5: 3, 3: 3, 4: 4, 6: 4, 7: 7, 8: 7, 9: 9, 11: 11}
    assert near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_large_group_of_copies(spark):
    words = [f"w{i}" for i in range(120)]
    data = [(i, " ".join(words[:60] + [f"x{i}"] + words[60:])) for i in range(200)]
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_groups_over_blocks(spark):
    """Copies of one text with edits of their own, so that many are alike through others only; against brute force over all pairs."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(100)]
    data = []
    for i in range(3 * BLOCK):
        own = list(words)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(100)] = f"x{rng.randrange(10_000)}"
        data.append((i, " ".join(own)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    want = brute(spark, df)
    assert all(want[k] == want[c] for k, c in got.items())  # nothing is joined that is not alike
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def test_bucket_against_all_pairs():
    """Mergers inside of one bucket give the components of all its near pairs, whole or in blocks."""
    rng = np.random.default_rng(3)
    found = []
    for _ in range(60):
        base = rng.integers(4)
        keep = rng.random(40) > 0.12
        ids = np.arange(40)[keep].astype(np.uint64) + np.uint64(100 * base)
        found.append((ids, np.ones(len(ids))))
    n = len(found)
    bands = np.arange(n * 2).reshape(n, 2)
    own = np.arange(n) // 20

    def roots(edges):
        root = list(range(n))
        for i, j in edges:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return [root.index(r) for r in root]

    every = [(i, j) for i, j in combinations(range(n), 2) if similarity(found[i], found[j]) >= 0.8]
    ranks = np.arange(n) + 2
    assert roots(merge_bucket(found, np.arange(n), bands, 1, ranks, own, False, 0.8)) == roots(every)
    parts = []
    for lo in range(3):
        for hi in range(lo, 3):
            at = np.flatnonzero((own == lo) | (own == hi))
            parts += [(at[i], at[j]) for i, j in merge_bucket([found[k] for k in at], at, bands[at], 1, ranks[at], own[at], lo != hi, 0.8)]
    assert roots(parts) == roots(every) and len(every) > 100


def test_samples_by_the_plain_formula():
    """Arrays that are used again for all hashes draw what each hash by itself draws; ties take the first shingle of a document."""
    sampler, rng = Sampler(), np.random.default_rng(5)
    found, starts = rng.integers(1 << 63, size=400).astype(np.uint64), np.array([0, 1, 50, 399])
    found[60:70] = found[50:60]
    ln = np.log(weight := rng.random(400) * 3 + 0.1).astype(np.float32)
    got, mult = sampler.bands(found, weight, starts), np.uint64(0x9E3779B97F4A7C15)
    for d, (low, high) in enumerate(zip(starts, [*starts[1:], 400], strict=True)):
        want = np.zeros(BANDS, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                at = ((found[low:high] * sampler.odd[k]) >> np.uint64(48)).astype(int)
                t = np.floor(ln[low:high] * sampler.inv[at] + sampler.beta[at])
                i = np.argmin(sampler.lnc[at] - sampler.r[at] * (t - sampler.beta[at]))
                sample = _mix(found[low + i : low + i + 1] + t[i : i + 1].astype(np.int64).astype(np.uint64) * mult)
                want[k // ROWS] = _mix(want[k // ROWS : k // ROWS + 1] * mult + sample)[0]
        assert (got[d] == want).all()


def test_repeated_shingles_count_once_a_document(spark):
    text = "one two three four five " * 4
    assert len(every_shingle(text)) == 16 and len(shingles(text)[0]) == 5
    counts, rows = document_frequencies(spark.createDataFrame([(text,), (text,), (None,)], "text string"))
    assert rows == 3 and counts.sum() == 10 and counts.max() == 2
