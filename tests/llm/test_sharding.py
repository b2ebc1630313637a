import zlib
from collections import Counter

from tramline.llm.sharding import op5_sharding, shard_rows

SF = "/root/testdata/sf0.001"


def check(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    check(rows, 40)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_edges(spark):
    kind = "doc_id long, text string, size string"
    rows = shard_rows(spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, None, None), (None, "b", None), (2, "é" * 100_000, "y")] * 5, kind), shards=4).collect()
    assert len(rows) == 25
    check(rows, 4)
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {200_016}
    assert shard_rows(spark.createDataFrame([], kind)).count() == 0


def test_more_shards_move_little(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'t' text")
    a, b = ({r["doc_id"]: r["shard"] for r in shard_rows(df, shards=n).collect()} for n in (20, 21))
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)
