import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tramline.llm.packing import op10_packing, pack

FILE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def check(rows, texts):
    t = Tokenizer.from_file(FILE)
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert sorted(of) == sorted(texts)
    for k, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(of[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 for r in rows)


def test_documents(spark):
    check(op10_packing(spark, SF).collect(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def test_edges(spark):
    texts = {1: None, 2: "", 3: "a b " * 30_000, 4: "naïve 漢字 🙂 ​ ½ ² ٣\x00\x1c\x85", 5: "x<|endoftext|>y", 6: "Ünï \t\n  it's  "}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, start int")
    check(pack(df, FILE).collect(), texts)
    assert pack(spark.createDataFrame([], df.schema), FILE).count() == 0
    twice = pack(df.unionByName(df), FILE).collect()
    assert sorted(r["sequence_id"] for r in twice) == list(range(len(twice)))
