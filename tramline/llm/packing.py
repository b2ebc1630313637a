"""Packing by power-of-two decomposition: every document is cut into pieces of binary length, and equal lengths are bucketed.

A document of n ids gives floor(n / 2048) pieces of 2048 and one piece for each binary digit of the rest, longest first. Each piece is a
sequence by itself, so no sequence crosses documents and none needs padding. Sequences are numbered bucket by bucket, longest first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table

LIMIT = 2048
END_ID = 1
#: Blocks of documents, for numbering; the table of their counts has BLOCKS * 12 rows at most.
BLOCKS = 4096


def byte_ranks(vocab: dict[str, int], merges: list) -> dict[bytes, int] | None:
    """Token bytes -> id, if ids are in the order of the merges, so that the lowest id is always the merge to make; else None."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet shows as themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    order = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    if None in order or order != sorted(set(order)) or len(vocab) != len(merges) + 256 or not all(c in byte for t in vocab for c in t):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


class Encoder:
    """The ids that the tokenizers library gives, as little-endian bytes.

    Where the file is a byte-level BPE whose ids follow its merges, the same ranks run in tiktoken, which gives the same ids several
    times as fast. Texts with characters beyond SURE, where two regular-expression libraries might class a rare character
    differently, or with an added token's string, and all other kinds of file, go to the library itself.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    SURE = r"[^\t\n\r -~\u00a1-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]"

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.loads(self.tokenizer.to_str())
        byte_level = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ranks = byte_ranks(spec["model"]["vocab"], spec["model"]["merges"]) if byte_level and spec["model"]["type"] == "BPE" else None
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = regex.compile("|".join([self.SURE, *added])).search

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_made: dict[str, Encoder] = {}


def encoder_for(file: str) -> Encoder:
    if file not in _made:
        _made[file] = Encoder(file)
    return _made[file]


def decompose(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of n ids, longest first; limit is a power of two."""
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if n % limit >> b & 1]


def cut_documents(df: DataFrame, file: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, ids: bool = True) -> DataFrame:
    """One row per piece: start, length, ids_crc32, doc_tokens and, if wanted, the ids themselves. Null texts count as empty."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder_for(file), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows, starts, lengths, sums, totals, arrays = [], [], [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                raw = memoryview((encode(t) if t else b"") + end)
                n, at = len(raw) // 4, 0
                for m in decompose(n, limit):
                    part = raw[4 * at : 4 * (at + m)]
                    rows.append(row)
                    starts.append(at)
                    lengths.append(m)
                    sums.append(zlib.crc32(part))
                    totals.append(n)
                    if ids:
                        arrays.append(np.frombuffer(part, "<u4").astype("int32"))
                    at += m
            numbers = {k: pa.array(v, pa.int64()) for k, v in (("start", starts), ("length", lengths), ("ids_crc32", sums), ("doc_tokens", totals))}
            yield pa.RecordBatch.from_pydict({key: b.column(0).take(pa.array(rows, pa.int64()))} | numbers | ({"ids": pa.array(arrays, pa.list_(pa.int32()))} if ids else {}))

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids)


def number_sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id, gapless from 0 over all pieces (buckets of long pieces first), and offset, which is 0: a sequence is one piece.

    Ranks are taken within (block of documents, length); blocks come after one another by their counts, a table of bounded size.
    """
    keyed = pieces.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.shiftright("start", 16), "ids_crc32"), F.lit(BLOCKS)))
    counts = keyed.groupBy("length", "block").count()
    before = Window.orderBy(F.desc("length"), "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "block").orderBy(key, "start", "ids_crc32", "doc_tokens")
    # BLOCKS * 12 rows at most
    return keyed.withColumn("rank", F.row_number().over(own)).join(F.broadcast(bases), ["length", "block"]).withColumn("sequence_id", F.col("base") + F.col("rank") - 1).drop("block", "base", "rank").withColumn("offset", F.lit(0).cast("long"))


def pack(df: DataFrame, file: str, ids: bool = False) -> DataFrame:
    from .common import materialize

    small = materialize(cut_documents(df, file, ids=ids), "pieces")  # read twice; encoding is not to run twice
    return number_sequences(small)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
