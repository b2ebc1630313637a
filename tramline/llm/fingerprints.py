"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases: each is the shortest string from here on that is not a phrase yet. The set of phrases
says how the text compresses; two texts whose sets overlap compress alike. Phrases are hashed and the SIGNATURE smallest hashes are
kept, and the Jaccard similarity of two phrase sets is estimated from the smallest hashes of their union. Equal texts have equal
fingerprints. A text with fewer phrases keeps all hashes, so the estimate is then exact; two empty texts are alike (1), an empty and
another text are not (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Hashes kept, of 32 bits each.
SIGNATURE = 128

def parse(text: str, phrases: set[str], start: int, at: int, end: int) -> tuple[int, int]:
    """Goes on parsing text[:end] with the phrase from start tried up to at; returns where to go on, as (start, at)."""
    add = phrases.add
    while at <= end:
        phrase = text[start:at]
        if phrase in phrases:
            at += 1
        else:
            add(phrase)
            start = at
            at += 1
    return start, at


def sketch(phrases: set[str]) -> np.ndarray:
    """The smallest hashes of the phrases, ascending."""
    digest = xxhash.xxh32_intdigest
    hashes = np.unique(np.fromiter((digest(p.encode("utf-8", "replace")) for p in phrases), np.uint32, len(phrases)))
    return hashes[:SIGNATURE]


def text_of(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets behind two sketches."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:SIGNATURE]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def fingerprint_text(text: str | None) -> np.ndarray:
    phrases: set[str] = set()
    body = text or ""
    parse(body, phrases, 0, 1, len(body))
    return sketch(phrases)


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint (hex of the kept hashes, ascending) of every row; a null text counts as empty."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({key: b.column(0), "fingerprint": pa.array([text_of(fingerprint_text(t)) for t in b.column(1).to_pylist()], pa.string())})

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fingerprint string")


class _Open:
    """A document whose edited text waits for the next document."""

    def __init__(self, key: object, text: str):
        self.key, self.text = key, text
        self.half = len(text) // 2
        self.keep = len(text) - self.half
        phrases: set[str] = set()
        self.start, self.at = parse(text, phrases, 0, 1, self.keep)
        self.common = set(phrases)  # the first half is parsed once for both texts
        parse(text, phrases, self.start, self.at, len(text))
        self.found = sketch(phrases)

    def close(self, after: str, after_found: np.ndarray) -> tuple:
        edited = self.text[: self.keep] + after[: self.half]
        parse(edited, self.common, self.start, self.at, len(edited))
        found = sketch(self.common)
        sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        return self.key, len(self.text), sha, text_of(self.found), text_of(found), likeness(self.found, found), likeness(self.found, after_found)


def in_order(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (range, own, key, text) in which each row's successor by ascending key follows it within its range.

    Ranges follow approximate quantiles of the key. The first row of each range also follows the last row of the range before it, and
    the very first row follows the very last, as a row that is not its own. Each text moves once. Only the bounds and the smallest key
    of each range, two numbers for a partition, reach the driver. Nulls come first; equal keys are ordered by text.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("o"), F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    bounds = sorted(set(keyed.select("o").approxQuantile("o", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    array = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>") if bounds else F.array().cast("array<double>")
    number = F.size(F.filter(array, lambda b: b <= F.col("o").cast("double")))
    firsts = sorted((r["range"], r["o"]) for r in keyed.select("o", number.alias("range")).groupBy("range").agg(F.min("o").alias("o")).collect())
    before = {o: firsts[i - 1][0] for i, (_, o) in enumerate(firsts)}  # the range before, for the smallest key of each
    follows = F.lit(None).cast("int") if not before else F.coalesce(*[F.when(F.col("o") == o, F.lit(r)) for o, r in before.items()]) if len(before) <= 64 else F.element_at(F.from_json(F.lit("{" + ",".join(f'"{o}":{r}' for o, r in before.items()) + "}"), "map<string,int>"), F.col("o").cast("string"))
    places = F.array(F.struct(number.alias("range"), F.lit(True).alias("own")), F.when(F.lit(bool(before)), F.struct(follows.alias("range"), F.lit(False).alias("own"))))
    dealt = keyed.withColumn("at", F.explode(F.filter(places, lambda p: p["range"].isNotNull()))).select("at.range", "at.own", "o", key, text)
    # ranges have different numbers, so none of them shares a task with another, as it would by their hashes
    return dealt.repartitionByRange(ranges, "range").sortWithinPartitions("range", F.desc("own"), "o", text)


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its fingerprint, that of its edited text (the last half replaced by the start of the next row's text), and how
    alike both, and the row and the next, are. A null text counts as empty; a single row is its own successor."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: _Open | None = None
        open_range = None
        for b in batches:
            rows = []
            for r, own, k, t in zip(*(b.column(c).to_pylist() for c in ("range", "own", key, text)), strict=True):
                if r != open_range:
                    open_row, open_range = None, r
                if not own:
                    if open_row is not None:
                        rows.append(open_row.close(t, fingerprint_text(t)))
                        open_row = None
                    continue
                new = _Open(k, t)
                if open_row is not None:
                    rows.append(open_row.close(t, new.found))
                open_row = new
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (b.schema.field(key).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = (key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    kind = df.schema[key].dataType.simpleString()
    return in_order(df, key, text).drop("o").mapInArrow(run, f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
