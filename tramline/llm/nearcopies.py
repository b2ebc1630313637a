"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles (lower-cased runs of letters and digits); one of fewer words is one shingle. A
shingle weighs its count times a damped inverse document frequency, ln(1 + documents / document frequency) ** DAMPING. Document
frequencies are counted over the whole corpus in FEATURES hashed features, a table of fixed size whatever the corpus: a feature's
background is a constant share of all documents, so weights behave alike at every size. The damping keeps common shingles lighter
without letting a few rare edits outweigh a text that many documents share.

Improved consistent weighted sampling draws HASHES samples (shingle, quantised weight) from each document such that two documents draw
the same one with a probability of their weighted Jaccard similarity. Samples form BANDS bands of ROWS; documents that share a band are
candidates. At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**12 = 0.998, at 0.85 with 0.9999.

Candidates are verified by exact weighted Jaccard similarity. First each bucket's first document is verified against all its others, one
pair a member. Buckets whose members are still in different classes are then compared inside of one task, in blocks of BLOCK members
against each other if they are larger: pairs that are connected already, or that an earlier band has put into one bucket too, are passed
over, all others are verified, and only one edge for each merger of two classes goes on. So every candidate pair is verified or already
connected, without emitting the pairs of a group of copies. Equal texts are one node throughout; texts are told apart by 64 bits of a hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, materialize, small_batches, table

WORDS = 5
THRESHOLD = 0.8
FEATURES = 1 << 20
SLICES = 16
DAMPING = 0.25
BANDS = 12
ROWS = 4
HASHES = BANDS * ROWS
#: Rows of the table of random draws; each (shingle, hash) takes one of them.
DRAWS = 1 << 16
#: Shingles that are sampled at a time.
CHUNK = 40_000
#: Shingles of texts that verification holds at a time, besides the newest text's.
HELD = 500_000
#: Parts of a bucket that are ranked one by one.
PARTS = 64
#: Members of a bucket that one task compares with as many others.
BLOCK = 128
#: Entries of each worker's caches; they are emptied when full.
CACHE = 150_000

_words = re.compile(r"[^\W_]+").findall
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return got


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def every_shingle(text: str | None) -> np.ndarray:
    """Shingle hashes in the order of the text, repeated ones too."""
    words = _words((text or "").lower())
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_hashes.__getitem__, words), _U, len(words))
    n = max(1, len(h) - WORDS + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, len(words) if len(words) < WORDS else WORDS, _U)
        for k in range(min(WORDS, len(h))):
            s = _mix(s * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return s


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    return np.unique(every_shingle(text), return_counts=True)


def feature(found: np.ndarray) -> np.ndarray:
    return (found >> _U(44)).astype(np.int64)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """For each feature the number of documents that hold a shingle of it, over all rows, and the number of rows.

    Each task counts its rows in one table and sends its slices; the driver gets SLICES arrays of FEATURES / SLICES counts.
    """
    small_batches(df.sparkSession)
    width = FEATURES // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros(FEATURES, np.int32), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                table[feature(every_shingle(t))] += 1  # an index that repeats counts once
            rows += b.num_rows
        if rows:
            parts = [zlib.compress(table[i * width : (i + 1) * width].tobytes(), 1) for i in range(SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "rows": pa.array([rows] * SLICES, pa.int64()), "counts": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for s, n, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                got = sums.setdefault(s, [0, np.zeros(width, np.int64)])
                got[0] += n
                got[1] += np.frombuffer(zlib.decompress(c), np.int32)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "rows": pa.array([n for n, _ in sums.values()], pa.int64()), "counts": pa.array([c.tobytes() for _, c in sums.values()], pa.binary())})

    schema = "slice int, rows long, counts binary"
    got = df.select(text).mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    out = np.zeros(FEATURES, np.int64)
    for r in got:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out, got[0]["rows"] if got else 0


def feature_weights(counts: np.ndarray, rows: int) -> np.ndarray:
    return (np.log1p(max(rows, 1) / np.maximum(counts, 1)) ** DAMPING).astype(np.float32)


def weighted(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, times = shingles(text)
    return found, times * weights[feature(found)].astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; two documents without words are alike."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Sampler:
    """Draws r and c (Gamma(2, 1)) and beta (uniform) for a (shingle, hash) from one table of DRAWS rows, seeded."""

    def __init__(self) -> None:
        rng = np.random.default_rng(8)
        self.r = rng.gamma(2.0, 1.0, DRAWS).astype(np.float32)
        self.inv = (1 / self.r).astype(np.float32)
        self.lnc = np.log(rng.gamma(2.0, 1.0, DRAWS)).astype(np.float32) - self.r
        self.beta = rng.random(DRAWS).astype(np.float32)
        self.odd = rng.integers(1 << 62, size=HASHES).astype(_U) * _U(2) + _U(1)

    def bands(self, found: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band hashes, one row for each document; starts: where each document's shingles begin. No document is empty."""
        n, ln, out = len(found), np.log(weight).astype(np.float32), np.zeros((len(starts), BANDS), _U)
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
        # one set of arrays for all hashes: to allocate them anew takes longer than the sums
        u, least, (t, beta, r, a, low) = np.empty(n, _U), np.empty(n, bool), np.empty((5, n), np.float32)
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                np.right_shift(np.multiply(found, self.odd[k], out=u), _U(48), out=u)
                at = u.view(np.int64)
                for table, into in ((self.inv, t), (self.beta, beta), (self.r, r), (self.lnc, a)):
                    np.take(table, at, out=into, mode="clip")
                np.floor(np.add(np.multiply(ln, t, out=t), beta, out=t), out=t)
                # a = lnc - r * (t - beta)
                np.subtract(a, np.multiply(r, np.subtract(t, beta, out=beta), out=r), out=a)
                np.take(np.minimum.reduceat(a, starts), of, out=low, mode="clip")
                hit = np.flatnonzero(np.equal(a, low, out=least))
                first = hit if len(hit) == len(starts) else hit[np.searchsorted(hit, starts)]
                sample = _mix(found[first] + t[first].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15))
                out[:, k // ROWS] = _mix(out[:, k // ROWS] * _U(0x9E3779B97F4A7C15) + sample)
        return out


def band_rows(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, bands) of every row; node is a hash of the text. Documents without words have no bands."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)  # FEATURES numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for b in batches:
            done: list[list[int]] = []
            wait: list[tuple[np.ndarray, np.ndarray]] = []

            def flush() -> None:
                some = [w for w in wait if len(w[0])]
                if some:
                    starts = np.cumsum([0, *(len(w[0]) for w in some[:-1])])
                    got = iter(sampler.bands(np.concatenate([w[0] for w in some]), np.concatenate([w[1] for w in some]), starts).view(np.int64).tolist())  # noqa: B023
                done.extend(next(got) if len(w[0]) else [] for w in wait)  # noqa: B023
                wait.clear()  # noqa: B023

            size = 0
            for t in b.column(2).to_pylist():
                wait.append(weighted(t, shared.value))
                size += len(wait[-1][0])
                if size > CHUNK:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_pydict({key: b.column(0), "node": b.column(1), "bands": pa.array(done, pa.list_(pa.int64()))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.xxhash64(text).alias("node"), text).mapInArrow(run, f"{key} {kind}, node long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def of(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            if node not in held:
                if size > HELD:
                    held.clear()
                    size = 0
                held[node] = weighted(text, shared.value)
                size += len(held[node][0]) + 100
            return held[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            good = [similarity(of(w, y), of(x, z)) >= threshold for w, x, y, z in zip(a, b, ta, tb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def merge_bucket(found: list[tuple[np.ndarray, np.ndarray]], component: np.ndarray, bands: np.ndarray, band: int, rank: np.ndarray, own: np.ndarray, cross: bool, threshold: float) -> list[tuple[int, int]]:
    """Places (i, j) of verified pairs that merge the components of a bucket's members; pairs met in an earlier band are passed over.

    found: weighted shingles of each member. cross: only pairs of different blocks are compared.
    """
    label, out = np.unique(component, return_inverse=True)[1], []
    total = np.array([w.sum() for _, w in found])
    for i in range(len(found)):
        if rank[i] == 1:
            continue  # verified against all members before
        able = label != label[i]
        able[: i + 1] = False
        able &= rank != 1
        if cross:
            able &= own != own[i]
        able &= ~(bands[:, :band] == bands[i, :band]).any(1)
        able &= np.minimum(total, total[i]) >= threshold * np.maximum(total, total[i])  # an upper bound of the similarity
        while able.any():
            j = int(np.argmax(able))
            able[j] = False
            if similarity(found[i], found[j]) >= threshold:
                out.append((i, j))
                label[label == label[j]] = label[i]
                able &= label != label[i]
    return out


def bucket_links(rooms: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """(a, b): pairs that connect what the rows of one (band, hash, lo, hi) have alike; rows (node, rank, component, own, bands, text)."""
    shared = rooms.sparkSession.sparkContext.broadcast(weights)

    def run(group: pa.Table) -> pa.Table:
        t = group.sort_by("rank").combine_chunks()
        node, rank, component, own = (t.column(c).to_numpy() for c in ("node", "rank", "component", "own"))
        pairs: list[tuple[int, int]] = []
        if (component != component[0]).any():
            found = [weighted(x, shared.value) for x in t.column("text").to_pylist()]
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            cross = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
            pairs = merge_bucket(found, component, bands, t.column("band")[0].as_py(), rank, own, cross, threshold)
        at = np.array(pairs, int).reshape(-1, 2)
        return pa.table({"a": pa.array(node[at[:, 0]], pa.int64()), "b": pa.array(node[at[:, 1]], pa.int64())})

    return rooms.groupBy("band", "hash", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, node, class_id, kept) of every row: class_id is the smallest key of the row's class, kept marks that key.

    A null text counts as empty; texts without words are alike only if equal. Rows of a class whose keys are all null have a null
    class_id and are not kept. Repeated rows are kept alike. Other columns are dropped. An empty table gives no rows.
    """
    body = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts, n = document_frequencies(body)
    weights = feature_weights(counts, n)
    rows = materialize(band_rows(body, weights, key), "bands")
    nodes = rows.groupBy("node").agg(F.min(key).alias("first"), F.first("bands").alias("bands"))
    places = nodes.select("node", "first", F.posexplode("bands").alias("band", "hash"))
    # ranks are given inside of parts of a bucket, which come after one another, so a very large bucket is not one task
    part = F.pmod(F.col("node"), F.lit(PARTS)).cast("int")
    sizes = places.groupBy("band", "hash", part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("band", "hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("band", "hash")
    bases = sizes.select("band", "hash", "part", F.sum("size").over(whole).alias("size"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")).where("size > 1")
    by_node = Window.partitionBy("band", "hash", "part").orderBy("node")
    members = places.withColumn("part", part).join(bases, ["band", "hash", "part"])
    members = materialize(members.select("band", "hash", "node", "first", "size", (F.col("base") + F.row_number().over(by_node)).cast("int").alias("rank")), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    source = body.withColumn("node", F.xxhash64("text"))
    same = (source["node"] == wanted["node"]) & source[key].eqNullSafe(wanted["first"])
    texts = materialize(source.join(wanted, same).select(source["node"], "text", "bands").dropDuplicates(["node"]), "texts")

    lead = members.where("rank = 1").select("band", "hash", F.col("node").alias("a"))
    pairs = materialize(lead.join(members.where("rank > 1"), ["band", "hash"]).select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = materialize(verified(pairs, texts, weights, threshold), "links")
    state = members.join(components(links), "node", "left").select("band", "hash", "node", "size", "rank", F.coalesce("component", "node").alias("component"))
    state = materialize(state, "state")
    still = state.groupBy("band", "hash").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band", "hash")
    open_ = state.join(still, ["band", "hash"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = open_.withColumn("own", F.floor((F.col("rank") - 1) / BLOCK).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rooms = dealt.select("band", "hash", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "rank", "component").join(texts, "node")
    more = materialize(bucket_links(rooms, weights, threshold), "more-links")
    out = rows.join(components(links.unionByName(more)), "node", "left").select(key, "node", F.coalesce("component", "node").alias("class"))
    least = out.groupBy("class").agg(F.min(key).alias("class_id"))
    found = materialize(out.join(least, "class").select(key, "node", "class_id", F.coalesce(F.col(key) == F.col("class_id"), F.lit(False)).alias("kept")), "classes")
    for done in (rows, members, texts, pairs, links, state, more):
        discard(done)
    return found


def op8_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
