"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a random product code: the (rotated) space is cut into blocks, each block has its own random unit codewords, and
every combination of codewords is a direction. A vector is list-decoded to all directions whose inner product with it exceeds a bound,
without trying them all. Vectors that share a direction are compared exactly. The bound follows the number of vectors, so that a
direction holds about BUCKET of them, and the number of directions follows the bound, so that a pair at the threshold shares none with
probability MISS (from the areas of caps on the sphere; measured on planted pairs, 1 or 2 in 10,000 from 1e4 to 1e7 vectors).

A pair is counted at its smallest common direction only, so links are counted without gathering pairs; from each bucket only sums and
one edge for each linked vector go on. Buckets over BLOCK rows are cut into blocks and compared block pair by block pair, so no task
holds more than two blocks. Equal vectors are one vector with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, small_batches, table

BUCKET = 32.0
MISS = 0.0001
#: Product codes with rotations of their own that share the filters; one code alone treats some places worse than others.
CODES = 24
#: Times the directions that independent ones would need: those of a product code share codewords, so common ones come in clusters.
SPREAD = 2.0
#: Most codewords of a block for codes of two blocks; beyond, three blocks are used.
WORDS = 4096
#: Vectors decoded at once; their scores against all codewords are held together.
DECODED = 256
BLOCK = 512
SEED = 20


def cap_tail(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to a right one, and the share of the sphere within each of them from a fixed direction."""
    angles = np.linspace(0, math.pi / 2, 100_001)
    density = np.sin(angles) ** (dims - 2)
    area = np.concatenate([[0], np.cumsum(density[1:] + density[:-1])])
    return angles, area / (2 * area[-1])


@lru_cache(maxsize=64)
def code_size(n: int, dims: int, threshold: float) -> tuple[float, int, int]:
    """(bound on the inner product, blocks, codewords in each block) for n unit vectors.

    Caps and their overlap at the threshold are measured on the sphere; its tail is lighter than the normal one, the more so the farther
    out. Below 4 dimensions the figures of 4 are used: caps of the same bound are larger there, so no more pairs are missed.
    """
    d = max(dims, 4)
    angles, tail = cap_tail(d)
    reach = float(np.interp(min(0.02, BUCKET / max(n, 1)), tail, angles))
    bound, rest = math.cos(reach), math.sqrt(1 - threshold**2)
    # a direction at angle a from one vector of the pair lies in the other's cap if its part along the other is large enough
    a = np.linspace(0, reach, 4001)[1:]
    need = np.clip((bound - threshold * np.cos(a)) / (rest * np.sin(a)), -1, 1)
    sub_angles, sub = cap_tail(d - 1)
    within = np.interp(np.arccos(np.abs(need)), sub_angles, sub)
    whole = 2 * np.trapezoid(np.sin(angles) ** (d - 2), angles)
    both = np.trapezoid(np.sin(a) ** (d - 2) * np.where(need >= 0, within, 1 - within), a) / whole
    filters = SPREAD * math.log(1 / MISS) / both / CODES
    blocks = 1 if dims < 8 else 2 if filters <= WORDS**2 or dims < 12 else 3
    return bound, blocks, max(2, math.ceil(filters ** (1 / blocks)))


@lru_cache(maxsize=64)
def code(dims: int, blocks: int, size: int, which: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation and each block's codewords."""
    rng = np.random.default_rng([SEED, dims, blocks, size, which])
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    words = [rng.normal(size=(size, len(part))) for part in np.array_split(np.arange(dims), blocks)]
    return turn, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]


def decode(unit: np.ndarray, bound: float, blocks: int, size: int) -> list[np.ndarray]:
    """For each row all filters whose direction has an inner product of at least bound with it, ascending."""
    need, found = bound * math.sqrt(blocks), [[] for _ in range(len(unit))]
    for which in range(CODES):
        turn, words = code(unit.shape[1], blocks, size, which)
        scores = [p @ w.T for p, w in zip(np.array_split(unit @ turn, blocks, axis=1), words, strict=True)]
        after = [np.zeros(len(unit))]  # the best that the blocks after each one can add
        for s in reversed(scores[1:]):
            after.insert(0, after[0] + s.max(1))
        for r in range(len(unit)):
            ids, sums = np.zeros(1, np.int64), np.zeros(1)
            for s, rest in zip(scores, after, strict=True):
                if not len(ids):
                    break
                able = np.nonzero(s[r] >= need - rest[r] - sums.max())[0]
                grid = sums[:, None] + s[r][able][None, :]
                i, j = np.nonzero(grid >= need - rest[r])  # only prefixes that the later blocks can still lift over the bound
                ids, sums = ids[i] * size + able[j], grid[i, j]
            if len(ids):
                found[r].append(np.sort(ids) + which * size**blocks)
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def compare(ids: np.ndarray, counts: np.ndarray, unit: np.ndarray, filters: list[np.ndarray], here: int, cross: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that are counted in this bucket, and the smallest id of its component in it.

    cross: the block of each row, if only pairs of different blocks are to be compared.
    """
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if cross is not None:
        near &= cross[:, None] != cross[None, :]
    label = ids.copy()
    if not near.any():
        return np.zeros(len(ids), np.int64), label
    while True:
        low = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            break
        label = low
    rows = np.nonzero(near.any(1))[0]
    earlier = [filters[r][filters[r] < here] for r in rows]
    values, inverse, seen = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [len(e) for e in earlier])
    shared = seen[inverse] > 1
    place = np.cumsum(seen > 1) - 1
    held = np.zeros((len(rows), int((seen > 1).sum())), np.float32)
    held[owner[shared], place[inverse[shared]]] = 1
    first = near[np.ix_(rows, rows)] & (held @ held.T < 0.5)
    links = np.zeros(len(ids), np.int64)
    links[rows] = first @ counts[rows]
    return links, label


def link_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """For every row its n_links (other rows at cosine >= threshold found), component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows without an id, whose
    component is null. Vectors of different length do not link. Repeated ids count as rows. Other columns are dropped.
    """
    spark = df.sparkSession
    small_batches(spark)
    x = F.col(vector)
    usable = F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(key), F.when(usable, x.cast("array<double>")).alias("x"))
    groups = materialize(rows.where("x is not null").groupBy("x").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dims", F.size("x")), "vectors")
    found = {r["dims"]: r["n"] for r in groups.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {d: code_size(n, d, threshold) for d, n in found.items()}

    # narrow numbers of directions where they fit, as they are most of what moves besides the vectors
    wide = max((CODES * size**blocks for _, blocks, size in sizes.values()), default=0) >= 1 << 31

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                raw = part.column("x").flatten().to_numpy().reshape(-1, int(d))
                scale = np.abs(raw).max(1, keepdims=True)
                unit = raw / scale
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                got = [f for i in range(0, len(unit), DECODED) for f in decode(unit[i : i + DECODED], *sizes[int(d)])]
                yield pa.RecordBatch.from_pydict({"rep": part.column("rep"), "n": part.column("n"), "dims": part.column("dims"), "unit": pa.array(list(unit), pa.list_(pa.float64())), "filters": pa.array(got, pa.list_(pa.int64() if wide else pa.int32()))})

    listed = materialize(groups.mapInArrow(filtered, f"rep long, n long, dims int, unit array<double>, filters array<{'long' if wide else 'int'}>"), "filters")
    # a bucket needs only the smaller filters of its vectors
    places = listed.select("*", F.posexplode("filters").alias("at", "f")).withColumn("filters", F.expr("slice(filters, 1, at)")).drop("at")
    large = listed.select("dims", F.explode("filters").alias("f")).groupBy("dims", "f").count().where(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = places.join(large, ["dims", "f"], "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    dealt = dealt.select("dims", "f", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "n", "unit", "filters")
    keys = ["dims", "f", "lo", "hi"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            at = np.stack([t.column(k).to_numpy() for k in keys])
            starts = np.nonzero(np.any(at[:, 1:] != at[:, :-1], axis=0))[0] + 1
            edges = [0, *starts.tolist(), t.num_rows]
            reps, counts, own = (t.column(k).to_numpy() for k in ("rep", "n", "own"))
            dims = at[0]
            flat, listed_at = t.column("filters").combine_chunks(), None
            values, offsets = flat.flatten().to_numpy(), np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())])
            units = t.column("unit").combine_chunks()
            raw, begin = units.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims)])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1:
                    unit = raw[begin[a] : begin[b]].reshape(b - a, int(dims[a]))
                    cross = own[a:b] if at[2, a] != at[3, a] else None
                    links, label = compare(reps[a:b], counts[a:b], unit, [values[offsets[i] : offsets[i + 1]] for i in range(a, b)], at[1, a], cross, threshold)
                    some = (links > 0) | (label != reps[a:b])
                    if some.any():
                        out.append((reps[a:b][some], links[some], label[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=["rep", "links", "low"])

        for b in batches:
            if not b.num_rows:
                continue
            cut = 0  # where the last bucket of this batch begins
            at = np.stack([b.column(k).to_numpy() for k in keys])
            same = np.all(at == at[:, -1:], axis=0)
            cut = int(np.argmax(same))
            if held and (cut or any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys)):
                if cut:
                    held.append(b.slice(0, cut))
                yield from close()
                held = [b.slice(cut)]
            elif cut:
                held.append(b.slice(0, cut))
                yield from close()
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from close()

    shuffled = dealt.repartition(*keys).sortWithinPartitions(*keys)
    sums = materialize(shuffled.mapInArrow(compared, "rep long, links long, low long").groupBy("rep", "low").agg(F.sum("links").alias("links")), "links")
    linked = sums.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(sums.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    state = groups.select("x", "rep", "n").join(linked, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    state = state.select("x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where("x is not null").join(state, "x").select(key, "n_links", "component_id")
    alone = rows.where("x is null").select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op7_sql(threshold: float = 0.9) -> str:
    """DuckDB: all pairs compared, and what each vector reaches by links. For small tables."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {threshold}),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT r.vec_id, any_value(coalesce(n.n, 0)) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) AS n ON r.vec_id = n.a GROUP BY r.vec_id"""
