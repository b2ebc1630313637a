"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING_POINTS points; each shard owns VIRTUAL_NODES of them and a key belongs to the next owned point clockwise. Loads are
bounded by rows, as tightly as can be: n rows on s shards give each shard floor(n/s) or one more. Each shard first takes the keys that
are its own, in a fixed order, up to its bound; keys that overflow a full shard continue clockwise to the next shard with room. So only
overflowing keys leave the place that plain consistent hashing gives them.

All keys of one ring point see the same shards clockwise, so the plan is made from the number of keys at each point: RING_POINTS
numbers at most, whatever the size of the data. Rows then find their shard by their rank at their point.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

RING_POINTS = 1 << 14
VIRTUAL_NODES = 64
SHARDS = 40
_M = (1 << 64) - 1


def _mix(x: int) -> int:
    """A 64-bit finaliser, to place virtual nodes on the ring."""
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, points: int = RING_POINTS) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise. A shard's nodes do not depend on how many shards there are."""
    return sorted((_mix(s << 20 | v) % points, s) for s in range(shards) for v in range(virtual_nodes))


def plan(counts: dict[int, int], shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, points: int = RING_POINTS) -> list[tuple[int, int, int, int, int]]:
    """(point, first rank, last rank, shard, slot of the first rank): where the keys at each ring point go."""
    nodes = ring(shards, virtual_nodes, points)
    at = [p for p, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, left = [], []

    def put(point: int, first: int, n: int, shard: int) -> None:
        out.append((point, first, first + n - 1, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for point in sorted(counts):
        k = bisect.bisect_left(at, point) % len(nodes)
        if n := min(counts[point], room[nodes[k][1]]):
            put(point, 1, n, nodes[k][1])
        if counts[point] > n:
            left.append((point, n + 1, counts[point] - n, k))
    for point, first, n, k in left:
        while n:
            k = (k + 1) % len(nodes)
            if m := min(n, room[nodes[k][1]]):
                put(point, first, m, nodes[k][1])
                first, n = first + m, n - m
    return out


def ring_point(key: Column, points: int = RING_POINTS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - (points.bit_length() - 1)).cast("int")


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, points: int = RING_POINTS) -> DataFrame:
    """Adds size, text_crc32, shard and slot (gapless from 0 in each shard) to the key of every row.

    Null keys are keys like any other (one ring point). Equal keys take ranks by checksum and size; rows equal in all of these are
    interchangeable. A null text has size 16 and the checksum of nothing. An empty table gives no rows.
    """
    spark = df.sparkSession
    found = df.groupBy(ring_point(F.col(key), points).alias("p")).count().collect()  # at most one row for each ring point
    rows = plan({r["p"]: r["count"] for r in found}, shards, points=points)
    moves = spark.createDataFrame(rows, "p int, lo long, hi long, shard int, base long")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.select(F.col(key), ring_point(F.col(key), points).alias("p"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    order = Window.partitionBy("p").orderBy(F.xxhash64(F.col(key), F.lit(1)), key, "text_crc32", "size")
    ranked = keyed.withColumn("rank", F.row_number().over(order).cast("long"))
    # the plan has at most one row for each ring point and one more for each time that a shard fills up
    placed = ranked.join(F.broadcast(moves), (ranked["p"] == moves["p"]) & ranked["rank"].between(moves["lo"], moves["hi"]))
    return placed.select(key, "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`: counts at most one apart."""
    placed = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
