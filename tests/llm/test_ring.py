"""The ring, walked row by row in plain Python."""

import struct

import xxhash

from tramline.llm.sharding import RING_POINTS, SHARDS, op5_sharding, ring

SF = "/root/testdata/sf0.01"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_row_goes_clockwise_to_the_first_shard_with_room(spark):
    rows = {r["doc_id"]: r for r in op5_sharding(spark, SF).collect()}
    nodes = ring(SHARDS)
    room = [len(rows) // SHARDS + (s < len(rows) % SHARDS) for s in range(SHARDS)]
    used, want, late = [0] * SHARDS, {}, []

    def put(doc, shard):
        want[doc] = (shard, used[shard])
        used[shard] += 1

    keyed = []
    for doc in rows:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
        keyed.append((h * RING_POINTS >> 64, signed(xxhash.xxh64_intdigest(struct.pack("<i", 1), h)), doc))
    for point, _, doc in sorted(keyed):
        k = next((i for i, (p, _) in enumerate(nodes) if p >= point), 0)
        if used[nodes[k][1]] < room[nodes[k][1]]:
            put(doc, nodes[k][1])
        else:
            late.append((doc, k))
    for doc, k in late:
        while used[nodes[k][1]] >= room[nodes[k][1]]:
            k = (k + 1) % len(nodes)
        put(doc, nodes[k][1])
    assert {d: (r["shard"], r["slot"]) for d, r in rows.items()} == want and late
