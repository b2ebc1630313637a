import numpy as np
import pytest

from tramline.llm.vectors import CODES, code_size, decode, link_vectors, op7_vectors


def planted(rng, n, dims, cosines):
    """n random unit vectors, and partners of the first ones at these cosines."""
    unit = rng.normal(size=(n, dims))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    base, c = unit[: len(cosines)], np.array(cosines)[:, None]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    return unit, c * base + np.sqrt(1 - c**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


def brute(ids, vectors, threshold=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], label.max() + 1).min(1))
        if (low == label).all():
            return near.sum(1), label
        label = low


def test_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    links, label = brute([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float))
    got = {r["vec_id"]: r for r in op7_vectors(spark, sf).collect()}
    assert sum(got[r["vec_id"]]["n_links"] for r in rows) >= 0.99 * links.sum()
    assert all(got[r["vec_id"]]["n_links"] <= n for r, n in zip(rows, links))
    same = [got[r["vec_id"]]["component_id"] == c for r, c in zip(rows, label)]
    assert np.mean(same) >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    e = [1.0] + [0.0] * 15
    data = [(1, e, 0), (2, e, 0), (2, e, 0), (3, [2 * x for x in e], 0), (4, None, 0), (5, [0.0] * 16, 0), (6, [nan] * 16, 0), (7, [None] + e[1:], 0), (8, [inf] + e[1:], 0), (9, [1.0, 0.0], 0), (None, e, 0), (10, [], 0), (11, [0.0, 1.0] + [0.0] * 14, 0)]
    kind = "vec_id long, embedding array<double>, n_links int"
    got = [tuple(r) for r in link_vectors(spark.createDataFrame(data, kind)).collect()]
    assert len(got) == len(data)
    assert sorted(g for g in got if g[0] in (1, 2, 3)) == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    assert all(g[1] == 0 and g[2] == g[0] for g in got if g[0] not in (1, 2, 3))
    assert link_vectors(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("dims", [32, 64])
@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000, 3_000_000])
def test_recall_as_vectors_grow_in_number(n, dims):
    """Pairs share a direction of the code for n vectors, and a direction holds as many vectors as meant."""
    size = code_size(n, dims, 0.9)
    for cosine in (0.9, 0.95):
        a, b = (decode(x, *size) for x in planted(np.random.default_rng(n + dims), 500, dims, [cosine] * 500))
        assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)]) >= 0.99
    directions = CODES * size[2] ** size[1]
    assert 0.7 < np.mean([len(x) for x in a]) / directions / (32 / n) < 1.4


def test_planted_links(spark):
    cosines = [0.901, 0.91, 0.92, 0.93, 0.94, 0.95, 0.97, 0.99] * 25
    unit, partners = planted(np.random.default_rng(8), 5000, 64, cosines)
    both = np.concatenate([unit, partners])
    ids = list(range(len(both)))
    links, _ = brute(ids, both)
    assert links.sum() >= 2 * len(cosines)
    got = link_vectors(spark.createDataFrame(list(zip(ids, both.tolist(), strict=True)), "vec_id long, embedding array<double>")).collect()
    assert sum(r["n_links"] for r in got) >= 0.99 * links.sum()
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got)


def test_equals_sql(spark, tmp_path):
    """All pairs of a table with planted ones, chains of them, equal vectors and unusable ones, in another engine."""
    import duckdb

    from tramline.llm.vectors import op7_sql, op7_vectors

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for i in range(60):
        v = x[i]
        for k in range(i % 4):
            turn = rng.normal(size=48)
            turn -= turn @ v / (v @ v) * v
            v = 0.93 * v / np.linalg.norm(v) + np.sqrt(1 - 0.93**2) * turn / np.linalg.norm(turn)
            rows.append((1000 + 10 * i + k, v.tolist()))
    rows += [(5000, x[0].tolist()), (5001, None), (5002, [0.0] * 48), (5003, [float("nan")] * 48), (5004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({op7_sql()})").fetchall())
    assert sorted(tuple(r) for r in op7_vectors(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert sum(r[1] for r in want) > 150
