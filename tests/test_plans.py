import duckdb
import pytest

from tramline.plans.templates import PLANS
from tramline.queries import ORACLES, QUERIES
from tramline.sources.tracks import require_columns

SF = "/root/testdata/sf0.001"


def rows(found):
    return sorted(repr(tuple(float(v) if isinstance(v, (int, float)) else v for v in r)) for r in found)


@pytest.fixture(scope="module")
def other():
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, other, name):
    df = QUERIES[name](spark, SF)
    columns = ", ".join(df.columns)
    assert rows(df.collect()) == rows(other.execute(f"SELECT {columns} FROM ({ORACLES[name]}) AS q").fetchall())


def test_shapley_values_of_the_nearest_agents_risk(spark):
    """The game is worth its largest risk; such games have a closed form: each step between sorted risks is shared by those above it."""
    risk, got = {}, {}
    memo = {}
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    for r in PLANS.apply(spark, "agent_risk", memo, customer=customer).collect():
        risk.setdefault(r["event_id"], {})[r["slot"]] = r["risk"]
    for r in PLANS.apply(spark, "exact_shapley", memo, customer=customer).collect():
        got.setdefault(r["event_id"], {})[r["slot"]] = r["phi"]
    assert got.keys() == risk.keys() and len(got) > 100
    for event, own in risk.items():
        order = sorted(own, key=own.get)
        value, last = dict.fromkeys(own, 0.0), 0.0
        for k, slot in enumerate(order):
            for above in order[k:]:
                value[above] += (own[slot] - last) / (len(order) - k)
            last = own[slot]
        assert all(abs(value[s] - got[event][s]) < 1e-5 for s in own)


@pytest.mark.parametrize(("ego", "target", "conflicts"), [((0, 15), (20, 10), True), ((0, 5), (20, 15), False), ((0, 10.5), (100, 10), False)])
def test_closing_vehicles(spark, ego, target, conflicts):
    data = [("s", f, car, 0.0, float(y + v * f / 10), 90.0, float(v)) for car, (y, v) in ((1, ego), (2, target)) for f in range(35)]
    tracks = spark.createDataFrame(data, "scene_id string, frameNum long, carId long, carCenterXm double, carCenterYm double, heading double, speed double")
    found = PLANS.apply(spark, "conflict_frames", tracks=tracks)
    assert (found.count() > 0) == conflicts


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="heading"):
        require_columns(spark.createDataFrame([(1,)], "frameNum long"))
