import random

import pytest

from tramline.plans.scenes import KEEP, deal
from tramline.plans.templates import PLANS, STORED_BY_SCENE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["kinematics_rows", "neighbor_pairs", "ttc_rows", "box_pairs_close"])
def test_tracks_and_pairs_are_not_shuffled(spark, name):
    """Only customers are dealt; rows of tracks and pairs stay in the tasks that make them."""
    df = PLANS.apply(spark, name, {}, by_scene=True, customer=deal(spark.read.parquet(f"{SF}/customer.parquet")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_event_rows_are_not_shuffled(spark):
    """Their inputs are stored members; what is counted from event rows is not dealt again."""
    memo, customer = {}, deal(spark.read.parquet(f"{SF}/customer.parquet"))
    df = PLANS.apply(spark, "event_history_rows", memo, by_scene=True, customer=customer)
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "SinglePartition" not in above
    assert not STORED_BY_SCENE & {"dedup_first", "event_rows", "tensor_rows", "ttc_obb_rows", "kinematics_by_pair"}


def test_same_conflicts_and_measures_on_odd_tracks(spark):
    """Turning, overlapping and repeated cars, sudden speeds and missing ones: plans by scene find what the plain ones find."""
    draw = random.Random(3)
    rows = []
    for scene in ("a", "b", "c"):
        for car in range(12):
            x, y, h, v = draw.uniform(0, 60), draw.uniform(0, 60), draw.uniform(0, 360), draw.uniform(0, 30)
            for f in range(12):
                h, v = h + draw.choice((0, 0, 5, 90)), v + draw.choice((0, 0, 1, -9))
                rows.append((scene, f, car, x + f * draw.random(), y, h % 360, None if draw.random() < 0.05 else v))
                if draw.random() < 0.1:
                    rows.append(rows[-1])
    tracks = spark.createDataFrame(rows, "scene_id string, frameNum long, carId long, carCenterXm double, carCenterYm double, heading double, speed double")
    spark.conf.set(KEEP, "false")
    for name in ("conflict_frames", "ttc_center_kernel", "kinematics_compat"):
        got = PLANS.apply(spark, name, {}, by_scene=True, tracks=tracks.repartition(2, "scene_id"))
        want = PLANS.apply(spark, name, {}, tracks=tracks)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert got.count() > 20


SMALL = {"conflict_islands", "nonconflict_sample", "windows_valid", "events", "seen"}


@pytest.mark.parametrize("name", ["rebalance_report", "rebalance_labels", "rebalance_roles", "event_future_rows", "dead_events", "bce_loss", "valid_counts", "slot_assignment"])
def test_only_chosen_rows_are_stored(spark, name):
    """Conflict frames, votes, roles, slots and seats go through memory on the way to these; rows are those of the plain plans."""
    memo, customer = {}, spark.read.parquet(f"{SF}/customer.parquet")
    got = PLANS.apply(spark, name, memo, by_scene=True, customer=deal(customer))
    assert set(memo) <= SMALL
    want = PLANS.apply(spark, name, {}, customer=customer)
    assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    rows = sorted(map(repr, got.collect()))
    assert rows and rows == sorted(map(repr, want.collect()))


def test_counts_of_scenes_with_one_kind_of_candidates(spark):
    """Reports count what stays where a scene has fewer, more or no other rows."""
    islands = spark.createDataFrame([(s, e, 99, f, f + 2, f + 1) for s, n in (("a", 5), ("b", 2), ("c", 3)) for e in range(n) for f in (10,)], "scene_id string, ego long, tgt long, start_frame long, end_frame long, t_conflict long")
    sample = spark.createDataFrame([(s, e, 5) for s, n in (("a", 2), ("b", 4), ("d", 1)) for e in range(n)], "scene_id string, ego long, frameNum long")
    bound = {"conflict_islands": islands, "nonconflict_sample": sample}
    for name in ("rebalance_report", "candidates_union"):
        got, want = (PLANS.apply(spark, name, {}, by_scene=b, **bound) for b in (True, False))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
