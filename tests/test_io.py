"""Readers, conversion, id repair, sinks and the whole run, on small files."""

import itertools
import json

import numpy as np
import pytest

from tramline.__main__ import main
from tramline.config import Settings, load_game, load_settings
from tramline.operators.balance import balance_roles, rebalance
from tramline.operators.tensors import build_tensors
from tramline.pipeline import Run, run_pipeline
from tramline.sinks import writers
from tramline.sources import ngsim, readers, repair
from tramline.streaming.islands import stream_islands


def track_rows(scene_cars=8, frames=300):
    return [(f, c, 3.0 * (c % 2), 25.0 * c + (6 + c % 5) * f / 10, 90.0, float(6 + c % 5), "car") for c in range(scene_cars) for f in range(frames)]


def write_tracks(path, rows):
    path.write_text("frameNum,carId,carCenterXm,carCenterYm,heading,speed,objClass\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")


def test_settings_files(tmp_path):
    (tmp_path / "c.yaml").write_text("time: {fps: 10.0, conflict_ttc_threshold: 1.5}\nneighbor: {slots: [front, rear]}\nsplit: {train_val_ratio: 0.8}\nrebalance: {enabled: true, target_ratio: 2}\nio: {raw_dir: x}\n")
    s = load_settings(tmp_path / "c.yaml")
    assert (s.fps, s.ttc_threshold, s.slots, s.split_ratio, s.target_ratio, s.raw_dir) == (10.0, 1.5, ("front", "rear"), 0.8, 2.0, "x")
    (tmp_path / "d.yaml").write_text("")
    d = load_settings(tmp_path / "d.yaml")
    assert (d.fps, d.ttc_threshold, d.split_ratio, d.rebalance) == (25.0, 3.0, None, False)
    (tmp_path / "g.yaml").write_text("game: {seg_len_frames: 5, readouts: [reverse]}\nmc: {n_samples: 3}\nexact: {enabled: true, agents: [0, 1]}\nselection: {max_n: 2, roles: [front]}\n")
    g = load_game(tmp_path / "g.yaml")
    assert (g.seg_len_frames, g.readouts, g.n_samples, g.exact_agents, g.selection.max_n, g.selection.roles) == (5, ("reverse",), 3, (0, 1), 2, ("front",))
    assert Settings().frames(0.25) == 2 and Settings().seconds(5) == 0.5  # halves go to the even number
    with pytest.raises(ValueError, match="unknown slots"):
        Settings(slots=("above",))


def test_readers(spark, tmp_path):
    write_tracks(tmp_path / "b.csv", track_rows(2, 3))
    write_tracks(tmp_path / "a.csv", track_rows(1, 3))
    assert {r["scene_id"] for r in readers.read_folder(spark, str(tmp_path)).collect()} == {"a", "b"}
    one = readers.read_raw(spark, str(tmp_path / "a.csv"))
    assert {r["scene_id"] for r in one.collect()} == {"scene"} and dict(one.dtypes)["carId"] == "string" and dict(one.dtypes)["frameNum"] == "bigint"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "bad.csv").write_text("frameNum,carId\n1,2\n")
    with pytest.raises(ValueError, match="heading"):
        readers.read_raw(spark, str(tmp_path / "x" / "bad.csv"))
    assert [p.rsplit("/", 1)[1] for p in readers.list_csv(spark, str(tmp_path))] == ["a.csv", "b.csv"]
    assert readers.with_suffix("x/foo.csv", "train") == "x/foo_train.csv"
    labels = readers.read_labels(spark, [str(tmp_path / "none.csv")])
    assert labels.count() == 0 and "is_conflict" in labels.columns
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "Event_id string")
    (tmp_path / "keep.txt").write_text("1\n\n 3 \n")
    assert {r[0] for r in readers.keep_listed(rows, str(tmp_path / "keep.txt")).collect()} == {"1", "3"}
    assert readers.keep_listed(rows, str(tmp_path / "none.txt")).count() == 3


def test_ngsim(spark, tmp_path):
    """Two cars: one drives north by a foot a frame, one has a single row; feet become metres and y points south."""
    lines = ["Vehicle_ID,Frame_ID,Global_X,Global_Y,Local_X,v_Length,v_Width,v_Vel,v_Class,Lane_ID"]
    lines += [f"1,{f},100,{200 + f},0,10,5,10,2,1" for f in range(4)] + ["1,30,100,260,0,10,5,10,2,1", "2,0,110,190,0,20,6,0,9,1"]
    (tmp_path / "peach.csv").write_text("\n".join(lines) + "\n")
    assert readers.is_ngsim(lines[0].split(",")) and not readers.is_ngsim([" Vehicle_ID"])
    out = {(r["carId"], r["frameNum"]): r for r in readers.read_raw(spark, str(tmp_path / "peach.csv")).collect()}
    assert {r["scene_id"] for r in out.values()} == {"peachtree"}
    r = out[1, 0]
    assert r["carCenterXm"] == pytest.approx(0) and r["carCenterYm"] == pytest.approx(60 * 0.3048) and r["speed"] == pytest.approx(3.048)
    assert r["heading"] == pytest.approx(270) and r["course"] == pytest.approx(0) and r["objClass"] == 0
    assert (r["boundingBox1Xm"], r["boundingBox1Ym"]) == pytest.approx((-2.5 * 0.3048, 60 * 0.3048 - 5 * 0.3048))
    assert out[1, 3]["heading"] == pytest.approx(270) and out[1, 30]["heading"] == -1 and out[2, 0]["course"] == -1 and out[2, 0]["objClass"] == -1
    assert {r["scene_id"] for r in readers.read_folder(spark, str(tmp_path)).collect()} == {"peach"}


def test_downsample(spark):
    df = spark.createDataFrame([("s", f, c, 1) for f in range(3, 20) for c in (1, 2)], "scene_id string, frameNum long, carId long, laneId int")
    out = ngsim.downsample(df)
    assert out.columns == ["scene_id", "frameNum", "carId"]
    assert sorted(r["frameNum"] for r in out.where("carId = 1").collect()) == list(range(6))  # 5 7 10 12 15 17


def test_assignment_is_least():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 4), (4, 2), (5, 5), (3, 6)):
        cost = rng.integers(0, 20, (n, m)).astype(float)
        got = repair.assign(cost)
        small, large = sorted((n, m))
        turned = cost if n <= m else cost.T
        best = min(sum(turned[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and len({i for i, _ in got}) == len({j for _, j in got}) == small
        assert sum(cost[i, j] for i, j in got) == best


def test_shared_ids(spark):
    """Two cars drive apart under one id, a third joins them later; another id is fine and stays."""
    rows = [("s", f, "7", 0.0 + f, 0.0) for f in range(10)] + [("s", f, "7", 0.0 + f, 20.0) for f in range(10)] + [("s", f, "7", 100.0, 50.0) for f in range(5, 10)] + [("s", f, "8", 1.0, 1.0) for f in range(4)]
    out = repair.split_shared_ids(spark.createDataFrame(rows, "scene_id string, frameNum long, carId string, carCenterXm double, carCenterYm double")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["carId"], set()).add(r["carCenterYm"])
    assert groups == {"7_0": {0.0}, "7_1": {20.0}, "7_2": {50.0}, "8": {1.0}} and len(out) == len(rows)


@pytest.fixture(scope="module")
def golden(spark):
    """Event 101: an ego of 100 frames and a target in front from frame 60 on without 80; event 202: an ego from frame 50 on."""
    def rows(event, car, role, frames):
        return [(event, car, role, f, 100.0 + car + 0.1 * f, 200.0 + car + 0.05 * f, 15.0 + car, 10.0 + car) for f in frames]

    data = rows(101, 1, "ego", range(100)) + rows(101, 2, "front", [f for f in range(60, 100) if f != 80]) + rows(202, 3, "ego", range(50, 100))
    labels = [(101, "a", 99.0, 1, 2, "front"), (202, "b", 99.0, 0, -1, "")]
    return build_tensors(spark, spark.createDataFrame(data, "Event_id long, carId long, role string, frameNum long, carCenterXm double, carCenterYm double, heading double, speed double"),
                         spark.createDataFrame(labels, "Event_id long, scene_id string, t0 double, is_conflict int, conflict_target_id long, conflict_target_role string"))


def test_golden_tensors(golden):
    got = {r["event_id"]: r for r in golden.collect()}
    want = np.zeros((2, 7, 80), bool)
    want[0, 0, :] = want[0, 1, 40:] = want[1, 0, 30:] = True
    want[0, 1, 60] = False
    assert np.array_equal(np.array([got[101]["valid"], got[202]["valid"]]), want)
    assert (got[101]["agent_mask"], got[202]["agent_mask"], got[101]["target_idx"], got[202]["target_idx"]) == (3, 1, 0, -1)
    x = np.array(got[101]["x"])
    assert x.shape == (7, 80, 4) and x[0, 79] == pytest.approx([0, 0, 0, 11]) and x[1, 79] == pytest.approx([1, 1, 1, 12]) and not x[1, 60].any() and x[0, 0, 0] == pytest.approx(-7.9, abs=1e-5)


def test_records_round_trip(spark, golden, tmp_path):
    path = writers.write_tensors(golden, str(tmp_path / "t"))
    table = readers.read_tensors(spark, path, require_valid=True)
    assert writers.dead_events(table) == 0
    rows = {r["event_id"]: r for r in writers.to_records(table).collect()}
    for r in table.collect():
        x, valid = writers.from_record(rows[r["event_id"]]["record"], rows[r["event_id"]]["valid_bits"])
        assert np.array_equal(x, np.array(r["x"], "f4")) and np.array_equal(valid, np.array(r["valid"]))
        assert len(rows[r["event_id"]]["record"]) == 8960 and len(rows[r["event_id"]]["valid_bits"]) == 70
    index = {r["event_id"]: r for r in writers.record_index(writers.to_records(table)).collect()}
    assert (index[101]["byte_offset"], index[202]["byte_offset"], index[101]["byte_length"]) == (0, 8960, 8960)
    meta = readers.event_metadata(table, 101).collect()
    assert meta[0]["scene_id"] == "a" and "x" not in meta[0]
    old = table.drop("valid")
    old.write.parquet(str(tmp_path / "old"))
    with pytest.raises(RuntimeError, match="valid"):
        readers.read_tensors(spark, str(tmp_path / "old"), require_valid=True)
    table.withColumn("valid", table["valid"]).drop("valid").join(golden.select("event_id", "valid"), "event_id").write.parquet(str(tmp_path / "base"))
    again = writers.write_tensors(golden, str(tmp_path / "new"), valid_only=True, base=str(tmp_path / "base"))
    assert {r["event_id"]: r["valid"] for r in spark.read.parquet(again).collect()} == {r["event_id"]: r["valid"] for r in table.collect()}


def test_balancing(spark):
    labels = spark.createDataFrame([(str(i), "s", int(i < 12), "front" if i < 9 else "rear" if i < 12 else "") for i in range(20)] + [("99", "only", 1, "rear")], "Event_id string, scene_id string, is_conflict int, conflict_target_role string")
    kept = rebalance(labels, Settings())
    n = {(r["scene_id"], r["is_conflict"]): r["count"] for r in kept.groupBy("scene_id", "is_conflict").count().collect()}
    assert n == {("s", 1): 8, ("s", 0): 8, ("only", 1): 1}
    assert {r["is_conflict"]: r["count"] for r in rebalance(labels, Settings(target_ratio=2.0)).where("scene_id = 's'").groupBy("is_conflict").count().collect()} == {1: 12, 0: 8}
    roles = {(r["scene_id"], r["conflict_target_role"]): r["count"] for r in balance_roles(labels, Settings()).groupBy("scene_id", "conflict_target_role").count().collect()}
    assert roles == {("s", "front"): 3, ("s", "rear"): 3, ("s", ""): 8, ("only", "rear"): 1}


def test_run_and_command_line(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    write_tracks(tmp_path / "raw" / "one.csv", track_rows())
    write_tracks(tmp_path / "raw" / "two.csv", track_rows(8, 280))
    s = Settings(raw_dir=str(tmp_path / "raw"), ttc_threshold=3.0)
    out = f"{tmp_path}/out/"
    paths = run_pipeline(spark, s, interim=True, out=out)
    assert [p.removeprefix(out) for p in paths] == ["data/processed/data/events_data_train.csv", "data/processed/labels/events_labels_train.csv", "data/processed/labels/events_future_traj_train.csv"]
    read = lambda p: spark.read.option("header", True).csv(p)
    parts = {part: [read(p.replace("_train", f"_{part}")) for p in paths] for part in ("train", "val")}
    for data, labels, future in parts.values():
        assert (data.columns, labels.columns, future.columns) == (list(writers.DATA), list(writers.LABELS), list(writers.FUTURE))
        ids = sorted(int(r[0]) for r in labels.select("Event_id").collect())
        assert ids == list(range(len(ids))) and len(ids) > 0
        assert data.where("double(t_rel) > 0").count() == 0 and future.where("double(t_rel) <= 0").count() == 0 and data.where("role = 'ego'").count() > 0
    egos = [{r[0] for r in d[0].where("role = 'ego'").select("carId").distinct().collect()} for d in parts.values()]
    assert not egos[0] & egos[1]
    assert read(out + s.interim_dir).columns == ["scene_id", "ego_id", "is_conflict", "t_conflict", "conflict_target_id"]
    main(["tensors", "--data", paths[0], "--labels", paths[1], "--out", f"{tmp_path}/tensors"], spark)
    main(["records", "--tensors", f"{tmp_path}/tensors", "--out", f"{tmp_path}/records"], spark)
    n = spark.read.parquet(f"{tmp_path}/tensors").count()
    assert n == parts["train"][1].count() == spark.read.parquet(f"{tmp_path}/records/records").count()
    from tramline.models.forward import seeded_weights

    np.savez(f"{tmp_path}/w.npz", **seeded_weights("transformer", hidden=8, layers=1))
    main(["evaluate", "--tensors", f"{tmp_path}/tensors", "--weights", f"{tmp_path}/w.npz", "--model", "transformer", "--out", f"{tmp_path}/measures"], spark)
    found = spark.read.json(f"{tmp_path}/measures").first()
    assert found["tp"] + found["tn"] + found["fp"] + found["fn"] == n and 0 <= found["f1"] <= 1
    (tmp_path / "g.yaml").write_text("game: {seg_len_frames: 40, readouts: [chrono]}\nmc: {n_samples: 2}\nselection: {conflict_only: false}\n")
    main(["attribute", "--tensors", f"{tmp_path}/tensors", "--weights", f"{tmp_path}/w.npz", "--config", str(tmp_path / "g.yaml"), "--max-n", "2", "--out", f"{tmp_path}/attr"], spark)
    rows = spark.read.option("header", True).csv(f"{tmp_path}/attr/summary").collect()
    assert len(rows) == min(2, n) and all(abs(float(r["residual"])) < 1e-6 for r in rows)
    documents = spark.read.text(f"{tmp_path}/attr/events").collect()
    assert len(documents) == len(rows) and "chrono" in json.loads(documents[0][0])["readouts"]


def test_stream_gives_the_islands_of_the_batch(spark, tmp_path):
    frames = spark.createDataFrame([("s", 1, 2, f) for f in (1, 2, 3, 7, 8, 20)] + [("s", 2, 1, f) for f in (5, 6)], "scene_id string, ego long, tgt long, frameNum long")
    frames.write.parquet(str(tmp_path / "in"))
    batch = sorted(tuple(r) for r in stream_islands(frames).collect())
    assert batch == [("s", 1, 2, 1, 3, 2), ("s", 1, 2, 7, 8, 8), ("s", 1, 2, 20, 20, 20), ("s", 2, 1, 5, 6, 6)]
    stream = stream_islands(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), late_sec=0.1)
    q = stream.writeStream.format("memory").queryName("islands").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert set(tuple(r) for r in spark.table("islands").collect()) <= set(batch) and spark.table("islands").count() >= 3
    assert Run(spark, spark.createDataFrame([], "scene_id string, frameNum long, carId long, carCenterXm double, carCenterYm double, heading double, speed double, objClass int")).conflicts().count() == 0
