"""The plans as they run where all rows of a scene are dealt to one task before tracks are made: same rows, other texts.

What is joined, ranked or counted within a scene, a car or an event then needs no shuffle of its own, so rows of tracks, pairs and event
windows are never written; only what is small beside them is stored. Joins read the larger side as it comes and hold the smaller one, of
one task, in memory. The SQL for the other engine stays that of the plans themselves. Joins on more than the scene are left where their
rows lie only if spark.sql.requireAllClusterKeysForCoPartition is off; the order of the columns that windows part by saves sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import attribution, conflicts, events  # noqa: F401  (they add the plans that are changed here)
from . import fixture  # noqa: F401
from .templates import PLANS

#: Rows of tracks that a task has, about.
ROWS = 1 << 16
FRAMES, CARS = 150, 20
KEEP = "spark.sql.requireAllClusterKeysForCoPartition"


def deal(customer: DataFrame) -> DataFrame:
    """Customers with their scene, those of one scene in one task; so few rows move that this costs next to nothing."""
    spark, n = customer.sparkSession, customer.count()
    spark.conf.set(KEEP, "false")
    parts = max(n * FRAMES // ROWS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // CARS), 1)
    scene = "CONCAT('S', CAST(CAST((CAST(c_custkey AS BIGINT) - CAST(c_custkey AS BIGINT) % 20) / 20 AS INT) AS STRING))"
    return customer.select("c_custkey").repartition(parts, F.expr(scene)).select("c_custkey", F.expr(scene).alias("scene_id"))


def put(name: str, *changes: tuple[str, str], sql: str | None = None) -> None:
    """A plan's text for scenes: its own with changes, or another."""
    text = sql or PLANS.plans[name].sql
    for old, new in changes:
        if old not in text:
            raise ValueError(f"{name} has no {old}")
        text = text.replace(old, new)
    PLANS.scenes(name, text)


put("tracks", ("SELECT CONCAT('S', CAST(CAST((c - c % 20) / 20 AS INT) AS STRING)) AS scene_id", "SELECT scene_id"), ("(SELECT c, f, lane", "(SELECT scene_id, c, f, lane"),
    ("(SELECT CAST(c_custkey AS BIGINT) AS c", "(SELECT /*+ BROADCAST(g) */ scene_id, CAST(c_custkey AS BIGINT) AS c"), ("CROSS JOIN {frames}", "CROSS JOIN {frames} AS g"))
put("dedup_first", ("PARTITION BY scene_id, frameNum, carId", "PARTITION BY scene_id, carId, frameNum"))
put("neighbor_pairs", ("(SELECT a.scene_id", "(SELECT /*+ SHUFFLE_HASH(b) */ a.scene_id"))
#: A pair has the kinematics of its own two rows.
put("ttc_rows", sql="""
SELECT scene_id, frameNum, ego, tgt, CASE WHEN c <= 1E-6 AND a <= 1E-6 THEN NULL
 WHEN abs(a) < 1E-6 THEN CASE WHEN c > 0 AND dist / c > 0 THEN dist / c END
 WHEN c * c + 2 * a * dist < 0 THEN NULL
 WHEN least(r1, r2) > 1E-6 THEN least(r1, r2) WHEN greatest(r1, r2) > 1E-6 THEN greatest(r1, r2) END AS ttc
FROM (SELECT *, CASE WHEN abs(a) >= 1E-6 AND c * c + 2 * a * dist >= 0 THEN (-c + sqrt(c * c + 2 * a * dist)) / a END AS r1,
  CASE WHEN abs(a) >= 1E-6 AND c * c + 2 * a * dist >= 0 THEN (-c - sqrt(c * c + 2 * a * dist)) / a END AS r2
 FROM (SELECT scene_id, frameNum, ego, tgt, dist, s1 * cos(radians(h1) - along) - s2 * cos(radians(h2) - along) + radians(yaw1 + yaw2) * dist AS c,
   accel1 * cos(radians(h1) - along) - accel2 * cos(radians(h2) - along) AS a
  FROM (SELECT *, atan2(dy, dx) AS along FROM (
   SELECT /*+ SHUFFLE_HASH(b) */ a.scene_id, a.frameNum, a.carId AS ego, b.carId AS tgt, b.carCenterXm - a.carCenterXm AS dx, b.carCenterYm - a.carCenterYm AS dy,
    sqrt((b.carCenterXm - a.carCenterXm) * (b.carCenterXm - a.carCenterXm) + (b.carCenterYm - a.carCenterYm) * (b.carCenterYm - a.carCenterYm)) AS dist,
    a.heading AS h1, b.heading AS h2, a.speed AS s1, b.speed AS s2, a.accel AS accel1, b.accel AS accel2, a.yaw AS yaw1, b.yaw AS yaw2
   FROM (SELECT *, cos(radians(heading)) AS hx, sin(radians(heading)) AS hy FROM {kinematics_rows}) AS a JOIN {kinematics_rows} b ON a.scene_id = b.scene_id AND a.frameNum = b.frameNum AND a.carId <> b.carId
   WHERE (b.carCenterXm - a.carCenterXm) * a.hx + (b.carCenterYm - a.carCenterYm) * a.hy >= 0) AS p WHERE dist > 0 AND dist <= <reach>) AS w) AS q) AS r""")
put("box_pairs", ("SELECT a.scene_id", "SELECT /*+ SHUFFLE_HASH(b) */ a.scene_id"))
#: Pairs that have a time to collision: boxes overlap or their strips meet. The number of the task keeps the test above the columns that it reads.
put("box_pairs_meet", ("SELECT a.scene_id", "SELECT /*+ SHUFFLE_HASH(b) */ a.scene_id"),
    (f", {B.corners()} FROM (", f", {B.corners()} FROM (SELECT * FROM (SELECT *, {B.overlap()} AS overlap, {B.strips_meet()} AS strips, spark_partition_id() AS task FROM ("),
    (f"SELECT *, {B.overlap()} AS overlap, {B.strips_meet()} AS strips, {B.corners()}", f"SELECT *, {B.corners()}"),
    (") AS r) AS c)", ") AS r) AS t WHERE (overlap OR strips) AND task >= 0) AS s) AS c)"), sql=PLANS.plans["box_pairs"].sql)
put("ttc_obb_meet", ("{box_pairs}", "{box_pairs_meet}"), ("SELECT scene_id, frameNum, ego, tgt, dist, CASE", "SELECT spark_partition_id() AS task, scene_id, frameNum, ego, tgt, dist, CASE"), sql=PLANS.plans["ttc_obb_rows"].sql)
#: Pairs that can come together within the threshold. Boxes are as far apart as their middles less their radii, at least, and come nearer
#: by both speeds, by both accelerations and, as distances weigh the yaw rates, by those, at most; what is left out has no smaller time.
_APART = "(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) - a.radius - b.radius)"
put("box_pairs_close", ("AND <reach>", f"AND <reach> AND ({_APART} <= 0 OR coalesce({_APART} * (1 - radians(abs(a.yaw) + abs(b.yaw)) * <ttc>) <= 1E-3 + 1.001E0 * (abs(a.speed) + abs(b.speed) + (abs(a.accel) + abs(b.accel)) * <ttc> / 2) * <ttc>, TRUE))"),
    ("{boxes}", "(SELECT *, sqrt(lx * lx + ly * ly) + sqrt(wx * wx + wy * wy) AS radius FROM {boxes})"), sql=PLANS.by_scene["box_pairs_meet"].sql)
put("ttc_obb_close", ("{box_pairs_meet}", "{box_pairs_close}"), sql=PLANS.by_scene["ttc_obb_meet"].sql)
put("conflict_frames", ("{ttc_obb_rows} WHERE", "{ttc_obb_close} WHERE task >= 0 AND"))
put("conflict_islands", ("{conflict_frames}", "(SELECT scene_id, frameNum, ego, tgt FROM {ttc_obb_close} WHERE task >= 0 AND ttc < <ttc>)"))
put("ttc_smoothness", ("{ttc_obb_rows} WHERE", "{ttc_obb_meet} WHERE task >= 0 AND"))
#: Each pair is seen once as the first car's and once as the second's; a pair's measures are those of its ego.
put("kinematics_compat", sql="""
SELECT scene_id, ego, count(CASE WHEN who = 1 THEN 1 END) AS n, count(CASE WHEN who = 1 AND accel <> 0 THEN 1 END) AS moved, round(max(CASE WHEN who = 1 THEN accel END), 3) AS most_accel, round(max(CASE WHEN who = 2 THEN abs(yaw) END), 3) AS most_yaw FROM (
 SELECT scene_id, ego, who, coalesce((v - lag(v) OVER w) * <fps>, 0.0E0) AS accel, coalesce(((((h - lag(h) OVER w + 180) % 360) + 360) % 360 - 180) * <fps>, 0.0E0) AS yaw FROM (
  SELECT scene_id, frameNum, ego, tgt, inline(array(named_struct('who', 1, 'car', ego, 'v', s1, 'h', h1), named_struct('who', 2, 'car', tgt, 'v', s2, 'h', h2))) FROM (
   SELECT scene_id, frameNum, ego, tgt, s1, h1, s2, h2 FROM {box_pairs_meet} WHERE strips AND NOT overlap) AS b) AS e
 WINDOW w AS (PARTITION BY scene_id, car ORDER BY frameNum, ego, tgt)) AS k GROUP BY scene_id, ego""")
put("safe_frames", ("SELECT t.scene_id", "SELECT /*+ SHUFFLE_HASH(c) */ t.scene_id"))
#: An island is known by its scene, cars and start, so those that stay need not be looked up among all of them again.
put("conflicts_kept", ("SELECT c.scene_id, ego, tgt, start_frame FROM", "SELECT c.scene_id, ego, tgt, start_frame, t_conflict FROM"), sql=PLANS.plans["conflict_downsample"].sql)
put("candidates_union", ("{conflict_islands} c JOIN {conflict_downsample} d ON c.scene_id = d.scene_id AND c.ego = d.ego AND c.tgt = d.tgt AND c.start_frame = d.start_frame", "{conflicts_kept} c"))
#: Of a scene's conflicts as many stay as its other rows allow, so their numbers are enough.
put("rebalance_report", sql="""
SELECT scene_id, nc, nn, round(nc / CAST(greatest(nn, 1) AS DOUBLE), 6) AS ratio FROM (
 SELECT coalesce(c.scene_id, k.scene_id) AS scene_id, CASE WHEN k.n IS NULL THEN coalesce(c.n, 0) ELSE least(coalesce(c.n, 0), greatest(k.n, CAST(floor(k.n * <ratio>) AS BIGINT))) END AS nc, coalesce(k.n, 0) AS nn
 FROM (SELECT scene_id, count(*) AS n FROM {conflict_islands} GROUP BY scene_id) AS c FULL OUTER JOIN (SELECT scene_id, count(*) AS n FROM {nonconflict_sample} GROUP BY scene_id) AS k ON c.scene_id = k.scene_id) AS g""")
put("windows_valid", ("SELECT c.scene_id", "SELECT /*+ SHUFFLE_HASH(c) */ c.scene_id"))
#: Neighbours are looked for in the frames of an event's ego only.
put("votes_by_scene", sql="""
SELECT scene_id, event_id, t0, tgt AS neighbor, slot, count(*) AS votes, min(frameNum) AS first_seen, round(min(dist), 4) AS nearest, max(CASE WHEN tgt = target THEN 1 ELSE 0 END) AS is_target FROM (
 """ + PLANS.plans["neighbor_pairs"].sql.replace("SELECT scene_id", "SELECT event_id, t0, target, scene_id").replace("(SELECT a.scene_id", "(SELECT /*+ SHUFFLE_HASH(b) */ a.event_id, a.t0, a.target, a.scene_id").replace("{dedup_first} a ", """(
  SELECT /*+ SHUFFLE_HASH(e) */ t.*, e.event_id, e.t0, e.tgt AS target FROM {dedup_first} t JOIN {events} e ON t.scene_id = e.scene_id AND t.carId = e.ego AND t.frameNum BETWEEN CAST(floor(e.t0 - <history>) AS BIGINT) AND CAST(floor(e.t0) AS BIGINT)) AS a """) + """) AS n
WHERE slot IN (<slots>) GROUP BY scene_id, event_id, t0, tgt, slot""")
put("neighbor_votes", sql="SELECT event_id, neighbor, slot, votes, first_seen, nearest FROM {votes_by_scene}")
put("roles_by_scene", sql="SELECT scene_id, event_id, t0, neighbor, slot AS role, votes, is_target FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, event_id, neighbor ORDER BY votes DESC, first_seen) AS place FROM {votes_by_scene}) AS v WHERE place = 1")
put("neighbor_roles", sql="SELECT event_id, neighbor, role, votes FROM {roles_by_scene}")
#: A target's role is that of its own votes, so other neighbours are not looked at for it.
put("target_votes", ("a.carId <> b.carId)", "a.carId <> b.carId AND b.carId = a.target)"), sql=PLANS.by_scene["votes_by_scene"].sql)
put("target_roles", ("{votes_by_scene}", "{target_votes}"), sql=PLANS.by_scene["roles_by_scene"].sql)
put("event_labels", ("{neighbor_roles} r ON e.event_id", "{target_roles} AS r ON e.scene_id = r.scene_id AND e.event_id"), ("SELECT e.event_id", "SELECT /*+ SHUFFLE_HASH(r) */ e.event_id"))
#: The neighbours of an event are held together, so whether its target is one of them is seen without votes being counted twice.
put("event_members", sql="""
SELECT scene_id, event_id, t0, inline(concat(array(named_struct('carId', ego, 'role', 'ego')), coalesce(near, array()), CASE WHEN tgt IS NULL OR exists(coalesce(near, array()), x -> x.carId = tgt) THEN array() ELSE array(named_struct('carId', tgt, 'role', 'other')) END)) FROM (
 SELECT /*+ SHUFFLE_HASH(n) */ e.scene_id, e.event_id, e.t0, e.ego, e.tgt, n.near FROM {events} e
 LEFT JOIN (SELECT scene_id, event_id, collect_list(named_struct('carId', neighbor, 'role', role)) AS near FROM {roles_by_scene} GROUP BY scene_id, event_id) AS n ON e.scene_id = n.scene_id AND e.event_id = n.event_id) AS m""")
put("event_rows", sql="""
SELECT /*+ SHUFFLE_HASH(m) */ m.scene_id, m.event_id, m.carId, m.role, t.frameNum, (t.frameNum - m.t0) / <fps> AS t_rel, t.carCenterXm, t.carCenterYm, t.heading, t.speed
FROM {dedup_first} t JOIN {event_members} m ON m.scene_id = t.scene_id AND m.carId = t.carId AND t.frameNum >= m.t0 - <history> AND t.frameNum <= m.t0 + <future>""")
for _name in ("event_history_rows", "event_future_rows"):
    put(_name, ("GROUP BY event_id", "GROUP BY scene_id, event_id"))
#: A car has one role in an event.
put("first_roles", sql="SELECT event_id, carId, role FROM {event_rows} GROUP BY scene_id, event_id, carId, role")
put("semi_filter_data", ("SELECT r.event_id", "SELECT /*+ SHUFFLE_HASH(k) */ r.event_id"), ("ON r.event_id", "ON r.scene_id = k.scene_id AND r.event_id"), ("GROUP BY r.event_id", "GROUP BY r.scene_id, r.event_id"))
#: An ego is a member by its event alone.
put("ego_rows", ("{event_members}", "(SELECT scene_id, event_id, t0, ego AS carId, 'ego' AS role FROM {events})"), sql=PLANS.by_scene["event_rows"].sql)
put("ego_ref", ("SELECT event_id", "SELECT scene_id, event_id"), ("PARTITION BY event_id", "PARTITION BY scene_id, event_id"), ("{event_rows}", "{ego_rows}"))
#: Labels are one row an event, with its scene and kind; their other columns are not asked for here.
put("rebalance_labels", sql="""
SELECT event_id, scene_id, is_conflict FROM (
 SELECT event_id, scene_id, is_conflict, count(CASE WHEN is_conflict = 1 THEN 1 END) OVER (PARTITION BY scene_id) AS nc, count(CASE WHEN is_conflict = 0 THEN 1 END) OVER (PARTITION BY scene_id) AS nn,
  row_number() OVER (PARTITION BY scene_id, is_conflict ORDER BY (event_id * 7919 + <seed>) % 1000003, event_id) AS place FROM {events}) AS r
WHERE nc = 0 OR nn = 0 OR place <= CASE WHEN is_conflict = 1 THEN greatest(nn, CAST(floor(nn * <ratio>) AS BIGINT)) ELSE greatest(nc, CAST(floor(nc / <ratio>) AS BIGINT)) END""")
put("slots_by_scene", ("SELECT event_id, role, slot", "SELECT scene_id, event_id, role, slot"), ("SELECT h.event_id", "SELECT /*+ SHUFFLE_HASH(e) */ h.scene_id, h.event_id"), ("PARTITION BY h.event_id", "PARTITION BY h.scene_id, h.event_id"),
    ("(SELECT event_id, role, carId", "(SELECT scene_id, event_id, role, carId"), ("GROUP BY event_id, role, carId", "GROUP BY scene_id, event_id, role, carId"), ("ON h.event_id", "ON h.scene_id = e.scene_id AND h.event_id"), sql=PLANS.plans["slot_assignment"].sql)
put("slot_assignment", sql="SELECT event_id, role, slot, carId, n_frames FROM {slots_by_scene}")
#: The cars of each event's slots, with its last frame of history and the frames before it in which no car is seen: what a frame's place from
#: the right takes. One pass over the event's rows gives all of it.
put("event_cars", sql="SELECT scene_id, event_id, role, carId, count(*) AS n_frames, collect_list(frameNum) AS frames FROM {event_rows} WHERE t_rel <= 0 GROUP BY scene_id, event_id, role, carId")
put("event_frames", sql="""
SELECT scene_id, event_id, cars, array_max(seen) AS top, array_except(sequence(array_min(seen), array_max(seen)), seen) AS missing
FROM (SELECT scene_id, event_id, collect_list(named_struct('role', role, 'carId', carId, 'n_frames', n_frames)) AS cars, array_distinct(flatten(collect_list(frames))) AS seen FROM {event_cars} GROUP BY scene_id, event_id) AS f""")
put("seats", sql="""
SELECT scene_id, event_id, slot, carId, t0, top, missing, ref_x, ref_y, ref_heading FROM (
 SELECT /*+ BROADCAST(s) */ h.*, s.slot, row_number() OVER (PARTITION BY h.scene_id, h.event_id, s.slot ORDER BY CASE WHEN h.carId = h.tgt THEN 0 ELSE 1 END, h.n_frames DESC, h.carId) AS place
 FROM (SELECT scene_id, event_id, t0, tgt, top, missing, ref_x, ref_y, ref_heading, inline(cars) FROM (
  SELECT /*+ SHUFFLE_HASH(e), SHUFFLE_HASH(r) */ f.scene_id, f.event_id, f.cars, f.top, f.missing, e.t0, e.tgt, r.ref_x, r.ref_y, r.ref_heading FROM {event_frames} f
  JOIN {events} e ON f.scene_id = e.scene_id AND f.event_id = e.event_id JOIN {ego_ref} r ON f.scene_id = r.scene_id AND f.event_id = r.event_id) AS k) AS h
 JOIN (VALUES ('ego', 0), ('front', 1), ('rear', 2), ('left_front', 3), ('left_rear', 4), ('right_front', 5), ('right_rear', 6)) AS s(name, slot) ON h.role = s.name) AS a WHERE place = 1""")
put("tensor_rows", sql=PLANS.plans["tensor_rows"].sql.split("\nFROM")[0].replace("SELECT h.event_id, s.slot", "SELECT h.scene_id, h.event_id, h.slot").replace("r.ref_", "h.ref_") + """
FROM (SELECT /*+ SHUFFLE_HASH(s) */ s.*, t.carCenterXm, t.carCenterYm, t.heading, t.speed, CAST(s.top - t.frameNum + 1 - size(filter(s.missing, x -> x > t.frameNum)) AS INT) AS back
 FROM {dedup_first} t JOIN {seats} s ON t.scene_id = s.scene_id AND t.carId = s.carId AND t.frameNum >= s.t0 - <history> AND t.frameNum <= s.t0) AS h WHERE h.back <= <history>""")
for _name in ("tensor_long", "mc_mean_se"):
    put(_name, ("GROUP BY event_id", "GROUP BY scene_id, event_id"))
put("seen", sql="SELECT scene_id, event_id, slot, count(t) AS valid, count(CASE WHEN t >= <history> / 2 THEN 1 END) AS in_later_half, min(sqrt(dx * dx + dy * dy)) AS dist FROM {tensor_rows} GROUP BY scene_id, event_id, slot")
put("valid_counts", sql="SELECT s.event_id, s.slot, coalesce(t.valid, 0) AS valid, coalesce(t.in_later_half, 0) AS in_later_half FROM {slots_by_scene} s LEFT JOIN {seen} t ON s.scene_id = t.scene_id AND s.event_id = t.event_id AND s.slot = t.slot")
put("dead_events", ("SELECT DISTINCT event_id FROM {tensor_rows}", "SELECT DISTINCT scene_id, event_id FROM {seen}"), ("ON e.event_id", "ON e.scene_id = v.scene_id AND e.event_id"))
put("agent_risk", sql="SELECT scene_id, event_id, slot, dist, 1.0E0 / (1.0E0 + dist) AS risk FROM {seen} WHERE slot > 0")
#: Only an event's number and kind are asked of its label.
put("scores", ("{event_labels}", "{events}"), ("SELECT event_id, min(dist)", "SELECT scene_id, event_id, min(dist)"), ("GROUP BY event_id", "GROUP BY scene_id, event_id"), ("ON l.event_id", "ON l.scene_id = s.scene_id AND l.event_id"))
put("cells", ("PARTITION BY event_id", "PARTITION BY scene_id, event_id"), ("(\n SELECT event_id", "(\n SELECT scene_id, event_id"), ("GROUP BY event_id", "GROUP BY scene_id, event_id"))
#: A segment's cells are its four channels, so their spreads are taken side by side.
put("psi", sql="""
SELECT scene_id, event_id, agent, seg, inline(array(named_struct('channel', 0, 'psi', d0 / (1.0E0 + dist)), named_struct('channel', 1, 'psi', d1 / (1.0E0 + dist)), named_struct('channel', 2, 'psi', d2 / (1.0E0 + dist)), named_struct('channel', 3, 'psi', d3 / (1.0E0 + dist)))) FROM (
 SELECT scene_id, event_id, slot AS agent, CAST(floor(t / 20) AS BIGINT) AS seg, min(sqrt(dx * dx + dy * dy)) AS dist, max(dx) - min(dx) AS d0, max(dy) - min(dy) AS d1, max(dh) - min(dh) AS d2, max(speed) - min(speed) AS d3
 FROM {tensor_rows} GROUP BY scene_id, event_id, slot, CAST(floor(t / 20) AS BIGINT)) AS s""")
put("psi_grouping_sets", ("GROUPING SETS ((event_id, agent, seg), (event_id, agent), (event_id, seg), (event_id, channel))", "GROUPING SETS ((scene_id, event_id, agent, seg), (scene_id, event_id, agent), (scene_id, event_id, seg), (scene_id, event_id, channel))"))
put("players", ("SELECT event_id", "SELECT scene_id, event_id"), ("PARTITION BY event_id", "PARTITION BY scene_id, event_id"))
put("game_values", ("SELECT p.event_id", "SELECT p.scene_id, p.event_id"), ("GROUP BY p.event_id", "GROUP BY p.scene_id, p.event_id"))
put("exact_shapley", ("SELECT p.event_id", "SELECT /*+ BROADCAST(w) */ p.event_id"), ("ON a.event_id", "ON a.scene_id = p.scene_id AND a.event_id"), ("ON b.event_id", "ON b.scene_id = a.scene_id AND b.event_id"), ("GROUP BY p.event_id", "GROUP BY p.scene_id, p.event_id"))
