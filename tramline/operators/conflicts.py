"""Pairs of vehicles, time to collision, conflict events and the sampling of their counterparts.

Vehicles on one spot (a distance of 0) are no pair. Time to collision is taken between the nearest points of two boxes: 0 if they overlap,
none if the strips that the boxes sweep ahead of their rear edges do not meet, else the smallest positive root of distance = c t + a t^2 / 2.
"""

from ..functions import boxes as B
from ..plans.templates import PLANS

add = PLANS.add

#: All ordered pairs of a frame within 200 m, with the pose of the second in the frame of the first; one equi-join on (scene, frame).
add("neighbor_pairs", """
SELECT scene_id, frameNum, ego, tgt, dist, lon, lat, dx, dy, h1, h2, s1, s2,
 CASE WHEN lat > <lateral> THEN 'left_' WHEN lat < -<lateral> THEN 'right_' ELSE '' END || CASE WHEN lon >= 0 THEN 'front' ELSE 'rear' END AS slot
FROM (SELECT a.scene_id, a.frameNum, a.carId AS ego, b.carId AS tgt, b.carCenterXm - a.carCenterXm AS dx, b.carCenterYm - a.carCenterYm AS dy,
  sqrt((b.carCenterXm - a.carCenterXm) * (b.carCenterXm - a.carCenterXm) + (b.carCenterYm - a.carCenterYm) * (b.carCenterYm - a.carCenterYm)) AS dist,
  (b.carCenterXm - a.carCenterXm) * cos(radians(a.heading)) + (b.carCenterYm - a.carCenterYm) * sin(radians(a.heading)) AS lon,
  (b.carCenterYm - a.carCenterYm) * cos(radians(a.heading)) - (b.carCenterXm - a.carCenterXm) * sin(radians(a.heading)) AS lat,
  a.heading AS h1, b.heading AS h2, a.speed AS s1, b.speed AS s2
 FROM {dedup_first} a JOIN {dedup_first} b ON a.scene_id = b.scene_id AND a.frameNum = b.frameNum AND a.carId <> b.carId) AS p
WHERE dist > 0 AND dist <= <reach>""")
add("dedup_first", """
SELECT scene_id, frameNum, carId, carCenterXm, carCenterYm, heading, speed FROM (
 SELECT scene_id, frameNum, carId, carCenterXm, carCenterYm, heading, speed,
  row_number() OVER (PARTITION BY scene_id, frameNum, carId ORDER BY carCenterXm, carCenterYm, heading, speed) AS seq FROM {tracks}) AS d WHERE seq = 1""")
add("front_pairs", "SELECT scene_id, ego, count(*) AS n, min(tgt) AS first_tgt, round(min(dist), 4) AS nearest, CAST(sum(frameNum * (7 * tgt + 3) + CAST(floor(dist * 1E2 + 0.5E0) AS BIGINT) % 97) AS BIGINT) AS checksum FROM {neighbor_pairs} WHERE lon >= 0 GROUP BY scene_id, ego")
add("neighbor_pairs_slots", "SELECT scene_id, slot, count(*) AS n, round(min(dist), 4) AS nearest, CAST(sum(frameNum * (7 * tgt + ego)) AS BIGINT) AS checksum FROM {neighbor_pairs} GROUP BY scene_id, slot")
#: Change of speed and heading against the car's own previous row, a frame apart; none on its first.
add("kinematics_rows", """
SELECT scene_id, frameNum, carId, carCenterXm, carCenterYm, heading, speed, coalesce((speed - lag(speed) OVER w) * <fps>, 0.0E0) AS accel,
 coalesce(((((heading - lag(heading) OVER w + 180) % 360) + 360) % 360 - 180) * <fps>, 0.0E0) AS yaw
FROM {dedup_first} WINDOW w AS (PARTITION BY scene_id, carId ORDER BY frameNum)""")
add("kinematics_lag", "SELECT scene_id, carId, count(*) AS n, round(max(accel), 4) AS most_accel, round(min(accel), 4) AS least_accel, round(max(abs(yaw)), 4) AS most_yaw FROM {kinematics_rows} GROUP BY scene_id, carId")
#: Closing speed c and acceleration a along the line of centres; the sum of both yaw rates times the distance adds to c.
add("ttc_rows", """
SELECT scene_id, frameNum, ego, tgt, CASE WHEN c <= 1E-6 AND a <= 1E-6 THEN NULL
 WHEN abs(a) < 1E-6 THEN CASE WHEN c > 0 AND dist / c > 0 THEN dist / c END
 WHEN c * c + 2 * a * dist < 0 THEN NULL
 WHEN least(r1, r2) > 1E-6 THEN least(r1, r2) WHEN greatest(r1, r2) > 1E-6 THEN greatest(r1, r2) END AS ttc
FROM (SELECT *, CASE WHEN abs(a) >= 1E-6 AND c * c + 2 * a * dist >= 0 THEN (-c + sqrt(c * c + 2 * a * dist)) / a END AS r1,
  CASE WHEN abs(a) >= 1E-6 AND c * c + 2 * a * dist >= 0 THEN (-c - sqrt(c * c + 2 * a * dist)) / a END AS r2
 FROM (SELECT p.scene_id, p.frameNum, p.ego, p.tgt, p.dist,
   s1 * cos(radians(h1) - atan2(dy, dx)) - s2 * cos(radians(h2) - atan2(dy, dx)) + radians(k1.yaw + k2.yaw) * dist AS c,
   k1.accel * cos(radians(h1) - atan2(dy, dx)) - k2.accel * cos(radians(h2) - atan2(dy, dx)) AS a
  FROM {neighbor_pairs} p JOIN {kinematics_rows} k1 ON p.scene_id = k1.scene_id AND p.frameNum = k1.frameNum AND p.ego = k1.carId
   JOIN {kinematics_rows} k2 ON p.scene_id = k2.scene_id AND p.frameNum = k2.frameNum AND p.tgt = k2.carId WHERE p.lon >= 0) AS q) AS r""")
add("ttc_center_kernel", "SELECT scene_id, ego, count(*) AS pairs, count(ttc) AS closing, round(min(ttc), 3) AS least_ttc FROM {ttc_rows} GROUP BY scene_id, ego")
#: Boxes by half their length (l, forward) and half their width (w, to the right), with the middle (m) and half (g) of the edge that lies
#: farthest back along the heading (h).
add("boxes", """
SELECT scene_id, frameNum, carId, x, y, heading, speed, accel, yaw, lx, ly, wx, wy, hx, hy, x + CASE WHEN back = 0 THEN -lx WHEN back = 1 THEN lx WHEN back = 2 THEN -wx ELSE wx END AS mx, y + CASE WHEN back = 0 THEN -ly WHEN back = 1 THEN ly WHEN back = 2 THEN -wy ELSE wy END AS my,
 CASE WHEN back < 2 THEN wx ELSE lx END AS gx, CASE WHEN back < 2 THEN wy ELSE ly END AS gy FROM (
 SELECT *, CASE WHEN lx * hx + ly * hy >= abs(wx * hx + wy * hy) THEN 0 WHEN -(lx * hx + ly * hy) >= abs(wx * hx + wy * hy) THEN 1 WHEN wx * hx + wy * hy > 0 THEN 2 ELSE 3 END AS back FROM (
  SELECT scene_id, frameNum, carId, carCenterXm AS x, carCenterYm AS y, heading, speed, accel, yaw, cos(radians(heading)) AS hx, sin(radians(heading)) AS hy,
   <half_length> * cos(radians(heading)) AS lx, <half_length> * sin(radians(heading)) AS ly, <half_width> * sin(radians(heading)) AS wx, -<half_width> * cos(radians(heading)) AS wy FROM {kinematics_rows}) AS h) AS k""")
#: The vector between the nearest points of two boxes, from the ego's to the other's, none if they overlap; strips: whether a collision ahead is possible.
add("box_pairs", f"""
SELECT scene_id, frameNum, ego, tgt, h1, h2, s1, s2, a1, a2, w1, w2, overlap, strips, CASE WHEN NOT overlap THEN {B.nearest("x")} END AS nx, CASE WHEN NOT overlap THEN {B.nearest("y")} END AS ny FROM (
 SELECT *, least(z1, z2, z3, z4, z5, z6, z7, z8) AS near2 FROM (SELECT *, {B.squares()} FROM (SELECT *, {B.overlap()} AS overlap, {B.strips_meet()} AS strips, {B.corners()} FROM (
  SELECT *, {B.frames()} FROM (SELECT *, {B.offsets()} FROM (
   SELECT a.scene_id, a.frameNum, a.carId AS ego, b.carId AS tgt, a.heading AS h1, b.heading AS h2, a.speed AS s1, b.speed AS s2, a.accel AS a1, b.accel AS a2, a.yaw AS w1, b.yaw AS w2, {B.columns("a")}, {B.columns("b")}
   FROM {{boxes}} a JOIN {{boxes}} b ON a.scene_id = b.scene_id AND a.frameNum = b.frameNum AND a.carId <> b.carId
   WHERE (b.x - a.x) * a.hx + (b.y - a.y) * a.hy >= 0 AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) BETWEEN 1E-300 AND <reach>) AS o) AS q) AS r) AS c) AS z) AS n""")
add("ttc_obb_rows", """
SELECT scene_id, frameNum, ego, tgt, dist, CASE WHEN overlap THEN 0.0E0 WHEN NOT strips THEN NULL WHEN c <= 1E-6 AND a <= 1E-6 THEN NULL
 WHEN abs(a) < 1E-6 THEN CASE WHEN c > 0 AND dist > 0 THEN dist / c END
 WHEN least(r1, r2) > 1E-6 THEN least(r1, r2) WHEN greatest(r1, r2) > 1E-6 THEN greatest(r1, r2) END AS ttc
FROM (SELECT *, CASE WHEN abs(a) >= 1E-6 AND c * c + 2 * a * dist >= 0 THEN (-c + sqrt(c * c + 2 * a * dist)) / a END AS r1,
  CASE WHEN abs(a) >= 1E-6 AND c * c + 2 * a * dist >= 0 THEN (-c - sqrt(c * c + 2 * a * dist)) / a END AS r2
 FROM (SELECT scene_id, frameNum, ego, tgt, overlap, strips, CASE WHEN overlap THEN 0.0E0 ELSE sqrt(nx * nx + ny * ny) END AS dist,
   s1 * cos(radians(h1) - along) - s2 * cos(radians(h2) - along) + radians(w1 + w2) * sqrt(nx * nx + ny * ny) AS c, a1 * cos(radians(h1) - along) - a2 * cos(radians(h2) - along) AS a
  FROM (SELECT *, atan2(ny, nx) AS along FROM {box_pairs}) AS p) AS q) AS r""")
add("ttc_obb", "SELECT scene_id, ego, count(*) AS pairs, count(ttc) AS closing, count(CASE WHEN ttc = 0 THEN 1 END) AS touching, round(min(ttc), 3) AS least_ttc, round(min(dist), 3) AS nearest FROM {ttc_obb_rows} GROUP BY scene_id, ego")
#: Kinematics of the order-dependent kind: a car's previous speed and heading are those of the last pair that was evaluated with it, in the order of frames, egos and targets.
add("kinematics_by_pair", """
SELECT scene_id, frameNum, ego, tgt, max(CASE WHEN who = 1 THEN accel END) AS accel1, max(CASE WHEN who = 1 THEN yaw END) AS yaw1, max(CASE WHEN who = 2 THEN accel END) AS accel2, max(CASE WHEN who = 2 THEN yaw END) AS yaw2 FROM (
 SELECT *, coalesce((v - lag(v) OVER w) * <fps>, 0.0E0) AS accel, coalesce(((((h - lag(h) OVER w + 180) % 360) + 360) % 360 - 180) * <fps>, 0.0E0) AS yaw FROM (
  SELECT scene_id, frameNum, ego, tgt, 1 AS who, ego AS car, s1 AS v, h1 AS h FROM {box_pairs} WHERE strips AND NOT overlap
  UNION ALL SELECT scene_id, frameNum, ego, tgt, 2, tgt, s2, h2 FROM {box_pairs} WHERE strips AND NOT overlap) AS e
 WINDOW w AS (PARTITION BY scene_id, car ORDER BY frameNum, ego, tgt)) AS k GROUP BY scene_id, frameNum, ego, tgt""")
add("kinematics_compat", "SELECT scene_id, ego, count(*) AS n, count(CASE WHEN accel1 <> 0 THEN 1 END) AS moved, round(max(accel1), 3) AS most_accel, round(max(abs(yaw2)), 3) AS most_yaw FROM {kinematics_by_pair} GROUP BY scene_id, ego")
add("conflict_frames", "SELECT scene_id, frameNum, ego, tgt, round(ttc, 2) AS ttc FROM {ttc_obb_rows} WHERE ttc < <ttc>")
#: Runs of consecutive conflict frames of a pair; a run's middle element is the conflict.
add("conflict_islands", """
SELECT scene_id, ego, tgt, min(frameNum) AS start_frame, max(frameNum) AS end_frame, min(frameNum) + CAST(floor(count(*) / 2) AS BIGINT) AS t_conflict FROM (
 SELECT scene_id, ego, tgt, frameNum, frameNum - row_number() OVER (PARTITION BY scene_id, ego, tgt ORDER BY frameNum) AS island FROM {conflict_frames}) AS i
GROUP BY scene_id, ego, tgt, island HAVING count(*) >= <least_frames>""")
#: Frames of an ego that are more than 80 away from all its conflicts.
add("safe_frames", """
SELECT t.scene_id, t.carId AS ego, t.frameNum FROM {dedup_first} t LEFT ANTI JOIN {conflict_islands} c
 ON t.scene_id = c.scene_id AND t.carId = c.ego AND t.frameNum BETWEEN c.t_conflict - <margin> AND c.t_conflict + <margin>""", ("LEFT ANTI JOIN", "ANTI JOIN"))
add("safe_frames_antijoin", "SELECT scene_id, ego, count(*) AS n, min(frameNum) AS first_frame, max(frameNum) AS last_frame FROM {safe_frames} GROUP BY scene_id, ego")
#: As many safe frames as conflicts in a scene; egos get shares by their safe frames, one at least; order by a portable hash.
add("nonconflict_sample", """
SELECT scene_id, ego, frameNum FROM (
 SELECT s.scene_id, s.ego, s.frameNum, n, row_number() OVER (PARTITION BY s.scene_id ORDER BY CASE WHEN in_ego <= greatest(1, floor(least(n, total) * own / total)) THEN 0 ELSE 1 END, u, s.ego, s.frameNum) AS place
 FROM (SELECT scene_id, ego, frameNum, u, count(*) OVER (PARTITION BY scene_id, ego) AS own, count(*) OVER (PARTITION BY scene_id) AS total, row_number() OVER (PARTITION BY scene_id, ego ORDER BY u, frameNum) AS in_ego
   FROM (SELECT scene_id, ego, frameNum, (ego * 7919 + frameNum * 104729) % 1000003 AS u FROM {safe_frames}) AS h) AS s
 JOIN (SELECT scene_id, CAST(floor(count(*) * <ratio>) AS BIGINT) AS n FROM {conflict_islands} GROUP BY scene_id) AS k ON s.scene_id = k.scene_id) AS r WHERE place <= n""")
add("conflict_downsample", """
SELECT c.scene_id, ego, tgt, start_frame FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY (ego * 7919 + start_frame * 104729) % 1000003, ego, tgt, start_frame) AS place FROM {conflict_islands}) AS c
 LEFT JOIN (SELECT scene_id, greatest(count(*), CAST(floor(count(*) * <ratio>) AS BIGINT)) AS n FROM {nonconflict_sample} GROUP BY scene_id) AS k ON c.scene_id = k.scene_id WHERE n IS NULL OR place <= n""")
add("candidates_union", """
SELECT c.scene_id, c.ego, 1 AS is_conflict, c.tgt, c.start_frame, c.t_conflict, c.t_conflict - <future> + <future> * CAST((c.ego * 7919 + c.t_conflict * 104729) % 1000003 AS DOUBLE) / 1000003.0E0 AS t0
 FROM {conflict_islands} c JOIN {conflict_downsample} d ON c.scene_id = d.scene_id AND c.ego = d.ego AND c.tgt = d.tgt AND c.start_frame = d.start_frame
UNION ALL SELECT scene_id, ego, 0, CAST(NULL AS BIGINT), frameNum, CAST(NULL AS BIGINT), CAST(frameNum AS DOUBLE) FROM {nonconflict_sample}""")
add("rebalance_report", """
SELECT scene_id, count(CASE WHEN is_conflict = 1 THEN 1 END) AS nc, count(CASE WHEN is_conflict = 0 THEN 1 END) AS nn,
 round(count(CASE WHEN is_conflict = 1 THEN 1 END) / CAST(greatest(count(CASE WHEN is_conflict = 0 THEN 1 END), 1) AS DOUBLE), 6) AS ratio FROM {candidates_union} GROUP BY scene_id""")
add("ttc_percentiles", """
SELECT scene_id, count(*) AS n, floor(percentile(ttc, 0.5) * 1E2 + 0.01E0) / 1E2 AS median, floor(percentile(ttc, 0.75) * 1E2 + 0.01E0) / 1E2 AS p75, floor(percentile(ttc, 0.9) * 1E2 + 0.01E0) / 1E2 AS p90, floor(percentile(ttc, 0.95) * 1E2 + 0.01E0) / 1E2 AS p95, floor(percentile(ttc, 0.99) * 1E2 + 0.01E0) / 1E2 AS p99,
 count(CASE WHEN ttc < 0.5E0 THEN 1 END) AS below_half, count(CASE WHEN ttc < 1.0E0 THEN 1 END) AS below_one FROM {conflict_frames} GROUP BY scene_id""", ("percentile(", "quantile_cont("))
#: Steps between consecutive valid values of a pair with 20 of them and more.
add("ttc_smoothness", """
SELECT scene_id, ego, tgt, count(*) AS n, round(min(ttc), 2) AS least, round(max(ttc), 2) AS most, round(avg(ttc), 2) AS mean, round(stddev_pop(ttc), 2) AS spread, round(avg(step), 2) AS mean_step, round(max(step), 2) AS most_step,
 round(avg(CASE WHEN step IS NULL THEN NULL WHEN step < 0.5E0 THEN 1.0E0 ELSE 0.0E0 END), 4) AS below_half FROM (
 SELECT scene_id, ego, tgt, ttc, abs(ttc - lag(ttc) OVER (PARTITION BY scene_id, ego, tgt ORDER BY frameNum)) AS step FROM {ttc_obb_rows} WHERE ttc > 0 AND ttc < 100) AS t
GROUP BY scene_id, ego, tgt HAVING count(*) >= 20""")
#: The pairs of most values, and in each scene the smoothest and the roughest one.
add("ttc_top_pairs", "SELECT scene_id, ego, tgt, n FROM {ttc_smoothness} ORDER BY n DESC, scene_id, ego, tgt LIMIT 15")
add("ttc_extreme_pairs", "SELECT scene_id, max(CASE WHEN up = 1 THEN ego END) AS rough_ego, max(CASE WHEN up = 1 THEN tgt END) AS rough_tgt, max(CASE WHEN down = 1 THEN ego END) AS smooth_ego, max(CASE WHEN down = 1 THEN tgt END) AS smooth_tgt FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY mean_step DESC, ego, tgt) AS up, row_number() OVER (PARTITION BY scene_id ORDER BY mean_step, ego, tgt) AS down FROM {ttc_smoothness}) AS r GROUP BY scene_id")
