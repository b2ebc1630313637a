"""Windows, neighbourhoods, event tables, splits and features of events."""

from ..plans.templates import PLANS

add = PLANS.add

#: Candidates whose ego is seen over the 80 frames of history, without two frames missing in a row, and in the 30 frames after it.
add("windows_valid", """
SELECT scene_id, ego, is_conflict, tgt, start_frame, t_conflict, t0 FROM (
 SELECT c.scene_id, c.ego, c.is_conflict, c.tgt, c.start_frame, c.t_conflict, c.t0, min(t.frameNum) AS lo, max(t.frameNum) AS hi,
  max(CASE WHEN t.before >= c.t0 - <history> AND t.frameNum <= c.t0 THEN t.frameNum - t.before END) AS gap, max(CASE WHEN t.frameNum > c.t0 AND t.frameNum <= c.t0 + <future> THEN 1 ELSE 0 END) AS ahead
 FROM {candidates_union} c JOIN (SELECT scene_id, carId, frameNum, lag(frameNum) OVER (PARTITION BY scene_id, carId ORDER BY frameNum) AS before FROM {dedup_first}) AS t
  ON c.scene_id = t.scene_id AND c.ego = t.carId GROUP BY c.scene_id, c.ego, c.is_conflict, c.tgt, c.start_frame, c.t_conflict, c.t0) AS w
WHERE lo <= t0 - <history> AND hi >= t0 AND coalesce(gap, 0) <= 2 AND ahead = 1 AND (t_conflict IS NULL OR (t_conflict > t0 AND t_conflict <= t0 + <future>))""")
#: Numbers from 0 in the order of scenes: places within scenes, which come after one another by their counts.
add("events", """
SELECT w.scene_id, w.ego, w.is_conflict, w.tgt, w.t_conflict, w.t0, base + place - 1 AS event_id FROM (
 SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY is_conflict DESC, start_frame, ego, tgt) AS place FROM {windows_valid}) AS w
 JOIN (SELECT scene_id, CAST(coalesce(sum(n) OVER (ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM (SELECT scene_id, count(*) AS n FROM {windows_valid} GROUP BY scene_id) AS g) AS b
 ON w.scene_id = b.scene_id""")
add("neighbor_votes", """
SELECT e.event_id, p.tgt AS neighbor, p.slot, count(*) AS votes, min(p.frameNum) AS first_seen, round(min(p.dist), 4) AS nearest
FROM {events} e JOIN {neighbor_pairs} p ON e.scene_id = p.scene_id AND e.ego = p.ego AND p.frameNum BETWEEN CAST(floor(e.t0 - <history>) AS BIGINT) AND CAST(floor(e.t0) AS BIGINT) AND p.slot IN (<slots>)
GROUP BY e.event_id, p.tgt, p.slot""")
#: The slot of most votes; of equal ones, that seen first.
add("neighbor_roles", "SELECT event_id, neighbor, slot AS role, votes FROM (SELECT *, row_number() OVER (PARTITION BY event_id, neighbor ORDER BY votes DESC, first_seen) AS place FROM {neighbor_votes}) AS v WHERE place = 1")
add("event_labels", """
SELECT e.event_id, e.scene_id, round(e.t0, 4) AS t0, e.is_conflict, coalesce(e.tgt, -1) AS conflict_target_id, coalesce(r.role, '') AS conflict_target_role, e.t_conflict
FROM {events} e LEFT JOIN {neighbor_roles} r ON e.event_id = r.event_id AND e.tgt = r.neighbor""")
add("event_members", """
SELECT event_id, ego AS carId, 'ego' AS role FROM {events} UNION ALL SELECT event_id, neighbor, role FROM {neighbor_roles}
UNION ALL SELECT e.event_id, e.tgt, 'other' FROM {events} e LEFT ANTI JOIN {neighbor_roles} r ON e.event_id = r.event_id AND e.tgt = r.neighbor WHERE e.tgt IS NOT NULL""", ("LEFT ANTI JOIN", "ANTI JOIN"))
add("event_rows", """
SELECT m.event_id, m.carId, m.role, t.frameNum, (t.frameNum - e.t0) / <fps> AS t_rel, t.carCenterXm, t.carCenterYm, t.heading, t.speed
FROM {event_members} m JOIN {events} e ON m.event_id = e.event_id JOIN {dedup_first} t ON e.scene_id = t.scene_id AND m.carId = t.carId AND t.frameNum >= e.t0 - <history> AND t.frameNum <= e.t0 + <future>""")
add("event_history_rows", "SELECT event_id, role, count(*) AS n, count(DISTINCT carId) AS cars, round(min(t_rel), 4) AS earliest, avg(CAST(floor(speed * 1E4 + 0.5E0) AS BIGINT)) / 1E4 AS mean_speed, CAST(sum(CAST(floor(carCenterXm * 1E2 + 0.5E0) AS BIGINT) % 9973 + 3 * (CAST(floor(carCenterYm * 1E2 + 0.5E0) AS BIGINT) % 9973) + 5 * frameNum + 7 * carId + CAST(floor(heading) AS BIGINT)) AS BIGINT) AS checksum FROM {event_rows} WHERE t_rel <= 0 GROUP BY event_id, role")
add("event_future_rows", "SELECT event_id, role, count(*) AS n, count(DISTINCT carId) AS cars, round(max(t_rel), 4) AS latest, avg(CAST(floor(speed * 1E4 + 0.5E0) AS BIGINT)) / 1E4 AS mean_speed, CAST(sum(CAST(floor(carCenterXm * 1E2 + 0.5E0) AS BIGINT) % 9973 + 3 * (CAST(floor(carCenterYm * 1E2 + 0.5E0) AS BIGINT) % 9973) + 5 * frameNum + 7 * carId + CAST(floor(heading) AS BIGINT)) AS BIGINT) AS checksum FROM {event_rows} WHERE t_rel > 0 GROUP BY event_id, role")
#: Egos in the order of a portable hash; the first four fifths, one at least, train.
add("ego_split", """
SELECT event_id, e.ego, CASE WHEN place <= greatest(1, floor(n * <split>)) THEN 'train' ELSE 'val' END AS split FROM {events} e
JOIN (SELECT ego, row_number() OVER (ORDER BY (ego * 7919) % 1000003, ego) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT ego FROM {events}) AS d) AS o ON e.ego = o.ego""")
add("rebalance_roles", """
SELECT event_id, scene_id, role FROM (SELECT *, min(n) OVER (PARTITION BY scene_id) AS least FROM (
 SELECT event_id, scene_id, role, count(*) OVER (PARTITION BY scene_id, role) AS n, row_number() OVER (PARTITION BY scene_id, role ORDER BY (event_id * 7919) % 1000003, event_id) AS place
 FROM (SELECT event_id, scene_id, CASE WHEN conflict_target_role = '' THEN 'unknown' ELSE conflict_target_role END AS role FROM {event_labels} WHERE is_conflict = 1) AS l) AS c) AS b WHERE place <= least""")
add("ego_ref", """
SELECT event_id, frameNum AS ref_frame, carCenterXm AS ref_x, carCenterYm AS ref_y, heading AS ref_heading, speed AS ref_speed FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN t_rel <= 0 THEN 0 ELSE 1 END, abs(t_rel), frameNum) AS place FROM {event_rows} WHERE role = 'ego') AS r WHERE place = 1""")
add("ego_ref_asof", "SELECT event_id, ref_frame, floor(ref_x * 1E4 + 0.5E0) / 1E4 AS ref_x, floor(ref_y * 1E4 + 0.5E0) / 1E4 AS ref_y, ref_heading, floor(ref_speed * 1E4 + 0.5E0) / 1E4 AS ref_speed FROM {ego_ref}")
#: One car a slot: the conflict's target first, then that of most rows, then the one of the smallest id.
add("slot_assignment", """
SELECT event_id, role, slot, carId, n_frames FROM (
 SELECT h.event_id, h.role, s.slot, h.carId, h.n_frames, row_number() OVER (PARTITION BY h.event_id, s.slot ORDER BY CASE WHEN h.carId = e.tgt THEN 0 ELSE 1 END, h.n_frames DESC, h.carId) AS place
 FROM (SELECT event_id, role, carId, count(*) AS n_frames FROM {event_rows} WHERE t_rel <= 0 GROUP BY event_id, role, carId) AS h
 JOIN (VALUES ('ego', 0), ('front', 1), ('rear', 2), ('left_front', 3), ('left_rear', 4), ('right_front', 5), ('right_rear', 6)) AS s(name, slot) ON h.role = s.name
 JOIN {events} e ON h.event_id = e.event_id) AS a WHERE place = 1""")
add("agent_mask_bits", "SELECT event_id, CAST(bit_or(CAST(power(2, slot) AS BIGINT)) AS BIGINT) AS agent_mask, count(*) AS agents, max(n_frames) AS most_frames FROM {slot_assignment} GROUP BY event_id")
#: Features against the ego at t0, in the last 80 of the frames that the event shows, ranked from the right.
add("tensor_rows", """
SELECT h.event_id, s.slot, <history> - h.back AS t, h.carCenterXm - r.ref_x AS dx, h.carCenterYm - r.ref_y AS dy, CASE WHEN (((h.heading - r.ref_heading) % 360) + 360) % 360 > 180 THEN (((h.heading - r.ref_heading) % 360) + 360) % 360 - 360 ELSE (((h.heading - r.ref_heading) % 360) + 360) % 360 END AS dh, h.speed
FROM (SELECT *, dense_rank() OVER (PARTITION BY event_id ORDER BY frameNum DESC) AS back FROM {event_rows} WHERE t_rel <= 0) AS h
JOIN {slot_assignment} s ON h.event_id = s.event_id AND h.carId = s.carId JOIN {ego_ref} r ON h.event_id = r.event_id WHERE h.back <= <history>""")
add("tensor_long", """
SELECT event_id, slot, count(*) AS valid, min(t) AS first_t, max(t) AS last_t, avg(CAST(floor(dx * 1E3 + 0.5E0) AS BIGINT)) / 1E3 AS mean_dx, avg(CAST(floor(dy * 1E3 + 0.5E0) AS BIGINT)) / 1E3 AS mean_dy,
 avg(CAST(floor(dh * 1E3 + 0.5E0) AS BIGINT)) / 1E3 AS mean_dh, avg(CAST(floor(speed * 1E3 + 0.5E0) AS BIGINT)) / 1E3 AS mean_speed, CAST(sum((t + 1) * (CAST(floor(dx * 1E2 + 0.5E0) AS BIGINT) % 9973)) AS BIGINT) AS checksum FROM {tensor_rows} GROUP BY event_id, slot""")
#: The place of the conflict's target among the six slots beside the ego, -1 if it has none.
add("target_idx", """
SELECT e.event_id, e.is_conflict, coalesce(CAST(s.slot AS BIGINT) - 1, -1) AS target_idx FROM {events} e
LEFT JOIN (SELECT event_id, carId, slot FROM {slot_assignment} WHERE slot > 0) AS s ON e.event_id = s.event_id AND e.is_conflict = 1 AND e.tgt = s.carId""")
#: Observed frames of each agent; 0 for slots that are taken but not seen in the window.
add("valid_counts", """
SELECT s.event_id, s.slot, count(t.t) AS valid, count(CASE WHEN t.t >= <history> / 2 THEN 1 END) AS in_later_half FROM {slot_assignment} s LEFT JOIN {tensor_rows} t ON s.event_id = t.event_id AND s.slot = t.slot GROUP BY s.event_id, s.slot""")
add("dead_events", "SELECT count(*) AS events, count(CASE WHEN v.event_id IS NULL THEN 1 END) AS dead FROM {events} e LEFT JOIN (SELECT DISTINCT event_id FROM {tensor_rows}) AS v ON e.event_id = v.event_id")
#: Neither class has more than ratio times the other's events in a scene; a scene of one class stays.
add("rebalance_labels", """
SELECT event_id, scene_id, is_conflict FROM (
 SELECT event_id, scene_id, is_conflict, nc, nn, row_number() OVER (PARTITION BY scene_id, is_conflict ORDER BY (event_id * 7919 + <seed>) % 1000003, event_id) AS place FROM (
  SELECT l.event_id, l.scene_id, l.is_conflict, nc, nn FROM {event_labels} l JOIN (SELECT scene_id, count(CASE WHEN is_conflict = 1 THEN 1 END) AS nc, count(CASE WHEN is_conflict = 0 THEN 1 END) AS nn FROM {event_labels} GROUP BY scene_id) AS k ON l.scene_id = k.scene_id) AS c) AS r
WHERE nc = 0 OR nn = 0 OR place <= CASE WHEN is_conflict = 1 THEN greatest(nn, CAST(floor(nn * <ratio>) AS BIGINT)) ELSE greatest(nc, CAST(floor(nc / <ratio>) AS BIGINT)) END""")
add("semi_filter_data", """
SELECT r.event_id, count(*) AS n, count(DISTINCT r.carId) AS cars, CAST(sum(r.frameNum) AS BIGINT) AS frames FROM {event_rows} r LEFT SEMI JOIN {rebalance_labels} k ON r.event_id = k.event_id GROUP BY r.event_id""", ("LEFT SEMI JOIN", "SEMI JOIN"))
#: Conflicts with a target beside the ego in scenes of a name, the first 100 by number.
add("select_events_topn", "SELECT event_id, scene_id, conflict_target_role FROM {event_labels} WHERE is_conflict = 1 AND conflict_target_role IN ('front', 'left_front', 'right_front') AND scene_id LIKE '%1%' ORDER BY event_id LIMIT 100")
#: The cars of a scene that are never an event's ego.
add("unused_tracks", "SELECT t.scene_id, count(*) AS cars, CAST(sum(t.carId) AS BIGINT) AS checksum FROM (SELECT DISTINCT scene_id, carId FROM {dedup_first}) AS t LEFT ANTI JOIN (SELECT DISTINCT scene_id, ego FROM {events}) AS u ON t.scene_id = u.scene_id AND t.carId = u.ego GROUP BY t.scene_id", ("LEFT ANTI JOIN", "ANTI JOIN"))
#: All scenes, with those that have no events of a kind.
add("scene_counts", """
SELECT coalesce(c.scene_id, n.scene_id) AS scene_id, coalesce(c.n, 0) AS conflicts, coalesce(n.n, 0) AS others FROM (SELECT scene_id, count(*) AS n FROM {conflict_islands} GROUP BY scene_id) AS c
FULL OUTER JOIN (SELECT scene_id, count(*) AS n FROM {nonconflict_sample} GROUP BY scene_id) AS n ON c.scene_id = n.scene_id""")
#: Last of several rows of a car in a frame, and the first role of a car in an event.
add("dedup_last", "SELECT scene_id, carId, count(*) AS n, CAST(sum(frameNum) AS BIGINT) AS frames, round(max(speed), 4) AS most FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, frameNum, carId ORDER BY carCenterXm DESC, carCenterYm DESC, heading DESC, speed DESC) AS seq FROM {tracks}) AS d WHERE seq = 1 GROUP BY scene_id, carId")
add("first_roles", "SELECT event_id, carId, role FROM (SELECT event_id, carId, role, row_number() OVER (PARTITION BY event_id, carId ORDER BY frameNum, role) AS seq FROM {event_rows}) AS f WHERE seq = 1")
