"""Cells of (agent, segment, channel), exact games over coalitions, roll-ups, and measures of a baseline's predictions.

The baseline scores what the event tensor shows: how near each agent comes to the ego within the window. The game that is solved exactly
has the event's agents as players and is worth the risk of the nearest one of them. Games over a model's outputs are in games.py.
"""

from math import comb

from ..plans.templates import PLANS

add = PLANS.add

#: Weights of a coalition of s players out of n: 1 / (n * binomial(n - 1, s)).
MOST_PLAYERS = 16
add("shapley_weights", "SELECT * FROM (VALUES " + ", ".join(f"({n}, {s}, {1 / (n * comb(n - 1, s)):.17f}E0)" for n in range(1, MOST_PLAYERS + 1) for s in range(n)) + ") AS w(n, s, weight)")
#: Segments of 20 frames, counted from the right end; a cell for each of the four channels (dx, dy, heading, speed) of what is observed.
add("cells", """
SELECT event_id, agent, seg, channel, frames, first_t, row_number() OVER (PARTITION BY event_id ORDER BY agent, seg, channel) - 1 AS cell_id FROM (
 SELECT event_id, slot AS agent, CAST(floor(t / 20) AS BIGINT) AS seg, count(*) AS frames, min(t) AS first_t FROM {tensor_rows} GROUP BY event_id, slot, CAST(floor(t / 20) AS BIGINT)) AS a
JOIN (VALUES (0), (1), (2), (3)) AS c(channel) ON 1 = 1""")
#: Each cell's part in the risk: how much its channel changes over the segment, by how near the agent is then.
add("psi", """
SELECT c.event_id, c.agent, c.seg, c.channel, c.cell_id, s.spread / (1.0E0 + s.dist) AS psi FROM {cells} c JOIN (
 SELECT event_id, slot AS agent, CAST(floor(t / 20) AS BIGINT) AS seg, k.channel, min(sqrt(dx * dx + dy * dy)) AS dist,
  max(CASE k.channel WHEN 0 THEN dx WHEN 1 THEN dy WHEN 2 THEN dh ELSE speed END) - min(CASE k.channel WHEN 0 THEN dx WHEN 1 THEN dy WHEN 2 THEN dh ELSE speed END) AS spread
 FROM {tensor_rows} JOIN (VALUES (0), (1), (2), (3)) AS k(channel) ON 1 = 1 GROUP BY event_id, slot, CAST(floor(t / 20) AS BIGINT), k.channel) AS s
ON c.event_id = s.event_id AND c.agent = s.agent AND c.seg = s.seg AND c.channel = s.channel""")
add("psi_grouping_sets", "SELECT event_id, agent, seg, channel, round(sum(psi), 4) AS psi FROM {psi} GROUP BY GROUPING SETS ((event_id, agent, seg), (event_id, agent), (event_id, seg), (event_id, channel))")
add("top_agent", "SELECT event_id, agent, psi FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(psi) DESC, agent) AS place FROM {psi_grouping_sets} WHERE agent IS NOT NULL AND seg IS NULL) AS a WHERE place = 1")
add("top_segment", "SELECT event_id, seg, psi FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(psi) DESC, seg) AS place FROM {psi_grouping_sets} WHERE agent IS NULL AND seg IS NOT NULL) AS a WHERE place = 1")
add("risk_timeline_cumsum", "SELECT event_id, seg, round(sum(psi) OVER (PARTITION BY event_id ORDER BY seg ROWS UNBOUNDED PRECEDING), 4) AS risk FROM {psi_grouping_sets} WHERE agent IS NULL AND seg IS NOT NULL")
#: How near each agent comes to the ego over the window, and the risk of that.
add("agent_risk", "SELECT event_id, slot, min(sqrt(dx * dx + dy * dy)) AS dist, 1.0E0 / (1.0E0 + min(sqrt(dx * dx + dy * dy))) AS risk FROM {tensor_rows} WHERE slot > 0 GROUP BY event_id, slot")
#: Worth of every coalition of an event's agents: the most that one of its members risks; m has a bit for each member, by rank.
add("coalitions", "SELECT id AS m FROM range(0, 64)", ("id AS m FROM range(0, 64)", "UNNEST(range(0, 64)) AS m"))
add("players", "SELECT event_id, slot, risk, row_number() OVER (PARTITION BY event_id ORDER BY slot) - 1 AS player, count(*) OVER (PARTITION BY event_id) AS n FROM {agent_risk}")
add("game_values", """
SELECT p.event_id, p.n, c.m, max(CASE WHEN (c.m & CAST(power(2, p.player) AS BIGINT)) <> 0 THEN p.risk ELSE 0.0E0 END) AS v
FROM {players} p JOIN {coalitions} c ON c.m < CAST(power(2, p.n) AS BIGINT) GROUP BY p.event_id, p.n, c.m""")
add("exact_shapley", """
SELECT p.event_id, p.slot, round(sum(w.weight * (b.v - a.v)), 6) AS phi FROM {players} p
JOIN {game_values} a ON a.event_id = p.event_id AND (a.m & CAST(power(2, p.player) AS BIGINT)) = 0
JOIN {game_values} b ON b.event_id = a.event_id AND b.m = a.m + CAST(power(2, p.player) AS BIGINT)
JOIN {shapley_weights} w ON w.n = p.n AND w.s = bit_count(a.m) GROUP BY p.event_id, p.slot""")
#: Worth of all players less that of none, less what they were given: nothing is left.
add("shapley_residual", "SELECT g.event_id, round(abs(max(g.v) - sum(DISTINCT 0) - max(s.phi)), 4) AS residual FROM {game_values} g JOIN (SELECT event_id, sum(phi) AS phi FROM {exact_shapley} GROUP BY event_id) AS s ON g.event_id = s.event_id GROUP BY g.event_id")
#: Mean and standard error over the frames of a segment, as over the chains of a sample.
add("mc_mean_se", "SELECT event_id, slot, count(*) AS n, floor(avg(dx) * 1E3 + 0.4321E0) / 1E3 AS mean, round(CASE WHEN count(*) = 1 THEN 0.0E0 ELSE stddev_samp(dx) / sqrt(count(*)) END, 3) AS se FROM {tensor_rows} GROUP BY event_id, slot")
add("slot_logits", "SELECT t.event_id, t.is_conflict, t.target_idx, r.slot - 1 AS idx, -r.dist / 4.0E0 AS logit FROM {target_idx} t JOIN {agent_risk} r ON t.event_id = r.event_id")
add("scores", "SELECT l.event_id, l.is_conflict AS y, coalesce(2.0E0 - s.dist / 4.0E0, -4.0E0) AS z FROM {event_labels} l LEFT JOIN (SELECT event_id, min(dist) AS dist FROM {agent_risk} GROUP BY event_id) AS s ON l.event_id = s.event_id")
add("bce_loss", "SELECT y, count(*) AS n, round(avg(greatest(z, 0.0E0) - z * y + ln(1 + exp(-abs(z)))), 4) AS loss FROM {scores} GROUP BY y")
#: Cross entropy of the target among the agents that are there, over conflicts whose target has a slot.
add("target_ce_loss", """
SELECT count(*) AS n, round(avg(top + ln(total) - of_target), 4) AS loss FROM (
 SELECT event_id, max(top) AS top, sum(exp(logit - top)) AS total, max(CASE WHEN idx = target_idx THEN logit END) AS of_target FROM (
  SELECT *, max(logit) OVER (PARTITION BY event_id) AS top FROM {slot_logits} WHERE is_conflict = 1 AND target_idx >= 0) AS m GROUP BY event_id) AS e WHERE of_target IS NOT NULL""")
add("confusion_metrics", """
SELECT tp, tn, fp, fn, round((tp + tn) / CAST(greatest(tp + tn + fp + fn, 1) AS DOUBLE), 6) AS accuracy, round(p, 6) AS precision_, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1E-9), 6) AS f1 FROM (
 SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS p, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS r
 FROM (SELECT count(CASE WHEN z >= 0 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN z < 0 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN z >= 0 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN z < 0 AND y = 1 THEN 1 END) AS fn FROM {scores}) AS c) AS m""")
#: Whether the agent of the largest logit is the target, by the target's role; over conflicts whose target has a slot.
add("target_acc_per_role", """
SELECT target_idx, count(*) AS n, round(avg(CASE WHEN idx = target_idx THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY logit DESC, idx) AS place FROM {slot_logits} WHERE is_conflict = 1 AND target_idx >= 0) AS r WHERE place = 1 GROUP BY target_idx""")
#: The mean loss of batches of 32 events, by their sizes.
add("batch_loss", "SELECT count(*) AS batches, round(sum(loss * n) / sum(n), 4) AS loss FROM (SELECT floor(event_id / 32) AS batch, count(*) AS n, avg(greatest(z, 0.0E0) - z * y + ln(1 + exp(-abs(z)))) AS loss FROM {scores} GROUP BY floor(event_id / 32)) AS b")
#: What one agent after another adds, in the order of slots and in the reverse one: worth with it less worth before.
add("marginal_chains", """
SELECT event_id, chain, slot, round(v - coalesce(lag(v) OVER (PARTITION BY event_id, chain ORDER BY step), 0.0E0), 6) AS added FROM (
 SELECT event_id, 0 AS chain, player AS step, slot, max(risk) OVER (PARTITION BY event_id ORDER BY player ROWS UNBOUNDED PRECEDING) AS v FROM {players}
 UNION ALL SELECT event_id, 1, n - player, slot, max(risk) OVER (PARTITION BY event_id ORDER BY player DESC ROWS UNBOUNDED PRECEDING) FROM {players}) AS c""")
