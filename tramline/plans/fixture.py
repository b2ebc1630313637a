"""A trajectory table derived from customers: scenes of 20 cars, 150 frames at 10 frames a second, with missing frames and late entries."""

from .templates import PLANS

PLANS.add("frames", "SELECT id AS f FROM range(0, 150)", ("id AS f FROM range(0, 150)", "UNNEST(range(0, 150)) AS f"))
PLANS.add("tracks", """
SELECT CONCAT('S', CAST(CAST((c - c % 20) / 20 AS INT) AS STRING)) AS scene_id, f AS frameNum, c AS carId,
 CASE WHEN lane = 2 THEN 180.0E0 + j WHEN lane = 3 THEN 420.0E0 - s ELSE s END AS carCenterXm,
 CASE WHEN lane = 0 THEN j WHEN lane = 1 THEN 3.5E0 + j WHEN lane = 2 THEN s - 140.0E0 ELSE 7.0E0 + j END AS carCenterYm,
 CASE WHEN lane = 2 THEN 90.0E0 WHEN lane = 3 THEN 180.0E0 ELSE 0.0E0 END AS heading, speed, 0 AS objClass
FROM (SELECT c, f, lane, j, v0 + a * t AS speed, s0 + v0 * t + 0.5E0 * a * t * t AS s
 FROM (SELECT CAST(c_custkey AS BIGINT) AS c, f, CAST(f AS DOUBLE) / 10.0E0 AS t, 5.0E0 + CAST((c_custkey * 7) % 11 AS DOUBLE) AS v0,
  CAST((c_custkey * 3) % 7 - 3 AS DOUBLE) * 0.0625E0 AS a, c_custkey % 4 AS lane,
  CAST((c_custkey % 20 - c_custkey % 4) / 4 AS DOUBLE) * 47.3E0 + CAST(c_custkey % 20 AS DOUBLE) * 1.0131E0 AS s0, CAST(c_custkey % 20 AS DOUBLE) * 0.0173E0 AS j
  FROM {customer} CROSS JOIN {frames} WHERE (c_custkey % 5 <> 0 OR f >= 30) AND (c_custkey + f) % 41 <> 0) AS k) AS p
""", ("STRING", "VARCHAR"))
