"""Scans and conversions of per-frame tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.templates import PLANS

REQUIRED = ("frameNum", "carId", "carCenterXm", "carCenterYm", "heading", "speed", "objClass")

add = PLANS.add
add("scan_validate", "SELECT scene_id, count(*) AS n, count(DISTINCT carId) AS cars, min(frameNum) AS first_frame, max(frameNum) AS last_frame FROM {tracks} GROUP BY scene_id")
#: Two of five frames, numbered anew without gaps.
add("downsample_25_10", """
SELECT t.scene_id, t.carId, t.frameNum AS old_frame, n.frameNum FROM {tracks} t JOIN (
 SELECT scene_id, f, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY f) - 1 AS BIGINT) AS frameNum FROM (SELECT DISTINCT scene_id, frameNum AS f FROM {tracks} WHERE frameNum % 5 IN (0, 2)) AS d) AS n
ON t.scene_id = n.scene_id AND t.frameNum = n.f""")
#: Feet to metres, from the west and north ends of the scene.
add("ngsim_local_frame", """
SELECT g.scene_id, frameNum, carId, floor((gx * 0.3048E0 - west * 0.3048E0) * 1E4 + 0.5E0) / 1E4 AS x, floor((north * 0.3048E0 - gy * 0.3048E0) * 1E4 + 0.5E0) / 1E4 AS y
FROM (SELECT scene_id, frameNum, carId, carCenterXm / 0.3048E0 AS gx, carCenterYm / 0.3048E0 AS gy FROM {tracks}) AS g
JOIN (SELECT scene_id, min(carCenterXm / 0.3048E0) AS west, max(carCenterYm / 0.3048E0) AS north FROM {tracks} GROUP BY scene_id) AS e ON g.scene_id = e.scene_id""")
#: Heading from the next row of the car within 5 frames, else the previous one, else -1.
add("ngsim_heading_course", """
SELECT scene_id, frameNum, carId, round(CASE WHEN dx IS NULL THEN -1.0E0 ELSE (degrees(atan2(dy, dx)) + 360) % 360 END, 3) AS heading FROM (
 SELECT scene_id, frameNum, carId, CASE WHEN (lead(frameNum) OVER w) - frameNum <= 5 THEN (lead(carCenterXm) OVER w) - carCenterXm WHEN frameNum - (lag(frameNum) OVER w) <= 5 THEN carCenterXm - (lag(carCenterXm) OVER w) END AS dx,
  CASE WHEN (lead(frameNum) OVER w) - frameNum <= 5 THEN (lead(carCenterYm) OVER w) - carCenterYm WHEN frameNum - (lag(frameNum) OVER w) <= 5 THEN carCenterYm - (lag(carCenterYm) OVER w) END AS dy
 FROM {dedup_first} WINDOW w AS (PARTITION BY scene_id, carId ORDER BY frameNum)) AS d""")
#: Front right, front left, rear left and rear right corners of boxes of 4.5 by 2 m.
add("obb_corners", """
SELECT scene_id, frameNum, carId, floor((x + lc + ws) * 1E4 + 0.5E0) / 1E4 AS x1, floor((y + ls - wc) * 1E4 + 0.5E0) / 1E4 AS y1, floor((x + lc - ws) * 1E4 + 0.5E0) / 1E4 AS x2, floor((y + ls + wc) * 1E4 + 0.5E0) / 1E4 AS y2,
 floor((x - lc - ws) * 1E4 + 0.5E0) / 1E4 AS x3, floor((y - ls + wc) * 1E4 + 0.5E0) / 1E4 AS y3, floor((x - lc + ws) * 1E4 + 0.5E0) / 1E4 AS x4, floor((y - ls - wc) * 1E4 + 0.5E0) / 1E4 AS y4
FROM (SELECT scene_id, frameNum, carId, carCenterXm AS x, carCenterYm AS y, <half_length> * cos(radians(heading)) AS lc, <half_length> * sin(radians(heading)) AS ls, <half_width> * cos(radians(heading)) AS wc, <half_width> * sin(radians(heading)) AS ws FROM {tracks}) AS b""")
add("dup_id_counts", "SELECT scene_id, carId, CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT scene_id, carId, frameNum, count(*) AS n FROM {tracks} GROUP BY scene_id, carId, frameNum) AS c GROUP BY scene_id, carId")


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
