"""The NGSIM format: feet, a global frame and no headings, made into standard columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that tell the format, feet to metres, vehicle classes, frames over which a movement counts.
MARKERS = frozenset(("Vehicle_ID", "Local_X", "Global_X", "v_Vel"))
FOOT = 0.3048
CLASSES = {1: 4, 2: 0, 3: 3}
GAP = 5


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def bearing(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def to_standard(raw: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Standard columns of NGSIM rows. The frame of a scene starts at its west and north ends, with y to the south.

    A vehicle's movement is that to its next row, or from its previous one, at most GAP frames away; heading and course are -1 without.
    """
    meters = lambda c: F.col(c).cast("double") * FOOT
    rows = raw.select(F.col(scene).alias("scene_id"), F.col("Frame_ID").cast("long").alias("frameNum"), F.col("Vehicle_ID").cast("long").alias("carId"), F.col("Lane_ID").alias("laneId"), meters("Global_X").alias("east"), meters("Global_Y").alias("north"), meters("v_Length").alias("long"), meters("v_Width").alias("wide"), meters("v_Vel").alias("speed"), F.col("v_Class").cast("int").alias("kind"))
    ends = rows.groupBy("scene_id").agg(F.min("east").alias("west_end"), F.max("north").alias("north_end"))
    rows = rows.join(ends, "scene_id").withColumns({"x": F.col("east") - F.col("west_end"), "y": F.col("north_end") - F.col("north")})
    own = Window.partitionBy("scene_id", "carId").orderBy("frameNum", "east", "north")
    here = F.struct("frameNum", "x", "y", "east", "north")
    rows = rows.withColumns({"here": here, "next": F.lead(here).over(own), "last": F.lag(here).over(own)})
    ahead, behind = F.col("next.frameNum") - F.col("frameNum") <= GAP, F.col("frameNum") - F.col("last.frameNum") <= GAP

    def change(c: str) -> Column:
        return F.when(ahead, F.col(f"next.{c}") - F.col(f"here.{c}")).when(behind, F.col(f"here.{c}") - F.col(f"last.{c}"))

    rows = rows.withColumns({"heading": F.coalesce(bearing(change("x"), change("y")), F.lit(-1.0)), "course": F.coalesce(F.pmod(F.degrees(F.atan2(change("east"), change("north"))), F.lit(360.0)), F.lit(-1.0))})
    turn = F.radians("heading")
    rows = rows.withColumns({"lx": F.col("long") / 2 * F.cos(turn), "ly": F.col("long") / 2 * F.sin(turn), "wx": F.col("wide") / 2 * F.sin(turn), "wy": -F.col("wide") / 2 * F.cos(turn)})
    out = [F.col(c) for c in ("scene_id", "frameNum", "carId", "laneId")]
    for unit in ("", "m"):  # a pixel is a metre here
        out += [F.col("x").alias(f"carCenterX{unit}"), F.col("y").alias(f"carCenterY{unit}")]
        for k, (forward, right) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1)), 1):
            out += [(F.col(c) + forward * F.col(f"l{c}") + right * F.col(f"w{c}")).alias(f"boundingBox{k}{c.upper()}{unit}") for c in "xy"]
    kind = F.coalesce(*[F.when(F.col("kind") == a, F.lit(b)) for a, b in CLASSES.items()], F.lit(-1))
    return rows.select(*out, "heading", "course", "speed", kind.alias("objClass"), F.lit(-1).alias("carCenterLon"), F.lit(-1).alias("carCenterLat"))


def downsample(tracks: DataFrame) -> DataFrame:
    """From 25 to 10 frames a second: the first and the third of five frames, numbered anew from 0 in each scene; without laneId."""
    kept = tracks.where(F.pmod(F.col("frameNum"), F.lit(5)).isin(0, 2)).drop("laneId")
    numbers = kept.select("scene_id", "frameNum").distinct().withColumn("_new", F.row_number().over(Window.partitionBy("scene_id").orderBy("frameNum")).cast("long") - 1)
    return kept.join(numbers, ["scene_id", "frameNum"]).withColumn("frameNum", F.col("_new")).drop("_new").select(*kept.columns)
