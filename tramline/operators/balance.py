"""Balancing of finished label tables; which rows stay follows a portable hash of the event's number and the seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def _order(s: Settings) -> list:
    return [F.pmod(F.col("Event_id").cast("long") * 7919 + s.seed, F.lit(1_000_003)), F.col("Event_id").cast("long")]


def _group(labels: DataFrame, s: Settings) -> F.Column:
    return F.col("scene_id") if s.per_scene and "scene_id" in labels.columns else F.lit("all")


def rebalance(labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Labels in which neither class outnumbers the other by more than the target ratio, in each scene; groups of one class stay."""
    s = settings or Settings()
    rows = labels.withColumn("_g", _group(labels, s)).withColumn("_c", F.col("is_conflict").cast("int") == 1)
    counts = rows.groupBy("_g").agg(F.count_if("_c").alias("_nc"), F.count_if(~F.col("_c")).alias("_nn"))
    most = F.when(F.col("_c"), F.greatest("_nn", F.floor(F.col("_nn") * s.target_ratio))).otherwise(F.greatest("_nc", F.floor(F.col("_nc") / s.target_ratio)))
    ranked = rows.withColumn("_p", F.row_number().over(Window.partitionBy("_g", "_c").orderBy(*_order(s)))).join(counts, "_g")
    return ranked.where((F.col("_nc") == 0) | (F.col("_nn") == 0) | (F.col("_p") <= most)).select(*labels.columns)


def balance_roles(labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """As many conflicts of every target role in a scene as its rarest role has; other rows stay, as do scenes of one role."""
    s = settings or Settings()
    if "conflict_target_role" not in labels.columns:
        return labels
    role = F.when(F.coalesce(F.col("conflict_target_role"), F.lit("")) == "", "unknown").otherwise(F.col("conflict_target_role"))
    rows = labels.withColumn("_g", _group(labels, s)).withColumn("_r", F.when(F.col("is_conflict").cast("int") == 1, role))
    counts = rows.where("_r is not null").groupBy("_g", "_r").count().groupBy("_g").agg(F.min("count").alias("_least"))
    ranked = rows.withColumn("_p", F.row_number().over(Window.partitionBy("_g", "_r").orderBy(*_order(s)))).join(counts, "_g", "left")
    return ranked.where(F.col("_r").isNull() | (F.col("_p") <= F.col("_least"))).select(*labels.columns)
