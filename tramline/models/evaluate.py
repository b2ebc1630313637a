"""Scores of tensor tables, and losses and measures of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forward import Weights, build_model

#: Events that a worker scores at once.
BATCH = 64
ROLES = ("front", "rear", "left_front", "left_rear", "right_front", "right_rear")


def arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array([[[list(f) for f in a] for a in e] for e in part["x"]], float)
    agents = np.array([[bool(int(m) >> j & 1) for j in range(x.shape[1])] for m in part["agent_mask"]])
    return x, agents, np.array([[list(a) for a in e] for e in part["valid"]], bool)


def score(tensors: DataFrame, model: str, weights: Weights, masked: bool = True) -> DataFrame:
    """event_id, is_conflict, target_idx, conflict_logit and target_logits (null for empty slots) of every event."""
    spark = tensors.sparkSession
    shared, forward = spark.sparkContext.broadcast(weights), build_model(model)  # one model's weights, whatever the data

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), BATCH):
                p = whole.iloc[at : at + BATCH]
                x, agents, valid = arrays(p)
                conflict, target = forward(shared.value, x, agents, ~valid if masked else None)
                yield pd.DataFrame({"event_id": p["event_id"].to_numpy(), "is_conflict": p["is_conflict"].to_numpy(), "target_idx": p["target_idx"].to_numpy(), "conflict_logit": conflict, "target_logits": [[float(v) if np.isfinite(v) else None for v in t] for t in target]})

    return tensors.select("event_id", "is_conflict", "target_idx", "x", "agent_mask", "valid").mapInPandas(run, "event_id long, is_conflict int, target_idx long, conflict_logit double, target_logits array<double>")


def conflict_loss(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def target_loss(logits: Column, target: Column) -> Column:
    """Cross entropy among the slots that are there; null where the target's is not."""
    there = F.filter(logits, lambda v: v.isNotNull())
    top = F.array_max(there)
    total = F.aggregate(F.transform(there, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    return top + F.ln(total) - F.get(logits, target)


def measures(scores: DataFrame, weight: float = 1.0) -> DataFrame:
    """One row: losses, the confusion of predicted and true conflicts, and how often the largest target logit is the target's."""
    y, z = F.col("is_conflict").cast("double"), F.col("conflict_logit")
    has = (F.col("is_conflict") == 1) & (F.col("target_idx") >= 0)
    top = F.array_position(F.col("target_logits"), F.array_max(F.filter("target_logits", lambda v: v.isNotNull()))) - 1
    rows = scores.select(conflict_loss(z, y).alias("c"), F.when(has, target_loss(F.col("target_logits"), F.col("target_idx").cast("int"))).alias("t"), (z >= 0).alias("p"), (y == 1).alias("y"), F.when(has, top == F.col("target_idx")).alias("hit"))
    n = lambda p, t: F.count_if((F.col("p") == p) & (F.col("y") == t))
    found = rows.agg(F.avg("c").alias("conflict_loss"), F.coalesce(F.avg("t"), F.lit(0.0)).alias("target_loss"), n(True, True).alias("tp"), n(False, False).alias("tn"), n(True, False).alias("fp"), n(False, True).alias("fn"), F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("target_acc"), F.count("hit").alias("target_samples"))
    ratio = lambda a, b: F.expr(f"({a}) / greatest({b}, 1)")
    found = found.withColumns({"loss": F.col("conflict_loss") + weight * F.col("target_loss"), "accuracy": ratio("tp + tn", "tp + tn + fp + fn"), "precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn")})
    return found.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def target_accuracy_by_role(scores: DataFrame) -> DataFrame:
    top = F.array_position(F.col("target_logits"), F.array_max(F.filter("target_logits", lambda v: v.isNotNull()))) - 1
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.col("target_idx").cast("int"))
    return scores.where("is_conflict = 1 and target_idx >= 0").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.avg((top == F.col("target_idx")).cast("int")).alias("accuracy"))
