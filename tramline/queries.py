"""Registered queries over trajectories, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import attribution, conflicts, events  # noqa: F401  (they add their plans)
from .plans import fixture  # noqa: F401
from .plans.scenes import deal
from .plans.templates import PLANS
from .sources import tracks  # noqa: F401

#: Plans that only other plans use.
INNER = ("frames", "tracks", "neighbor_pairs", "kinematics_rows", "ttc_rows", "boxes", "box_pairs", "ttc_obb_rows", "kinematics_by_pair", "safe_frames", "events", "ego_ref", "event_members", "event_rows", "tensor_rows", "psi", "coalitions", "scores", "shapley_weights", "agent_risk", "players", "game_values", "slot_logits")


_memos: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        memo = _memos.setdefault((spark.sparkContext.applicationId, sf_dir), {})
        return PLANS.apply(spark, name, memo, by_scene=True, customer=deal(spark.read.parquet(f"{sf_dir}/customer.parquet")))

    run.__name__ = name
    return run


QUERIES = {n: _query(n) for n in PLANS.plans if n not in INNER}
ORACLES = {n: PLANS.as_sql(n) for n in QUERIES}
