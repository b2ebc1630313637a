"""Event tables to one tensor a row: [agent, frame, feature], right-aligned, with masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..plans.templates import PLANS

AGENTS = 7


def build_tensors(spark: SparkSession, data: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(event_id, is_conflict, target_idx, agent_mask, scene_id, conflict_target_role, x, valid) of the events that both tables have.

    data: Event_id, carId, role, frameNum, carCenterXm, carCenterYm, heading, speed; labels: Event_id, t0, is_conflict, conflict_target_id
    and, if there, scene_id and conflict_target_role. x holds dx, dy, heading against the ego at t0, and speed, as floats; what is not
    observed is 0 and not valid. Events without an ego have no row.
    """
    s = settings or Settings()
    frames = s.frames(s.history_sec)
    tgt = F.when((F.col("is_conflict") == 1) & (F.col("conflict_target_id").cast("string") != "-1"), F.col("conflict_target_id"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in labels.columns else F.lit("")
    events = labels.select(F.col("Event_id").cast("long").alias("event_id"), text("scene_id").alias("scene_id"), tgt.cast("string").alias("tgt"), F.col("is_conflict").cast("int").alias("is_conflict"), F.col("t0").cast("double").alias("t0"), text("conflict_target_role").alias("conflict_target_role"))
    rows = data.withColumn("event_id", F.col("Event_id").cast("long")).join(events.select("event_id", "t0"), "event_id")
    rows = rows.select("event_id", F.col("carId").cast("string").alias("carId"), "role", F.col("frameNum").cast("long").alias("frameNum"), ((F.col("frameNum") - F.col("t0")) / s.fps).alias("t_rel"), *[F.col(c).cast("double").alias(c) for c in ("carCenterXm", "carCenterYm", "heading", "speed")])
    memo: dict[str, DataFrame] = {}
    bound = {"events": events, "event_rows": rows}
    cells, slots, target = (PLANS.apply(spark, n, memo, s, **bound) for n in ("tensor_rows", "slot_assignment", "target_idx"))
    by_agent = cells.groupBy("event_id", "slot").agg(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), F.array(*[F.col(c).cast("float") for c in ("dx", "dy", "dh", "speed")]).alias("f")))).alias("at"))
    blank = F.array(*[F.lit(0.0).cast("float")] * 4)
    every = F.sequence(F.lit(0), F.lit(frames - 1))
    lines = by_agent.select("event_id", F.col("slot").cast("int").alias("slot"), F.transform(every, lambda t: F.coalesce(F.try_element_at("at", t), blank)).alias("x"), F.transform(every, lambda t: F.map_contains_key("at", t)).alias("v"))
    held = lines.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("x", "v").alias("l")))).alias("at"))
    agents = F.sequence(F.lit(0), F.lit(AGENTS - 1))
    none, unseen = F.array_repeat(blank, frames), F.array_repeat(F.lit(False), frames)
    masks = slots.groupBy("event_id").agg(F.bit_or(F.expr("shiftleft(1, cast(slot as int))")).alias("agent_mask"))
    egos = slots.where("slot = 0").select("event_id")
    out = events.join(egos, "event_id", "left_semi").join(target.select("event_id", "target_idx"), "event_id").join(masks, "event_id").join(held, "event_id", "left")
    return out.select("event_id", "is_conflict", "target_idx", "agent_mask", "scene_id", "conflict_target_role",
                      F.transform(agents, lambda a: F.coalesce(F.try_element_at("at", a)["x"], none)).alias("x"), F.transform(agents, lambda a: F.coalesce(F.try_element_at("at", a)["v"], unseen)).alias("valid"))
