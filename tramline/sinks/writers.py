"""Event tables as CSV or Parquet, tensor tables, flat records, results. Every sink writes a new folder; no input is changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import with_suffix

#: The columns of the files, in order.
DATA = ("Event_id", "scene_id", "frameNum", "t_rel", "carId", "role", "carCenterXm", "carCenterYm", "heading", "speed")
LABELS = ("Event_id", "scene_id", "t0", "is_conflict", "conflict_target_id", "conflict_target_role", "t_conflict")
FUTURE = ("Event_id", "scene_id", "carId", "frameNum", "t_rel", "carCenterXm", "carCenterYm", "heading", "speed", "role")
INDEX = ("event_id", "byte_offset", "byte_length", "is_conflict", "target_idx", "agent_mask", "scene_id", "conflict_target_role")
AGENTS, FRAMES, FEATURES = 7, 80, 4
RECORD = AGENTS * FRAMES * FEATURES * 4


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...]) -> str:
    """A folder of CSV files with a header; columns that are missing are left out, sentinels stand for nulls in labels."""
    filled = df
    if columns == LABELS:
        blank = {"conflict_target_id": "-1", "conflict_target_role": "", "t_conflict": ""}
        filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(blank[c])).alias(c) if c in blank else F.col(c) for c in df.columns])
    filled.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return path


def write_events(tables: dict[str, DataFrame], data: str, labels: str, future: str) -> list[str]:
    """The three tables, each in files of its own for every split if they have one. Returns the paths of the first split."""
    out = []
    for name, path, columns in (("data", data, DATA), ("labels", labels, LABELS), ("future", future, FUTURE)):
        df = tables[name]
        if "split" not in df.columns:
            out.append(write_csv(df, path, columns))
            continue
        for part in ("train", "val"):
            written = write_csv(df.where(F.col("split") == part), with_suffix(path, part), columns)
            if part == "train":
                out.append(written)
    return out


def write_candidates(candidates: DataFrame, path: str) -> str:
    names = {"scene_id": "scene_id", "ego": "ego_id", "is_conflict": "is_conflict", "t_conflict": "t_conflict", "tgt": "conflict_target_id"}
    candidates.select(*[F.col(a).alias(b) for a, b in names.items()]).write.mode("overwrite").option("header", True).csv(path)
    return path


def csv_to_parquet(rows: DataFrame, path: str) -> str:
    """Sorted by event over all files, so a reader of some events skips the rest."""
    rows.repartitionByRange("Event_id").sortWithinPartitions("Event_id", "carId", "frameNum").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def write_tensors(tensors: DataFrame, path: str, valid_only: bool = False, base: str | None = None) -> str:
    """One row an event. valid_only: the events and arrays of the table at base, with the valid column made anew; base must be there."""
    if valid_only:
        old = tensors.sparkSession.read.parquet(base or path)
        tensors = old.drop("valid").join(tensors.select("event_id", "valid"), "event_id", "left")
        if base is None or base == path:
            raise ValueError("valid_only writes a new table beside the one at base")
    tensors.write.mode("overwrite").parquet(path)
    return path


def dead_events(tensors: DataFrame) -> int:
    """Events without any observed frame."""
    return tensors.where(~F.exists(F.flatten("valid"), lambda v: v)).count()


def to_records(tensors: DataFrame) -> DataFrame:
    """(event_id, record, valid_bits) beside the other columns: float32 values in order of agent, frame and feature, and a bit for
    each agent and frame, the first of eight highest."""
    other = [f for f in tensors.schema.fields if f.name not in ("x", "valid")]
    schema = T.StructType([*other, T.StructField("record", T.BinaryType()), T.StructField("valid_bits", T.BinaryType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = p[[f.name for f in other]].copy()
            out["record"] = [np.array([[list(f) for f in a] for a in x], "<f4").tobytes() for x in p["x"]]
            out["valid_bits"] = [np.packbits(np.array([list(a) for a in v], bool).reshape(-1)).tobytes() for v in p["valid"]]
            yield out

    return tensors.mapInPandas(run, schema)


def from_record(record: bytes, valid_bits: bytes | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    x = np.frombuffer(record, "<f4").reshape(AGENTS, FRAMES, FEATURES)
    return x, None if valid_bits is None else np.unpackbits(np.frombuffer(valid_bits, np.uint8))[: AGENTS * FRAMES].reshape(AGENTS, FRAMES).astype(bool)


def record_index(records: DataFrame) -> DataFrame:
    """Where each record would lie in one file of them in the order of events; places come from counts of ranges, not from one sort."""
    from pyspark.sql import Window

    part = F.floor(F.col("event_id") / 100_000)
    counts = records.groupBy(part.alias("part")).count()
    bases = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = records.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("event_id")) - 1).join(bases, "part")
    ranked = ranked.withColumn("byte_offset", (F.col("base") + F.col("place")) * RECORD).withColumn("byte_length", F.lit(RECORD))
    return ranked.select(*[c for c in INDEX if c in ranked.columns])


def write_results(results: DataFrame, path: str) -> str:
    """One JSON document an event."""
    results.write.mode("overwrite").json(path)
    return path


def write_summary(rows: DataFrame, path: str) -> str | None:
    """A CSV file of one row for each event and readout; nothing if there is none."""
    if rows.isEmpty():
        return None
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path
