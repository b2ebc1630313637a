"""Files in: tracks of two formats, labels, lists of events, tensor tables, results."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngsim import MARKERS, strip_names, to_standard
from .tracks import REQUIRED, require_columns

#: Types of the columns of standard track files; others are read as text.
TYPES = {"scene_id": T.StringType(), "frameNum": T.LongType(), "carId": T.StringType(), "objClass": T.StringType()} | {
    c: T.DoubleType() for c in ("carCenterXm", "carCenterYm", "heading", "course", "speed", *[f"boundingBox{k}{x}m" for k in range(1, 5) for x in "XY"])
}
BOX = tuple(f"boundingBox{k}{x}m" for k in range(1, 5) for x in "XY")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, or of the first of a folder; reads one line."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path, pathGlobFilter="*.csv").columns


def is_ngsim(columns: list[str]) -> bool:
    """By the names as they stand in the file; padded ones are not recognised."""
    return set(columns) >= MARKERS


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder, sorted; folders in it are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return sorted(r["path"] for r in found.collect())  # one row a file, without its content


def stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, TYPES.get(c, T.StringType())) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path, pathGlobFilter="*.csv")


def read_raw(spark: SparkSession, path: str, by_file: bool = False, validate: bool = True) -> DataFrame:
    """Tracks from a CSV file or folder in the standard or the NGSIM format, as standard columns with a scene.

    by_file: a row's scene is its file's name; else its scene_id, or "scene" where it has none ("peachtree" for NGSIM).
    """
    columns = header(spark, path)
    if is_ngsim(columns):
        raw = spark.read.option("header", True).csv(path, pathGlobFilter="*.csv")
        raw = strip_names(raw.withColumn("scene_id", stem() if by_file else F.lit("peachtree")))
        return to_standard(raw)
    raw = _csv(spark, path, columns)
    if validate:
        require_columns(raw, REQUIRED)
    own = F.coalesce(F.col("scene_id").cast("string"), F.lit("scene")) if "scene_id" in columns else F.lit("scene")
    return raw.withColumn("scene_id", stem() if by_file else own)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder; files of different columns are read each with its own and united by name."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in list_csv(spark, folder):
        groups.setdefault(tuple(header(spark, path)), []).append(path)
    if not groups:
        raise FileNotFoundError(f"no CSV files in {folder}")
    out = None
    for columns, paths in groups.items():
        one = to_standard(strip_names(spark.read.option("header", True).csv(paths).withColumn("scene_id", stem()))) if is_ngsim(list(columns)) else require_columns(_csv(spark, paths, list(columns))).withColumn("scene_id", stem())
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def boxes_from_corners(tracks: DataFrame) -> DataFrame:
    """Columns l and w, half the length and half the width of each box, from its corners (front right, front left, rear left, rear right)."""
    require_columns(tracks, BOX)
    c = {(k, x): F.col(f"boundingBox{k}{x}m") for k in range(1, 5) for x in "XY"}
    mean = lambda x, plus, minus: (c[plus[0], x] + c[plus[1], x] - c[minus[0], x] - c[minus[1], x]) / 4
    parts = [mean(x, (1, 2), (3, 4)).alias(f"l{x.lower()}") for x in "XY"] + [mean(x, (1, 4), (2, 3)).alias(f"w{x.lower()}") for x in "XY"]
    return tracks.select("*", *parts)


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several candidate files that is there; an empty table if none is."""
    for path in paths:
        try:
            found = spark.read.option("header", True).csv(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            return found.withColumns({c: F.col(c).cast(t) for c, t in (("Event_id", "string"), ("is_conflict", "int"), ("t0", "double")) if c in found.columns})
    return spark.createDataFrame([], "Event_id string, scene_id string, t0 double, is_conflict int, conflict_target_id string, conflict_target_role string, t_conflict string")


def keep_listed(rows: DataFrame, path: str | None, key: str = "Event_id") -> DataFrame:
    """Rows whose event stands in a text file with one number a line; all rows if there is no file."""
    if path is None:
        return rows
    try:
        listed = rows.sparkSession.read.text(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows
    wanted = listed.select(F.trim("value").alias("v")).where("v <> ''").select(F.col("v").cast("long").alias("_wanted")).distinct()
    return rows.join(wanted, rows[key].cast("long") == wanted["_wanted"], "left_semi")


def read_tensors(spark: SparkSession, path: str, require_valid: bool = False) -> DataFrame:
    """A tensor table as write_tensors() makes it; older tables may lack the valid column."""
    found = spark.read.parquet(path)
    if require_valid and "valid" not in found.columns:
        raise RuntimeError(f"{path} has no valid column; write it with write_tensors(valid_only=True)")
    return found


def event_metadata(tensors: DataFrame, event_id: int | None = None) -> DataFrame:
    """Columns beside the tensor, without reading it; missing texts are empty."""
    names = [c for c in ("event_id", "is_conflict", "target_idx", "agent_mask", "scene_id", "conflict_target_role") if c in tensors.columns]
    found = tensors.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if tensors.schema[c].dataType == T.StringType() else F.col(c) for c in names])
    return found if event_id is None else found.where(F.col("event_id") == event_id)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def with_suffix(path: str, name: str) -> str:
    """a/b.csv with _name before its ending."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_{name}{p.suffix}"))
