"""Command line: python -m tramline COMMAND --help."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession

from .config import Game, Selection, Settings, load_game, load_settings


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tramline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for o in options:
            c.add_argument(f"--{o.rstrip('!')}", required=o.endswith("!"))
        return c

    c = command("run", "tracks to event tables", "config", "raw", "out")
    c.add_argument("--dump-interim", action="store_true")
    command("downsample", "25 to 10 frames a second", "raw!", "out!")
    command("repair", "tell cars apart that share an id", "raw!", "out!")
    command("rebalance", "even out conflicts and non-conflicts", "config", "labels!", "data!", "out-labels!", "out-data!")
    command("parquet", "event rows from CSV to sorted Parquet", "data!", "out!")
    c = command("tensors", "event tables to tensors", "config", "data!", "labels!", "out!", "allow", "base")
    c.add_argument("--valid-only", action="store_true")
    command("records", "tensors to flat records and their index", "tensors!", "out!")
    for name, text in (("evaluate", "measures of a model over tensors"), ("attribute", "values of the cells of events")):
        c = command(name, text, "tensors!", "weights!", "model", "out!", "config")
        c.add_argument("--max-n", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from pyspark.sql import functions as F

    from . import pipeline
    from .operators import games, tensors
    from .sinks import writers
    from .sources import ngsim, readers, repair

    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    settings = load_settings(a.config) if getattr(a, "config", None) and a.command != "attribute" else Settings()
    if a.command == "run":
        for path in pipeline.run_pipeline(spark, settings, a.raw, a.dump_interim, a.out or ""):
            print(path)
    elif a.command == "downsample":
        ngsim.downsample(readers.read_folder(spark, a.raw)).write.mode("overwrite").option("header", True).csv(a.out)
    elif a.command == "repair":
        repair.split_shared_ids(readers.read_raw(spark, a.raw)).write.mode("overwrite").option("header", True).csv(a.out)
    elif a.command == "rebalance":
        from .operators.balance import balance_roles, rebalance

        labels = readers.read_labels(spark, [a.labels])
        kept = rebalance(labels, settings)
        if settings.balance_roles:
            kept = balance_roles(kept, settings)
        writers.write_csv(kept, a.out_labels, writers.LABELS)
        data = spark.read.option("header", True).csv(a.data)
        writers.write_csv(data.join(kept.select("Event_id"), "Event_id", "left_semi"), a.out_data, writers.DATA)
    elif a.command == "parquet":
        writers.csv_to_parquet(spark.read.option("header", True).csv(a.data).withColumn("Event_id", F.col("Event_id").cast("long")), a.out)
    elif a.command == "tensors":
        data = readers.keep_listed(spark.read.parquet(a.data) if "parquet" in a.data else spark.read.option("header", True).csv(a.data), a.allow)
        writers.write_tensors(tensors.build_tensors(spark, data, readers.read_labels(spark, [a.labels]), settings), a.out, a.valid_only, a.base)
    elif a.command == "records":
        made = writers.to_records(readers.read_tensors(spark, a.tensors, require_valid=True))
        made.select("event_id", "record", "valid_bits").write.mode("overwrite").parquet(f"{a.out}/records")
        writers.record_index(made).write.mode("overwrite").option("header", True).csv(f"{a.out}/index")
    else:
        weights = dict(np.load(a.weights))
        table = readers.read_tensors(spark, a.tensors, require_valid=True)
        if a.command == "evaluate":
            from .models.evaluate import measures, score

            measures(score(table, a.model or "baseline", weights)).write.mode("overwrite").json(a.out)
            return
        game = load_game(a.config) if a.config else Game()
        if a.max_n is not None:
            game = Game(**{**game.__dict__, "selection": Selection(**{**game.selection.__dict__, "max_n": a.max_n})})
        chosen = games.select_events(table, game)
        cells = games.attribute(chosen, a.model or "transformer", weights, game).persist()
        meta = readers.event_metadata(chosen)
        writers.write_results(games.documents(cells, meta), f"{a.out}/events")
        writers.write_summary(games.summary(cells, meta), f"{a.out}/summary")


if __name__ == "__main__":
    main()
