"""Corpus pipeline over documents: toxic documents go, repeated lines go, one document of each near-copy group stays, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import materialize, table
from tramline.llm.lines import remove_duplicate_lines
from tramline.llm.nearcopies import near_duplicates
from tramline.llm.packing import pack
from tramline.llm.toxicity import score_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic, as they are."""
    model = train(docs, table(spark, sf_dir, "labels"))
    # the row is carried whole, so columns that share a name with the scores stay
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return score_documents(rows, model).where("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or place has already; n_chars follows."""
    return remove_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id; a repeated row counts once.

    Rows without a doc_id stay if no row of their class has one.
    """
    found = near_duplicates(docs)
    kept = docs.join(found.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    nameless = found.where("class_id is null").select("node").distinct()
    rest = docs.where("doc_id is null")
    rest = rest.join(nameless, F.xxhash64(F.coalesce(rest["text"], F.lit(""))) == nameless["node"], "left_semi").dropDuplicates(["text"])
    return kept.select(*docs.columns).unionByName(rest.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, as op10 gives them."""
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]
#: The learned scores of the first stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
