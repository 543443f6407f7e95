"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes all documents that the stage before kept. The first four return the columns of ``documents``; the last
returns the pieces of the packed sequences. Documents that a stage rejects are gone for good; a document that loses all
its lines stays, empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolake.llm import decontam, line_dedup, packing, quality_mil, simhash, toxicity_cnn
from tempolake.llm.common import prepare, stored

#: The classifier, the line edits and the packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from labels outside the held-out fold."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_cnn.without_toxic(docs, labels, fold=quality_mil.crc_fold("doc_id", 5) != 0)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines within one edit of an earlier line; n_chars follows the text."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs, characters=True).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    prepare(spark)
    return simhash.one_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.without_contaminated(docs, benchmark).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold all documents."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
