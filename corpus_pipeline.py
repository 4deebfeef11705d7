"""A corpus pipeline of five of the operators: each stage reads the rows that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.llm import decontaminate, language, minhash, packing, toxicity
from listingloom.session import hinted, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of their own for the rows, written so that it stays the same."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language that could be told (no letters, null) go."""
    return language.with_language(docs.select(*COLUMNS), language.labelled_sample(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs.select(*COLUMNS), toxicity.train(*toxicity.labelled_sample(docs, labels)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id (rows without one come last)."""
    keyed = _keyed(docs, "rows-to-compare")
    found = minhash.near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id")
    ranked = found.join(keyed.select("row_key", "doc_id").hint("merge"), "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    kept = materialize(ranked.groupBy("component_id").agg(first).select("first.row_key"), "kept-rows")
    return keyed.join(hinted(kept), "row_key", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    keyed = _keyed(docs, "rows-to-search")
    found = decontaminate.overlaps(keyed.select(F.col("row_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = materialize(found.select(F.col("doc_id").alias("row_key")).distinct(), "leaks")
    return keyed.join(hinted(leaks), "row_key", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models, near-duplicate groups and a tokenizer can't be said in SQL; tests/llm/test_pipeline.py checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    Language and toxicity decide row by row; copies and benchmark passages are named by a number given to each row, so rows
    that repeat a doc_id or have none are treated like any other. Of rows that repeat exactly one stays. An empty table gives
    no rows. cleanup() of listingloom.session deletes what the stages wrote once the result has been written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
