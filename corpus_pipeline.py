"""A training corpus from documents: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import packing, quality, secrets, simhash, suffixes
from loomgraph.llm.common import numbered, written

#: Bytes of text that packing splits at once. Python workers are used again, so what it takes stays taken beside the executor's heap.
AT_ONCE = 2 << 20


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the compression classifier scores 0.5 or more."""
    model = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~quality.held_out(F.col("doc_id")))
    return quality.scored(docs, model).where("score >= 0.5").select("own.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the least doc_id."""
    return simhash.without_copies(docs)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of all but their first place; documents that lose all their text go."""
    had = _free(docs, "had")
    out = suffixes.without_repeats(docs.withColumn(had, F.coalesce(F.length("text"), F.lit(0)) > 0))
    return out.where((F.col("text") != "") | ~F.col(had)).drop(had).withColumn("n_chars", F.length("text").cast("long"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of secrets."""
    row = _free(docs, "row")
    rows = numbered(docs, row)
    new = secrets.redacted(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "text")
    out = rows.drop("text").join(new, row)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining texts, in sequences of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), at_once=AT_ONCE)


STAGES = [("quality", good), ("near_copies", distinct), ("repeats", unrepeated), ("secrets", redacted), ("packing", packed)]

#: SQL expresses none of the stages. tests/llm checks each on a small fixture: near copies, repeats and secrets against
#: brute force, packing against the library, quality by held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
