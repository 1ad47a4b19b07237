"""Ranking of impacted files by structure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.scratch import written


@dataclass(frozen=True)
class Weights:
    """Fixed values of the additive score; anchors shorter than min_anchor don't match names."""

    direct: int = 8
    package: int = 4
    name_match: int = 10
    min_anchor: int = 4
    test_penalty: int = 100_000


def rank(candidates: DataFrame, subject_file: Column, anchor: Column, weights: Weights = Weights(), keep_own: bool = False) -> DataFrame:
    """candidates (file_path, refs, direct) with same_pkg, name_match, is_test, score and tier.

    Files whose key is the subject's are left out, unless keep_own.
    """
    key, own = text.rank_key("file_path"), text.rank_key(subject_file)
    package = text.directory(subject_file)
    word = text.anchor_word(anchor)
    rows = candidates if keep_own else candidates.where(key != own)
    rows = rows.withColumn("same_pkg", (package != "") & (text.directory("file_path") == package))
    rows = rows.withColumn("name_match", (F.length(word) >= weights.min_anchor) & F.contains(key, word))
    rows = rows.withColumn("is_test", text.is_test_for_rank("file_path"))
    flag = lambda name, points: F.when(F.col(name), points).otherwise(0)
    score = F.col("refs") + flag("direct", weights.direct) + flag("same_pkg", weights.package) + flag("name_match", weights.name_match) - flag("is_test", weights.test_penalty)
    tier = F.when(F.col("is_test"), "test").when(F.col("direct"), "direct").when(F.col("name_match") | (F.col("refs") >= 3), "strong").otherwise("weak")
    return rows.withColumn("score", score.cast("long")).withColumn("tier", tier)


def placed(rows: DataFrame, order: list[Column], position: str = "position", kind: str = "int") -> DataFrame:
    """rows with their number, from 1, in a total order, without taking all of them through one task.

    They are range-partitioned by the order and numbered within partitions; each partition then adds how
    many rows come before it, of which the driver sees one number per partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33)
    counts = sorted((r["part"], r["n"]) for r in each.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, sum(n for q, n in counts if q < p)) for p, _ in counts]
    starts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # one row per partition
    out = each.join(starts, part == F.col("_part"))
    return out.withColumn(position, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast(kind)).drop("_id", "_part", "_before")


def order() -> list[Column]:
    """The order of ranked files."""
    return [F.desc("score"), F.desc("refs"), F.asc("file_path")]
