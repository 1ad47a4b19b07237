"""Ranked change impact: reverse walks, files, co-changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import rank
from loomgraph.operators.reach import expanded, placed, reach
from loomgraph.operators.traverse import Adjacency
from loomgraph.scratch import written


def seeds(nodes: DataFrame, edges: DataFrame | Adjacency, targets: DataFrame) -> DataFrame:
    """(target_id, root_id): each target (id), and for containers also what they directly contain."""
    own = targets.select(F.col("id").alias("target_id"), F.col("id").alias("root_id"))
    boxes = targets.select("id").join(nodes.where(F.col("subkind").isin(*schema.CONTAINERS)).select("id"), "id")
    if isinstance(edges, DataFrame):
        inside = edges.where("kind = 'contains'").select(F.col("src").alias("at"), F.col("dst").alias("next"))
    else:
        inside = edges.moves("out", ["contains"]).near(boxes.withColumnRenamed("id", "node_id"))
    inner = inside.join(boxes.withColumnRenamed("id", "at"), "at").select(F.col("at").alias("target_id"), F.col("next").alias("root_id"))
    return own.unionByName(inner)


def impacted_files(nodes: DataFrame, edges: DataFrame | Adjacency, targets: DataFrame, depth: int = 3) -> DataFrame:
    """(target_id, file_path, max_score, hit_count, min_depth, direct, symbols) over reverse walks from all seeds.

    A node counts once for each seed that reaches it. The target itself and nodes without a file don't count. All seeds walk
    together, and a node gets its file and name before its row is split by seeds.
    """
    start = written(seeds(nodes, edges, targets), "seeds")
    roots = placed(start)
    hits = reach(edges, roots, depth, "in", list(schema.IMPACT_KINDS))
    named = nodes.where("file_path is not null").select(F.col("id").alias("node_id"), "file_path", "name")
    rows = expanded(hits.join(named, "node_id"), roots).join(start, "root_id").where("node_id <> target_id")
    return rows.groupBy("target_id", "file_path").agg(
        F.max(F.pow(F.lit(0.5), F.col("depth") - 1)).alias("max_score"),
        F.count("*").alias("hit_count"),
        F.min("depth").alias("min_depth"),
        F.min("depth").eqNullSafe(1).alias("direct"),
        F.array_sort(F.collect_set("name")).alias("symbols"),
    )


def impact(nodes: DataFrame, edges: DataFrame | Adjacency, targets: DataFrame, depth: int = 3, limit: int = 50, weights: rank.Weights = rank.Weights()) -> DataFrame:
    """impacted_files with score, tier, signals and position of each target's first `limit` files.

    Files with the key of the target's file are left out, but not that file itself.
    """
    files = impacted_files(nodes, edges, targets, depth).withColumnRenamed("hit_count", "refs")
    subject = targets.select("id").join(nodes, "id").select(F.col("id").alias("target_id"), F.coalesce("file_path", F.lit("")).alias("subject"), F.col("name").alias("anchor"))
    rows = files.join(subject, "target_id")
    # The target's own file has no subject to be compared with, so that it is neither left out nor of its own package.
    beside = F.when(F.col("file_path") == F.col("subject"), "").otherwise(F.col("subject"))
    w = Window.partitionBy("target_id").orderBy(*rank.order())
    return rank.rank(rows, beside, F.col("anchor"), weights).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("subject", "anchor")


def cochanges_of(files: DataFrame, nodes: DataFrame, edges: DataFrame, top_files: int = 5, per_file: int = 5) -> DataFrame:
    """(target_id, with_file, file_path, weight): what changes with the top files of impact, strongest first."""
    top = files.where(F.col("position") <= top_files).select("target_id", "position", F.col("file_path").alias("with_file"))
    paths = nodes.where("kind = 'file'").select("id", F.col("file_path").alias("path"), "ord")
    pairs = edges.where("kind = 'co_change'").select("src", "dst", "weight")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    own = top.join(paths.select(F.col("id").alias("src"), F.col("path").alias("with_file")), "with_file")
    found = own.join(both, "src").join(paths.select(F.col("id").alias("dst"), F.col("path").alias("file_path"), "ord"), "dst")
    w = Window.partitionBy("target_id", "with_file").orderBy(F.desc("weight"), "ord")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_file).select("target_id", "position", "with_file", "file_path", "weight", "n")
