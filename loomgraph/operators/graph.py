"""Lookups, neighbours, upserts, deletes, statistics and export of the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key: the last write wins. Combined before the shuffle, as no window is needed."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.max_by(whole, order).alias("row")).select("row.*")


def upsert_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge per (src, dst, kind): weight and meta of the highest seq."""
    return latest(edges, ["src", "dst", "kind"], F.col(seq)).drop(seq)


def upsert(now: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """now with the rows of new in place of those with the same key."""
    return now.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert_repos(repos: DataFrame, new: DataFrame) -> DataFrame:
    """A known root keeps its id and takes the new name; others are added."""
    named = repos.alias("r").join(new.select("root", F.col("name").alias("new_name")), "root", "left")
    kept = named.select(*[F.coalesce("new_name", "name").alias("name") if c == "name" else c for c in repos.columns])
    return kept.unionByName(new.join(repos, "root", "left_anti").select(*repos.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, pending: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the nodes gone (id), the edges at either end of them, and their pending references."""
    ids = gone.select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns), pending.join(ids.withColumnRenamed("id", "src_node"), "src_node", "left_anti").select(*pending.columns)


def of_kind(rows: DataFrame, kinds: list[str] | None) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def neighbors(edges: DataFrame, nodes: DataFrame, asked: DataFrame, direction: str = "both", kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(root_id, direction, edge_kind, weight, node columns) for each asked (id).

    Both directions make a bag: a pair linked either way shows twice. limit holds per root and
    direction, in order of the neighbour's ord.
    """
    ends = []
    for name, own, other in (("out", "src", "dst"), ("in", "dst", "src")):
        if direction in (name, "both"):
            ends.append(of_kind(edges, kinds).select(F.col(own).alias("root_id"), F.col(other).alias("id"), F.lit(name).alias("direction"), F.col("kind").alias("edge_kind"), "weight"))
    both = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    found = both.join(asked.select(F.col("id").alias("root_id")).distinct(), "root_id").join(nodes, "id")
    if limit is not None:
        w = Window.partitionBy("root_id", "direction").orderBy("ord", "id", "edge_kind")
        found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return found


def find_by_name(nodes: DataFrame, name: str, kinds: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Nodes of that name or qualified name, in order."""
    return of_kind(nodes, kinds).where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy("ord").limit(limit)


def nodes_for_file(nodes: DataFrame, repo_id: int, path: str) -> DataFrame:
    return nodes.where((F.col("repo_id") == repo_id) & (F.col("file_path") == path)).orderBy("start_line", "ord")


def count_stats(nodes: DataFrame, edges: DataFrame, repos: int | None = None) -> DataFrame:
    """(metric, n): nodes of each kind, all nodes and all edges."""
    kinds = nodes.groupBy(F.col("kind").alias("metric")).count()
    return kinds.unionByName(nodes.agg(F.count("*").alias("count")).select(F.lit("nodes").alias("metric"), "count")).unionByName(edges.agg(F.count("*").alias("count")).select(F.lit("edges").alias("metric"), "count")).withColumnRenamed("count", "n")


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def language_stats(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'file' and language is not null").groupBy("language").agg(F.count("*").alias("n"))


def export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("kind").alias("type"), F.col("subkind").alias("subtype"), "name", F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"), "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends of every edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def degree_sample(nodes: DataFrame, edges: DataFrame, most: int = 600) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, and the edges with both ends among them."""
    ranked = nodes.select("id").join(degrees(edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    top = ranked.orderBy(F.desc("degree"), "id").limit(most)
    ids = F.broadcast(top.select("id"))  # at most `most` rows
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return top, kept.select(*edges.columns)
