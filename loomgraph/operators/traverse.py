"""Bounded walks over edges, many roots at once: one join per level."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text
from loomgraph.operators.graph import of_kind
from loomgraph.scratch import written


def steps(edges: DataFrame, direction: str, kinds: list[str] | None) -> DataFrame:
    """(at, next): the moves that a walk may make."""
    rows = of_kind(edges, kinds)
    out = rows.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    into = rows.select(F.col("dst").alias("at"), F.col("src").alias("next"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


class Moves(Protocol):
    """The moves of a walk, asked for level by level."""

    def near(self, frontier: DataFrame) -> DataFrame:
        """(at, next): moves that hold at least those from the frontier's nodes (node_id)."""


class Adjacency(Protocol):
    """Edges that are kept in the order of their ends, such as plans.adjacency."""

    def moves(self, direction: str, kinds: list[str] | None) -> Moves: ...


@dataclass
class AllMoves:
    """All moves as one table, for edges that are in no order."""

    rows: DataFrame

    def near(self, frontier: DataFrame) -> DataFrame:
        return self.rows


def moves_of(edges: DataFrame | Adjacency, direction: str, kinds: list[str] | None) -> Moves:
    if isinstance(edges, DataFrame):
        return AllMoves(written(steps(edges, direction, kinds), "moves"))
    return edges.moves(direction, kinds)


def walk(edges: DataFrame | Adjacency, roots: DataFrame, depth: int, direction: str = "in", kinds: list[str] | None = None) -> DataFrame:
    """(root_id, node_id, depth, parent_id) for the nodes first reached from each root (root_id), roots left out.

    A level joins its frontier to the moves, keeps the least parent of a node, and drops what the root
    has seen. Each level's frontier is a written table, so that no level plans or runs those before it
    again; Spark chooses how to join each level by the frontier's size. For very many roots see operators.reach.
    """
    moves = moves_of(edges, direction, kinds)
    start = roots.select("root_id").distinct()
    seen = start.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_id"))
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.join(moves.near(frontier), frontier["node_id"] == F.col("at")).groupBy("root_id", F.col("next").alias("node_id")).agg(F.min("at").alias("parent_id"))
        new = reached.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti")
        frontier = written(new.select("root_id", "node_id", F.lit(level).alias("depth"), "parent_id"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def callers(edges: DataFrame | Adjacency, nodes: DataFrame, roots: DataFrame, depth: int = 1, limit: int = 100, direction: str = "in") -> DataFrame:
    """walk over calls with node columns and via_path, cut at limit hits of a root in visit order.

    The path runs from the hit to the root for callers, from the root to the hit for callees.
    """
    moves = moves_of(edges, direction, ["calls"])
    names = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("symbol"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("ord").alias("node_ord"))
    first = roots.select("root_id").distinct().join(names, F.col("root_id") == F.col("node_id"))
    seen = first.select("root_id", "node_id", F.lit(0).alias("depth"), F.array("symbol").alias("via_path"), F.array(F.lit(0).cast("long")).alias("visit"), "symbol", "file", "line")
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.select("root_id", F.col("node_id").alias("at"), "via_path", "visit").join(moves.near(frontier), "at").withColumnRenamed("next", "node_id").join(names, "node_id")
        new = reached.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti")
        path = F.concat(F.array("symbol"), "via_path") if direction == "in" else F.concat("via_path", F.array("symbol"))
        row = F.struct(F.concat("visit", F.array("node_ord")).alias("visit"), path.alias("via_path"), "symbol", "file", "line")
        best = new.groupBy("root_id", "node_id").agg(F.min_by(row, "visit").alias("r"))
        frontier = written(best.select("root_id", "node_id", F.lit(level).alias("depth"), "r.via_path", "r.visit", "r.symbol", "r.file", "r.line"), "frontier")
        seen = seen.unionByName(frontier)
    visited = Window.partitionBy("root_id").orderBy("depth", "visit")
    hits = seen.where("depth > 0").withColumn("_n", F.row_number().over(visited)).where(F.col("_n") <= limit)
    return hits.drop("_n", "visit")


def callees(edges: DataFrame | Adjacency, nodes: DataFrame, roots: DataFrame, depth: int = 1, limit: int = 100) -> DataFrame:
    return callers(edges, nodes, roots, depth, limit, "out")


def explore(nodes: DataFrame, edges: DataFrame, found: DataFrame, contents: DataFrame | None = None, hops: int = 4, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """How the nodes found (set_id, position, id) hang together: paths and symbols.

    Paths (set_id, position, hops, step, id, edge_kind) join each node of a set to the next one, one row
    per node, with the kind of the edge that leads to it; a pair without a path is missing. Symbols
    (set_id, id, name, file_path, start_line, source, truncated) are all nodes of a set and its paths, in
    the order of path and line, with their lines of contents (path, content), at most so many.
    """
    kinds = list(schema.EXPLORE_KINDS)
    ends = found.withColumn("b", F.lead("id").over(Window.partitionBy("set_id").orderBy("position"))).where("b is not null")
    pairs = ends.select(F.struct("set_id", "position").alias("pair_id"), F.col("id").alias("a"), "b")
    paths = written(shortest_paths(edges, pairs, hops, kinds), "paths").select("pair_id.set_id", "pair_id.position", "hops", F.posexplode("path").alias("step", "id"))
    before = F.lag("id").over(Window.partitionBy("set_id", "position").orderBy("step"))
    both = of_kind(edges, kinds).select("src", "dst", "kind")
    links = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")).groupBy(F.col("src").alias("before"), F.col("dst").alias("id")).agg(F.min("kind").alias("edge_kind"))
    paths = paths.withColumn("before", before).join(links, ["before", "id"], "left").drop("before")
    every = found.select("set_id", "id").unionByName(paths.select("set_id", "id")).distinct().join(nodes, "id")
    if contents is not None:
        every = every.join(contents.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    else:
        every = every.withColumn("content", F.lit(None).cast("string"))
    cut = F.when(F.col("start_line").isNotNull() & F.col("content").isNotNull(), text.snippet("content", F.col("start_line"), F.coalesce("end_line", "start_line"), most))
    rows = every.withColumn("cut", cut).select("set_id", "id", "name", "file_path", "start_line", F.col("cut.source").alias("source"), F.coalesce("cut.truncated", F.lit(False)).alias("truncated"))
    return paths.select("set_id", "position", "hops", "step", "id", "edge_kind"), rows.orderBy("set_id", "file_path", "start_line", "id")


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 4, kinds: list[str] | None = None) -> DataFrame:
    """(pair_id, hops, path array<long>) for pairs (pair_id, a, b) joined by an undirected path of at most hops.

    Walks from both ends half the way each and meets in the middle, so that neither walk covers the
    far neighbourhood; of equal paths the least is taken. Pairs without a path are missing.
    """
    moves = written(steps(edges, "both", kinds), "moves")

    def half(end: str, levels: int) -> DataFrame:
        seen = pairs.select("pair_id", F.col(end).alias("node_id"), F.lit(0).alias("depth"), F.array(end).alias("path"))
        frontier = seen
        for level in range(1, levels + 1):
            reached = frontier.join(moves, frontier["node_id"] == moves["at"]).groupBy("pair_id", F.col("next").alias("node_id")).agg(F.min("path").alias("path"))
            new = reached.join(seen.select("pair_id", "node_id"), ["pair_id", "node_id"], "left_anti")
            frontier = written(new.select("pair_id", "node_id", F.lit(level).alias("depth"), F.concat("path", F.array("node_id")).alias("path")), "frontier")
            seen = seen.unionByName(frontier)
        return seen

    left = half("a", (hops + 1) // 2)
    right = half("b", hops // 2).select("pair_id", "node_id", F.col("depth").alias("rest"), F.reverse("path").alias("back"))
    met = left.join(right, ["pair_id", "node_id"]).select("pair_id", (F.col("depth") + F.col("rest")).alias("hops"), F.concat("path", F.expr("slice(back, 2, size(back))")).alias("path"))
    return met.groupBy("pair_id").agg(F.min(F.struct("hops", "path")).alias("m")).select("pair_id", "m.hops", "m.path")
