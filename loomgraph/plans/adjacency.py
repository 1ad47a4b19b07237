"""The adjacency that a version keeps: edges twice, in buckets by the node that a move starts from, sorted by kind and node.

A walk reads the buckets of its frontier only, and of these, while the frontier is small, only row groups that may
hold its nodes. A re-index rewrites the buckets of nodes whose edges came or went.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans import snapshot
from loomgraph.scratch import written

#: The table of each direction, and the ends of an edge that are its start and its goal.
SIDES = {"out": ("moves_out", "src", "dst"), "in": ("moves_in", "dst", "src")}
#: Frontiers up to so many nodes are put into the filter of the scan.
ASKED = 1000


def _side(edges: DataFrame, side: str) -> DataFrame:
    _, at, goal = SIDES[side]
    return edges.select(F.col(at).alias("at"), F.col(goal).alias("next"), "kind").distinct()


def built(edges: DataFrame) -> dict:
    """The tables of all edges (src, dst, kind)."""
    return {SIDES[side][0]: snapshot.Bucketed(_side(edges, side), "at", "at") for side in SIDES}


def changed(now: dict, before: DataFrame, after: DataFrame) -> dict:
    """The tables in which the edges after stand in the place of the edges before; those in both don't count."""
    if any(name not in now["layout"] for name, _, _ in SIDES.values()):
        return {}  # a version without them: walks take its edges
    ends = ["src", "dst", "kind"]
    old, new = before.select(*ends).distinct(), after.select(*ends).distinct()
    gone, come = written(old.exceptAll(new), "gone-edges"), written(new.exceptAll(old), "new-edges")
    return {SIDES[side][0]: snapshot.Revised(_side(gone, side), _side(come, side), "at", "at") for side in SIDES}


@dataclass
class KeptMoves:
    spark: SparkSession
    store: str
    now: dict
    sides: list[str]
    kinds: list[str] | None

    def near(self, frontier: DataFrame) -> DataFrame:
        """(at, next) from the frontier's nodes (node_id); beyond ASKED nodes other moves of their buckets come along."""
        ids = frontier.select("node_id").distinct()
        few = [r["node_id"] for r in ids.limit(ASKED + 1).collect()]
        small = len(few) <= ASKED
        keys = [str(k) for k in few] if small else ids
        out = None
        for side in self.sides:
            rows = snapshot.table(self.spark, self.store, SIDES[side][0], self.now, keys=keys)
            rows = rows if self.kinds is None else rows.where(F.col("kind").isin(*self.kinds))
            rows = (rows.where(F.col("at").isin(*few)) if small else rows).select("at", "next")
            out = rows if out is None else out.unionByName(rows)
        return out.distinct()


@dataclass
class Kept:
    """The adjacency of the version now of a store, for operators that walk."""

    spark: SparkSession
    store: str
    now: dict

    def moves(self, direction: str, kinds: list[str] | None) -> KeptMoves:
        return KeptMoves(self.spark, self.store, self.now, ["out", "in"] if direction == "both" else [direction], kinds)


def of(spark: SparkSession, store: str, edges: DataFrame, now: dict | None = None) -> Kept | DataFrame:
    """The adjacency of a version, or its edges if it was published without one."""
    now = now or snapshot.current(spark, store)
    return Kept(spark, store, now) if all(name in now["layout"] for name, _, _ in SIDES.values()) else edges
