"""Walks of very many roots: 64 roots share a row, a bit each, so that they share each scan of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.traverse import Adjacency, moves_of
from loomgraph.scratch import written


#: Rows up to which Spark may join a written table by the size of its files. Numbers in order take a byte or so there, many times that in a broadcast.
FEW = 200_000


def unbroadcast(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows, made from a written table, for a join that Spark doesn't broadcast if the table has many rows."""
    return rows.hint("merge") if table.count() > FEW else rows


def placed(roots: DataFrame) -> DataFrame:
    """(root_id, block, bit): distinct roots (root_id), 64 to a block at most. Roots whose ids are near share blocks; the last block of a partition may be short."""
    ordered = roots.select("root_id").where("root_id is not null").distinct().repartitionByRange("root_id").sortWithinPartitions("root_id")
    # The number counts on within a partition and leaves its upper bits to the partition, so its upper part names a block.
    rows = ordered.withColumn("_n", F.monotonically_increasing_id())
    return written(rows.select("root_id", F.shiftright("_n", 6).alias("block"), F.col("_n").bitwiseAND(63).cast("int").alias("bit")), "blocks")


def reach(edges: DataFrame | Adjacency, roots: DataFrame, depth: int, direction: str = "in", kinds: list[str] | None = None) -> DataFrame:
    """(block, node_id, depth, bits): the nodes that roots of a block first reach at a depth, a bit for each root; roots themselves left out.

    roots is from placed. A level costs one join of the frontier with the moves and one combining aggregate by (block,
    node), which also takes away what was seen. Its rows are at most nodes x blocks, however many paths or roots there are.
    """
    start = roots.select("block", F.col("root_id").alias("node_id"), F.expr("shiftleft(1L, bit)").alias("bits"))
    return spread(edges, start, depth, direction, kinds).where("depth > 0")


def spread(edges: DataFrame | Adjacency, start: DataFrame, depth: int, direction: str = "in", kinds: list[str] | None = None) -> DataFrame:
    """reach from any start (block, node_id, bits), one row a block and node: a bit may begin at many nodes. The start is depth 0."""
    moves = moves_of(edges, direction, kinds)
    none = F.lit(0).cast("long")
    frontier = written(start.select("block", "node_id", F.lit(0).alias("depth"), "bits"), "frontier")
    seen = frontier
    for level in range(1, depth + 1):
        met = unbroadcast(frontier, frontier).join(moves.near(frontier), frontier["node_id"] == F.col("at")).select("block", F.col("next").alias("node_id"), "bits", none.alias("old"))
        rows = met.unionByName(seen.select("block", "node_id", none.alias("bits"), F.col("bits").alias("old")))
        merged = rows.groupBy("block", "node_id").agg(F.bit_or("bits").alias("met"), F.bit_or("old").alias("old"))
        new = merged.select("block", "node_id", F.lit(level).alias("depth"), F.col("met").bitwiseAND(F.bitwise_not("old")).alias("bits")).where("bits <> 0")
        frontier = written(new, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def expanded(found: DataFrame, roots: DataFrame) -> DataFrame:
    """found (block, bits, ...) with a row for each root of its bits: root_id in the place of block and bits."""
    members = roots.groupBy("block").agg(F.collect_list(F.struct("bit", "root_id")).alias("_members"))  # 64 at most
    own = F.filter("_members", lambda m: F.getbit(F.col("bits"), m["bit"]) == 1)
    rest = [c for c in found.columns if c not in ("block", "bits")]
    return found.join(unbroadcast(members, roots), "block").select(F.explode(own).alias("_m"), *rest).select("_m.root_id", *rest)


def marked(found: DataFrame) -> DataFrame:
    """found (block, bits, ...) with a row for each of its bits: bit in the place of bits. Sums by (block, bit) need the roots only once they are made."""
    bits = F.col("bits")
    # Most rows of a wide graph have one bit, which is told without going through all.
    own = F.when(F.bit_count(bits) == 1, F.array(F.length(F.bin(bits)) - 1)).otherwise(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(bits, k) == 1))
    return found.select(*[c for c in found.columns if c != "bits"], F.explode(own).alias("bit"))
