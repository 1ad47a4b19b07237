"""Walks of many roots by bits against walks root by root."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import reach, traverse

EDGE = "src long, dst long, kind string"


def both(spark, edges, roots, depth, direction="in", kinds=None):
    e, r = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(i,) for i in roots], "root_id long")
    placed = reach.placed(r)
    found = reach.reach(e, placed, depth, direction, kinds)
    rows = lambda df: sorted((x.root_id, x.node_id, x.depth) for x in df.collect())
    return rows(reach.expanded(found, placed)), rows(traverse.walk(e, r.where("root_id is not null"), depth, direction, kinds)), found


def test_many_roots_equal_single_walks(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300), rng.choice(["calls", "imports"])) for _ in range(700)]
    edges += [(i, 7, "calls") for i in range(300)] + edges[:50]  # a hub and repeated edges
    for direction, kinds in (("in", None), ("out", ["calls"]), ("both", ["imports"])):
        got, want, found = both(spark, edges, range(300), 3, direction, kinds)
        assert got == want and want
        assert found.count() <= len(want)
        assert found.groupBy("block", "node_id").agg(F.bit_xor("bits").alias("x"), F.bit_or("bits").alias("o")).where("x <> o").count() == 0  # a root reaches a node once


def test_edges_of_reach(spark):
    edges = [(1, 2, "calls"), (2, 1, "calls"), (3, 3, "calls"), (None, 1, "calls"), (4, None, "calls")]
    got, want, _ = both(spark, edges, [1, 1, 3, 99], 4, "out")
    assert got == want == [(1, 2, 1)]
    assert both(spark, edges, [], 2)[:2] == ([], [])
    assert both(spark, [], [1], 2)[:2] == ([], [])
    assert both(spark, edges, [None, 2], 1, "out")[0] == [(2, 1, 1)]
    placed = reach.placed(spark.range(1000).select(F.col("id").alias("root_id")))
    assert placed.groupBy("block", "bit").count().where("count > 1").count() == 0
    assert placed.groupBy("block").count().count() <= 1000 // 64 + 5


def test_many_roots_are_not_broadcast(spark, monkeypatch):
    n, plans, write = 250_000, [], reach.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    roots = reach.placed(spark.range(n).select(F.col("id").alias("root_id")))
    monkeypatch.setattr(reach, "written", seen)
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") * 7 % n).alias("dst"), F.lit("calls").alias("kind"))
    found = reach.reach(edges, roots, 2, "out")
    sums = reach.marked(found).groupBy("block", "bit").agg(F.sum("node_id").alias("s")).join(reach.unbroadcast(roots, roots), ["block", "bit"])
    plans.append(sums._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not any("BroadcastHashJoin" in p for p in plans)
    want = sum(y for x in range(n) for y in {x * 7 % n, x * 49 % n} - {x})
    assert sums.agg(F.sum("s")).first()[0] == want


def test_marks_of_bits(spark):
    found = spark.createDataFrame([(1, 7, b) for b in (0, 1, 2, -(1 << 63), -1, 5, 1 << 62)], "block long, node_id long, bits long")
    rows = [r.bit for r in reach.marked(found).collect()]
    assert sorted(rows) == sorted([0, 1, 63, *range(64), 0, 2, 62])
