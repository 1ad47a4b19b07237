"""The full-text index that a version keeps: postings in buckets by the lead of their term, totals, and a small segment of what came since.

A posting has its text's length and kind with it, so a search reads nothing but the buckets of its
prefixes and one row of totals. A re-index adds the postings of new and changed nodes to the recent segment and
lists the ids of those that went; the main segment is written anew only when the recent one has grown
to a share of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import search as scoring
from loomgraph.plans import snapshot
from loomgraph.scratch import written

#: Letters of a term that decide its bucket. Shorter prefixes read all buckets.
LEAD = 2
#: Share of the main segment's postings at which the recent one is merged into it.
MERGE = 0.2

POSTING = ["lead", "term", "node_id", "repo_id", "kind", "weighted", "length"]
TEXTS = ["id", "repo_id", "kind", "name", "qualified_name", "doc"]


def postings(nodes: DataFrame) -> DataFrame:
    """POSTING of nodes."""
    rows = scoring.indexed(nodes)
    size = scoring.lengths(rows).select("node_id", "repo_id", "kind", "length")
    return scoring.postings(rows).join(size, ["node_id", "repo_id"]).withColumn("lead", F.substring("term", 1, LEAD)).select(*POSTING)


def totals(nodes: DataFrame) -> DataFrame:
    """(rows, tokens): how many nodes there are, and the tokens of all of them."""
    return scoring.lengths(scoring.indexed(nodes)).agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("tokens"))


def _recent(rows: DataFrame, gone: DataFrame) -> dict:
    ids = gone.select(F.lit(None).cast("string").alias("key"), F.col("id").alias("node_id"))
    return {"postings_recent": snapshot.Bucketed(rows, "lead", "term"), "postings_gone": snapshot.Bucketed(ids, "key", "node_id")}


def built(nodes: DataFrame) -> dict:
    """The tables of an index of all nodes."""
    rows = written(postings(nodes), "postings")
    return {"postings": snapshot.Bucketed(rows, "lead", "term"), "totals": totals(nodes), **_recent(rows.limit(0), nodes.limit(0))}


def changed(spark: SparkSession, store: str, now: dict, before: DataFrame, after: DataFrame, share: float | None = None) -> dict:
    """The tables of the index in which the nodes after stand in the place of the nodes before; unchanged ones don't count."""
    old, new = before.select(*TEXTS), after.select(*TEXTS)
    gone, come = written(old.exceptAll(new), "gone-texts"), written(new.exceptAll(old), "new-texts")
    lost, fresh = written(postings(gone).select("lead", "node_id"), "lost"), written(postings(come), "postings")
    signed = lambda rows, sign: rows.select((F.col("rows") * sign).alias("rows"), (F.col("tokens") * sign).alias("tokens"))
    sums = snapshot.table(spark, store, "totals", now).unionByName(signed(totals(gone), -1)).unionByName(signed(totals(come), 1))
    sums = {"totals": written(sums.agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens")), "totals")}
    recent = snapshot.table(spark, store, "postings_recent", now)
    main = snapshot.table(spark, store, "postings", now)
    if recent.count() + fresh.count() > (MERGE if share is None else share) * main.count():
        ids = snapshot.table(spark, store, "postings_gone", now).select("node_id").unionByName(gone.select(F.col("id").alias("node_id"))).distinct()
        kept = main.join(ids, "node_id", "left_anti").select(*POSTING).unionByName(recent.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(*POSTING))
        rows = written(kept.unionByName(fresh), "postings")
        return {"postings": snapshot.Bucketed(rows, "lead", "term"), **sums, **_recent(rows.limit(0), gone.limit(0))}
    ids = gone.select(F.lit(None).cast("string").alias("key"), F.col("id").alias("node_id"))
    return {
        "postings_recent": snapshot.Revised(lost, fresh, "lead", "term"),
        "postings_gone": snapshot.Revised(spark.createDataFrame([], "key string, node_id long"), ids, "key", "node_id"),
        **sums,
    }


def index(spark: SparkSession, store: str, prefixes: list[str] | None = None, now: dict | None = None) -> DataFrame:
    """The postings of a version that may match one of the prefixes (all without them): only their buckets are read."""
    now = now or snapshot.current(spark, store)
    leads = None if prefixes is None or any(len(p) < LEAD for p in prefixes) else sorted({p[:LEAD] for p in prefixes})
    match = F.lit(True)
    if prefixes is not None:
        match = F.lit(False)
        for p in prefixes:
            match |= F.col("term").startswith(p)
    main, recent = (snapshot.table(spark, store, t, now, keys=leads).where(match) for t in ("postings", "postings_recent"))
    gone = snapshot.table(spark, store, "postings_gone", now).select("node_id").distinct()
    return main.join(gone, "node_id", "left_anti").select(*POSTING).unionByName(recent.select(*POSTING))


#: Prefixes that are put into the filter of the scan; more of them read all buckets.
ASKED = 200


def search(spark: SparkSession, store: str, queries: DataFrame, kinds: list[str] | None = None, limit: int = 20, now: dict | None = None) -> DataFrame:
    """As search.search over a version's nodes, by its index. queries are (query_id, terms)."""
    now = now or snapshot.current(spark, store)
    found = [r["p"] for r in queries.select(F.explode("terms").alias("p")).where("p <> ''").distinct().limit(ASKED + 1).collect()]
    rows = index(spark, store, found if len(found) <= ASKED else None, now)
    return scoring.best(scoring.scored(rows, snapshot.table(spark, store, "totals", now), queries), kinds, limit)
