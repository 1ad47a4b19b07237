"""Name resolution in tiers: exact name, path, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators.search import search
from loomgraph.scratch import written

LIMIT = 20


def best_first() -> list:
    """Exported before others, symbols before others, short names before long ones, then in order."""
    return [F.desc(F.coalesce("exported", F.lit(False))), F.desc(F.col("kind") == "symbol"), F.length(F.coalesce("qualified_name", "name")), F.col("ord")]


def resolve(nodes: DataFrame, asked: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, tier, position, id) for asked (query_id, name): the first tier that finds anything, best first.

    Tier 1 are nodes of that name or qualified name, tier 2 files whose path is or ends with it
    (ASCII case ignored), tier 3 search hits. Blank names find nothing.
    """
    asked = asked.select("query_id", F.trim("name").alias("asked")).where("asked <> ''")
    names = nodes.select(F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("asked"), *nodes.columns)
    exact = names.join(asked, "asked").drop("asked").withColumn("tier", F.lit(1))
    files = nodes.where("kind = 'file' and file_path is not null")
    tails = F.expr("transform(sequence(1, size(split(lower(file_path), '/'))), i -> array_join(slice(split(lower(file_path), '/'), -i, i), '/'))")
    paths = files.select(F.explode(tails).alias("asked"), *files.columns).join(asked.select("query_id", F.lower(F.translate("asked", "\\", "/")).alias("asked")), "asked").drop("asked").withColumn("tier", F.lit(2))
    named = exact.unionByName(paths.select(*exact.columns))
    cut = Window.partitionBy("query_id", "tier").orderBy("ord")
    named = named.withColumn("n", F.row_number().over(cut)).where(F.col("n") <= limit)
    named = named.withColumn("position", F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(*best_first())))
    named = written(named.select("query_id", "tier", "position", "id"), "named")
    # Only what has no name and no path is searched for.
    rest = asked.join(named.select("query_id").distinct(), "query_id", "left_anti")
    terms = rest.select("query_id", text.search_terms("asked").alias("terms"))
    hits = search(nodes, terms, limit=limit).select("query_id", F.lit(3).alias("tier"), "position", F.col("node_id").alias("id"))
    rows = named.unionByName(hits)
    first = rows.groupBy("query_id").agg(F.min("tier").alias("tier"))
    return rows.join(first, ["query_id", "tier"])
