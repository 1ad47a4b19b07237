"""Several repositories in one pair of tables, told apart by repo_id."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.plans import snapshot


def merged(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """The tables of repositories as one, with their repo_id."""
    out = [rows.withColumn("repo_id", F.lit(repo_id).cast("long")) for repo_id, rows in parts]
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows, allowMissingColumns=True)
    return whole


def opened(spark: SparkSession, stores: list[tuple[str, str]], note: Callable[[str], None] = print) -> tuple[DataFrame, DataFrame, dict[int, str]]:
    """Nodes and edges of the stores (name, folder) of a workspace as one graph, and the names by repo_id.

    A store that is missing or can't be read is noted and left out, so that it doesn't take the others
    down. Ids are made unlike between stores, so no edge crosses them.
    """
    nodes, edges, names = [], [], {}
    for k, (name, folder) in enumerate(stores, 1):
        try:
            now = snapshot.current(spark, folder)
            if now is None:
                note(f"{name}: no snapshot in {folder}")
                continue
            own = [snapshot.table(spark, folder, t, now) for t in ("nodes", "edges")]
            for rows in own:
                rows.limit(1).collect()  # a broken file shows here, not in the middle of a query
        except (PySparkException, Py4JError, OSError, ValueError) as e:
            note(f"{name}: {folder} can't be read: {str(e).splitlines()[0]}")
            continue
        apart = lambda c: F.xxhash64(F.lit(k), c).alias(c)  # noqa: B023, E731
        names[k] = name
        nodes.append((k, own[0].select(apart("id"), *[c for c in own[0].columns if c != "id"])))
        edges.append((k, own[1].select(apart("src"), apart("dst"), *[c for c in own[1].columns if c not in ("src", "dst")])))
    if not names:
        return spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES), names
    return merged(nodes), merged(edges), names


def within_repos(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are in one repository."""
    repo = nodes.select("id", "repo_id")
    a = edges.drop("repo_id").join(repo.withColumnsRenamed({"id": "src", "repo_id": "ra"}), "src")
    both = a.join(repo.withColumnsRenamed({"id": "dst", "repo_id": "rb"}), "dst")
    return both.where("ra = rb").drop("ra", "rb")
