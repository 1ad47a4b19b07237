"""What the operators share: numbered rows and connected components over written tables, and tasks that leave no memory behind."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import drop, write, written


def tidy(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that, when its batches end, gives the memory it freed back to the system.

    Python workers are used again by later stages, and what their allocators keep stands beside the executor's heap.
    """

    @wraps(task)
    def run(*given, **options) -> Iterator[pa.RecordBatch]:
        yield from task(*given, **options)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return run


def numbered(docs: DataFrame, row: str = "row") -> DataFrame:
    """docs with a number of each row's own, written once: doc_id may be null or repeat. docs has no column of that name."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def _unique(docs: DataFrame) -> bool:
    """Whether doc_ids tell all rows apart."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty()


def keyed(docs: DataFrame, row: str = "row") -> DataFrame:
    """docs with a key of each row's own: its doc_id where these are unique, else a number, for which docs is written once."""
    return docs.withColumn(row, F.col("doc_id").cast("long")) if _unique(docs) else numbered(docs, row)


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own): rows under numbers of their own in the order of doc_id, null last; own holds what else they have, doc_id too.

    Unique doc_ids are such numbers already, so docs is read as it is; else the rows are sorted, numbered
    and written, as doc_ids that are null or repeat can't tell them apart.
    """
    other = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(c for c in docs.columns if c not in ("doc_id", "text")))
    rows = docs.select(other.alias("own"), "text")
    if _unique(docs):
        return rows.select("own.doc_id", "text", "own")
    order = [F.col("own.doc_id").asc_nulls_last(), F.xxhash64("text")]  # the hash spreads rows of one doc_id
    rows = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return written(rows.select(F.monotonically_increasing_id().alias("doc_id"), "text", "own"), "rows")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_min(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return edges.join(least, "u")


def _pairs(rows: DataFrame, *of: tuple[str, str]) -> DataFrame:
    """(u, v) of each of those pairs of columns, by one pass over rows: a union would plan and run what makes them for each."""
    return rows.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in of))).alias("e")).select("e.u", "e.v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the least node reachable.

    Alternating large-star and small-star rounds: each is a combined minimum per node and an
    equi-join, so a node with many neighbours is never gathered, and AQE may split its rows. A round drops
    repeated edges once, at its end, and is written to the shared folder. Ends when the edge set no longer
    changes. Null ends and self-loops are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    kinds, path = now.schema, write(now, "edges")
    now = spark.read.schema(kinds).parquet(path)
    seen = _fingerprint(now)
    while seen[0]:
        large = _with_min(_pairs(now, ("u", "v"), ("v", "u"))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _pairs(_with_min(large), ("v", "m"), ("u", "m"))
        old, path = path, write(small.where("u <> v").distinct(), "edges")
        drop(spark, old)
        now = spark.read.schema(kinds).parquet(path)
        last, seen = seen, _fingerprint(now)
        if seen == last:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
