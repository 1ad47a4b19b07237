"""Versioned snapshots of the graph tables: buckets of files by path, manifests that list them, and numbered pointers of which the last counts.

A table is one folder, or a folder per bucket of its rows' paths. A version's manifest tells for each table and
bucket which version wrote it, so a version that changes few paths writes few buckets and refers to
older ones for the rest. A version that was made from another is only published if that one is
still the current one.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions besides the current one that a publication leaves, for readers that have begun.
KEPT = 1
#: Buckets of a table, if the build asks for no other number. The manifest keeps it.
BUCKETS = 64
#: Tables that are written at the same time.
WRITERS = 4


class Conflict(RuntimeError):
    """Another version was published since the one that this one was made from."""


@dataclass
class Bucketed:
    """A table in buckets by the column key; rows whose key is null or empty are spread by the column spread."""

    rows: DataFrame
    key: str
    spread: str


@dataclass
class Revised:
    """A bucketed table in which fresh takes the place of the rows that match redo, whose first column is the key.

    everywhere: redo may match rows of any bucket. Else only the buckets of its keys are read and written.
    """

    redo: DataFrame
    fresh: DataFrame
    key: str
    spread: str
    everywhere: bool = False


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all publications so far, last first."""
    fs, folder = _fs(spark, f"{root}/_pointers")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _read(spark: SparkSession, root: str, number: int) -> dict:
    rows = spark.read.option("wholetext", True).text(f"{root}/_pointers/{number:010}").collect()  # a few bytes per table and bucket
    return {**json.loads(rows[0]["value"]), "number": number}


def _bucket(key: str, spread: str, buckets: int) -> Column:
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    by = F.when(name == "", F.col(spread).cast("string")).otherwise(name)
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, key: str, spread: str, buckets: int, path: str) -> list[int]:
    """Writes rows in buckets and tells which there are."""
    placed = rows.withColumn("bucket", _bucket(key, spread, buckets))
    # So that a bucket's row groups hold ranges of what is asked for.
    sort = ["term"] if "term" in rows.columns else ["kind", "at"] if "at" in rows.columns else []
    placed.repartition("bucket").sortWithinPartitions("bucket", *sort).write.partitionBy("bucket").parquet(path)
    fs, folder = _fs(rows.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))


def _parts(root: str, name: str, layout: dict[str, list[int] | None]) -> list[str]:
    return [f"{root}/{version}/{name}" + ("" if b is None else f"/bucket={b}") for version, found in layout.items() for b in ([None] if found is None else found)]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame | Bucketed | Revised], manifest: dict | None = None, base: dict | None = None, buckets: int = BUCKETS) -> str:
    """Writes what is new to a new version, then points to it: readers see the old version or the whole new one.

    base is the manifest that the tables were made from; tables that aren't given are taken from it. If it is no
    longer the current one, nothing is published and Conflict is raised. Without base the version
    follows whatever is there. A pointer is written aside and renamed to its number, which fails if
    another publication has it. Folders that only versions before KEPT refer to are deleted.
    """
    version = uuid.uuid4().hex
    layout = {k: dict(v) for k, v in (base or {}).get("layout", {}).items()}
    schemas = dict((base or {}).get("schemas", {}))
    buckets = (base or {}).get("buckets", buckets)

    def write(item: tuple[str, DataFrame | Bucketed | Revised]) -> tuple[str, dict, dict]:
        name, t = item
        path = f"{root}/{version}/{name}"
        if isinstance(t, Bucketed):
            return name, {version: _write(t.rows, t.key, t.spread, buckets, path)}, t.rows.schema.jsonValue()
        if not isinstance(t, Revised):
            t.write.parquet(path)
            return name, {version: None}, t.schema.jsonValue()
        old = layout[name]
        there = {b for found in old.values() for b in found}
        keys = t.redo.select(F.col(t.redo.columns[0]).alias("k")).select(_bucket("k", "k", buckets).alias("b")).unionByName(t.fresh.select(_bucket(t.key, t.spread, buckets).alias("b")))
        touched = there if t.everywhere else {r["b"] for r in keys.distinct().collect()}  # as many as buckets at most
        dirs = _parts(root, name, {v: [b for b in found if b in touched] for v, found in old.items()})
        shape = StructType.fromJson(schemas[name])
        kept = spark.read.schema(shape).parquet(*dirs) if dirs else spark.createDataFrame([], shape)
        rows = kept.join(t.redo.distinct(), t.redo.columns, "left_anti").select(*shape.names).unionByName(t.fresh.select(*shape.names))
        new = _write(rows, t.key, t.spread, buckets, path)
        left = {v: [b for b in found if b not in touched and b not in new] for v, found in old.items()}
        return name, {v: found for v, found in left.items() if found} | {version: new}, schemas[name]

    with ThreadPoolExecutor(WRITERS) as pool:  # the tables are independent jobs
        for name, parts, shape in pool.map(write, list(tables.items())):
            layout[name], schemas[name] = parts, shape
    told = {**(manifest or {}), "version": version, "layout": layout, "schemas": schemas, "buckets": buckets}
    fs, fresh = _fs(spark, f"{root}/_pointers/.{version}")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    while True:
        last = next(iter(_pointers(spark, root)), 0)
        _, target = _fs(spark, f"{root}/_pointers/{last + 1:010}")
        if base is not None and last != base["number"]:
            fs.delete(fresh, False)
            fs.delete(_fs(spark, f"{root}/{version}")[1], True)
            raise Conflict(f"version {base['number']} of {root} is no longer the current one, which is {last}")
        if not fs.exists(target) and fs.rename(fresh, target):
            break
        if not fs.exists(fresh):
            raise OSError(f"the pointer to version {version} is gone")
    _forget(spark, root)
    return version


def _forget(spark: SparkSession, root: str) -> None:
    """Deletes pointers before KEPT and the current one, and the folders that no other refers to."""
    fs, _ = _fs(spark, root)
    numbers = _pointers(spark, root)
    known = {n: _read(spark, root, n) for n in numbers}
    folders = lambda n: {p for name, layout in known[n]["layout"].items() for p in _parts(root, name, layout)}
    kept = {p for n in numbers[: KEPT + 1] for p in folders(n)}
    versions = {v for n in numbers[: KEPT + 1] for layout in known[n]["layout"].values() for v in layout} | {known[n]["version"] for n in numbers[: KEPT + 1]}
    for old in numbers[KEPT + 1 :]:
        for path in folders(old) - kept:
            fs.delete(_fs(spark, path)[1], True)
        for v in {v for layout in known[old]["layout"].values() for v in layout} - versions:
            fs.delete(_fs(spark, f"{root}/{v}")[1], True)
        fs.delete(_fs(spark, f"{root}/_pointers/{old:010}")[1], False)


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the last publication, with its version and number."""
    numbers = _pointers(spark, root)
    return _read(spark, root, numbers[0]) if numbers else None


def table(spark: SparkSession, root: str, name: str, now: dict | None = None, whole: bool = False, keys: list[str] | DataFrame | None = None) -> DataFrame:
    """A table of the current version, or of the one that now (from current) tells; with whole also its columns that begin with _.

    With keys, a list or a table of one column, only the buckets that these keys fall in are read; other rows of these buckets come along.
    """
    now = now or current(spark, root)
    if now is None or name not in now["layout"]:
        raise FileNotFoundError(f"no {name} in a snapshot in {root}")
    shape = StructType.fromJson(now["schemas"][name])
    layout = now["layout"][name]
    if keys is not None:
        given = keys.toDF("k") if isinstance(keys, DataFrame) else spark.createDataFrame([(k,) for k in keys], "k string")
        asked = given.select(_bucket("k", "k", now["buckets"]).alias("b"))
        wanted = {r["b"] for r in asked.distinct().collect()}
        layout = {v: found and [b for b in found if b in wanted] for v, found in layout.items()}
    dirs = _parts(root, name, layout)
    rows = spark.read.schema(shape).parquet(*dirs) if dirs else spark.createDataFrame([], shape)
    return rows if whole else rows.select(*[c for c in shape.names if not c.startswith("_")])
