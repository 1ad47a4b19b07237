"""Tables written between the steps of a job, in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Where that is unset, a temporary folder, but only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("loomgraph.scratch", None) or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("loomgraph.scratch", base)
    return f"{base.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"


def write(df: DataFrame, name: str) -> str:
    """df as a Parquet table in a new folder, and that folder."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: cuts the lineage and outlives executors. It stays until clear()."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that no plan reads any more."""
    _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this application; results that haven't been written or collected by then are lost."""
    _delete(spark, root(spark))
