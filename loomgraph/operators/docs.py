"""Documents and what they mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text

MAX_MENTIONS, MAX_MATCHES = 50, 3


def described(docs: DataFrame) -> DataFrame:
    """(path, subkind, title, summary) of documents (path, body)."""
    return docs.select("path", text.doc_class("path").alias("subkind"), text.doc_title("body", "path").alias("title"), text.summary("body").alias("summary"))


def mentions(docs: DataFrame, nodes: DataFrame, most: int = MAX_MENTIONS) -> DataFrame:
    """(doc_id, dst, how, position) for docs (doc_id, path, body): files by path, then symbols by name.

    A name with more than MAX_MATCHES matches says nothing. A document has at most `most` mentions.
    """
    files = nodes.where("kind = 'file'").select(F.col("id").alias("dst"), F.col("file_path").alias("word"), "ord")
    symbols = nodes.where("kind = 'symbol'").select(F.col("id").alias("dst"), "ord", F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("word"))
    few = symbols.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") <= MAX_MATCHES).select("word")
    by_path = docs.select("doc_id", "path", F.posexplode(text.mentioned_paths("body")).alias("at", "word")).where("word <> path").join(files, "word").withColumn("how", F.lit(1))
    by_name = docs.select("doc_id", "path", F.posexplode(text.mentioned_names("body")).alias("at", "word")).join(few, "word").join(symbols, "word").withColumn("how", F.lit(2))
    rows = by_path.unionByName(by_name).groupBy("doc_id", "dst").agg(F.min(F.struct("how", "at", "ord")).alias("r"))
    w = Window.partitionBy("doc_id").orderBy("r", "dst")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("doc_id", "dst", F.when(F.col("r.how") == 1, "file").otherwise("symbol").alias("how"), "position")
