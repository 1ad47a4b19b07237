"""Quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import tidy, written

#: The bound on what is learned from: labelled documents and bytes of a class, first by hash of the doc_id, and bytes of one of them.
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = 3000, 16 << 20, 64 << 10
#: Bytes of a dictionary, and the level at which texts are compressed with it.
DICTIONARY, LEVEL = 1 << 20, 9


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the logistic curve from the size difference they give to a score. Without both classes: 0.5 for all."""

    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    """One for the bad and one for the good dictionary. A task makes its own, as a Python worker would keep their tables through all later stages."""
    out = []
    for raw in (model.bad, model.good):
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)  # once, not for each text
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def differences(texts: list[bytes], compressors: list) -> np.ndarray:
    """Per text: how many bytes smaller it gets by the good dictionary than by the bad one, a byte of text."""
    return np.array([(len(compressors[0].compress(t)) - len(compressors[1].compress(t))) / (len(t) + 16) for t in texts], float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps that are halved until the loss falls."""
    w = np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).mean() + ridge * (w @ w) / 2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


@tidy
def _measured(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    compressors = _compressors(model)
    for b in batches:
        found = differences([t.encode() for t in b.column(2).to_pylist()], compressors)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64())], ["quality", "place", "difference"])


def learned(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Learns from labelled documents (labels: doc_id, quality), of those usable holds for.

    Of each class at most SAMPLE documents and SAMPLE_BYTES bytes count, none of more than TEXT_BYTES; a
    class that has fewer than two such texts gives its shortest ones instead. Half make the dictionaries,
    for which their first DICTIONARY bytes reach the driver, and the other half, which these haven't seen,
    the curve; it is compressed in tasks. Labels that are null or
    contradict each other don't count, nor do labels without a text. Where a class has fewer than two
    texts within SAMPLE_BYTES, the model knows nothing and scores 0.5.
    """
    docs = docs.select("doc_id", "text")
    rows = labels.where("doc_id is not null and quality is not null")
    rows = rows.where(usable) if usable is not None else rows
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most and quality in (0, 1)")
    # Documents only, as labels may lack theirs; ids before texts, so that only the sample's texts move.
    there = docs.where("text is not null").groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    able = rows.select("doc_id", "quality").join(there, "doc_id").where(F.col("size") <= SAMPLE_BYTES)
    short = F.col("size") <= TEXT_BYTES
    usual = {r["quality"] for r in able.where(short).groupBy("quality").count().where("count > 1").collect()}  # two rows at most
    hashed = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [able.where((F.col("quality") == q) & short).orderBy(*hashed) if q in usual else able.where(F.col("quality") == q).orderBy("size", *hashed) for q in (0, 1)]
    chosen = F.broadcast(first[0].limit(SAMPLE).unionByName(first[1].limit(SAMPLE)))  # 2 * SAMPLE rows at most
    texts = docs.where("text is not null").join(chosen, "doc_id").select("doc_id", "quality", "text", F.xxhash64("doc_id").alias("h"))
    size = F.when(F.col("quality").isin(*usual), 0).otherwise(F.octet_length("text")) if usual else F.octet_length("text")
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy(size, "h", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
    found = texts.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES)
    # Within each class every second text, so that neither half can lack a class that has two.
    place = F.row_number().over(Window.partitionBy("quality").orderBy("h", "doc_id", "text"))
    before = Window.partitionBy("quality", "odd").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    halves = found.withColumn("place", place).withColumn("odd", F.col("place") % 2 == 1)
    halves = halves.withColumn("start", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)))
    halves = written(halves.select(F.col("quality").cast("int").alias("quality"), "place", "odd", "start", "text"), "quality-sample")
    # The driver gets what the dictionaries hold, and a number for each text of the other half.
    known = sorted(halves.where(F.col("odd") & (F.col("start") < DICTIONARY)).select("quality", "place", "text").collect())
    bad, good = (b"\n".join(r["text"].encode() for r in known if r["quality"] == q)[:DICTIONARY] for q in (0, 1))
    model = Model(good, bad)
    asked = halves.where(~F.col("odd")).select("quality", "place", "text")
    rest = sorted(asked.mapInArrow(partial(_measured, model=model), "quality int, place int, difference double").collect())
    if {r["quality"] for r in rest} != {0, 1}:
        return Model()
    x, y = (np.array([r[name] for r in rest], float) for name in ("difference", "quality"))
    scale = x.std() + 1e-9
    w = _logistic(np.c_[np.ones(len(x)), x / scale], y)
    return Model(good, bad, (float(w[0]), float(w[1] / scale)))


def scores(model: Model, texts: list[bytes], compressors: list) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), 0.5)
    z = model.weights[0] + model.weights[1] * differences(texts, compressors)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@tidy
def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    compressors = _compressors(model) if model.weights else []
    for b in batches:
        found = scores(model, [(t or "").encode() for t in b.column(0).field("text").to_pylist()], compressors)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["own", "score"])


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(own, score) of rows (with text): a struct of all their columns, and a score, 0 to 1, higher for text like the good one.

    A null text is empty, and the empty text has the score that the curve gives to no difference. Rows are
    independent; the model, two dictionaries and two numbers, travels with the task.
    """
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own"))
    return own.mapInArrow(partial(_scored, model=model), T.StructType([own.schema["own"], T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents, learned only from rows that are not held out.

    Every row has its own result, whether its doc_id is null or repeats; a null doc_id is not held out and has no label. Equal
    texts have equal scores, a null text that of the empty one. Without labels of both classes all score
    0.5; no documents: no rows.
    """
    model = learned(docs, labels, ~held_out(F.col("doc_id")))
    out = scored(docs.select("doc_id", "text"), model).select("own.doc_id", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
