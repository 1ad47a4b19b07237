"""Importance resampling toward a target distribution, over hashed n-grams of words."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.rank import placed
from loomgraph.scratch import written

#: Words over the UTF-8 bytes of lower-cased text: digits, a to z, and all beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Stands between the texts of a batch; it is in no word.
SENTINEL = b"\n"
#: Bytes of texts that are joined (a longer text is a batch of its own), and words that are taken from them at a time.
JOINED, TAKEN = 1 << 20, 1 << 17
#: Width of the bins of scores by which the draw finds who may be in it.
BIN = 64
WEIGHED = "doc_id long, n_features long, n_words long, weight long, score long"


def _joined(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are joined into one batch."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or b"") > JOINED:
            yield first, i
            first, size = i, 0
        size += len(t or b"") + 1
    if texts:
        yield first, len(texts)


def features(texts: list[bytes | None], low: int, high: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, document) of the features, and the document of each word, for parts of a batch; documents count from 0.

    The texts are joined with sentinels, one pass of the pattern finds the words of all of them, and
    their starts searched among the documents' starts give their documents. A run of words is a
    feature if its first and last word are of one document. A part takes the last words of the part
    before along, so a text of any length needs little memory beside its own bytes.
    """
    whole = SENTINEL.join([t or b"" for t in texts]).lower()  # bytes.lower() changes A to Z alone
    starts = np.cumsum([0] + [len(t or b"") + 1 for t in texts[:-1]])
    found = WORD.finditer(whole)
    words, doc = [], np.zeros(0, np.int64)
    while part := [(m.start(), m.group()) for m in islice(found, TAKEN)]:
        at = np.searchsorted(starts, np.fromiter((s for s, _ in part), np.int64, len(part)), "right") - 1
        kept = len(words)
        words += [w for _, w in part]
        doc = np.concatenate([doc, at])
        bucket, owner = [], []
        for n in range(low, high + 1):
            first = max(0, kept - n + 1)
            own = doc[first : len(doc) - n + 1]
            inside = own == doc[first + n - 1 :]
            if n == 1:
                sums = np.fromiter(map(zlib.crc32, words[first:]), np.int64, len(words) - first)
            else:
                sums = np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) for i in range(first, len(words) - n + 1)), np.int64, max(0, len(words) - n + 1 - first))
            bucket.append(sums[inside] % buckets)
            owner.append(own[inside])
        yield np.concatenate(bucket), np.concatenate(owner), at
        last = max(0, len(words) - high + 1)
        words, doc = words[last:], doc[last:]


def _counted(batches: Iterator[pa.RecordBatch], low: int, high: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for b in batches:
        texts = b.column(0).to_pylist()
        for i, j in _joined(texts):
            for bucket, _, _ in features(texts[i:j], low, high, buckets):
                total += np.bincount(bucket, minlength=buckets)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])


def counts(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts (text) fall in each bucket. A task gives one row per bucket at most, and so does the result."""
    each = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(partial(_counted, low=low, high=high, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(all_: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: 1000 times the log of how much likelier the target has it, both smoothed by one, rounded down."""
    k = len(all_)
    s, t = float(all_.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)))) for a, b in zip(all_, target)], np.int64)


def _noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of a document, in thousandths, from the hash of seed and doc_id (null: empty)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(batches: Iterator[pa.RecordBatch], worth: np.ndarray, low: int, high: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        n, words, total = (np.zeros(len(ids), np.int64) for _ in range(3))
        for i, j in _joined(texts):
            for bucket, doc, of_word in features(texts[i:j], low, high, len(worth)):
                n[i:j] += np.bincount(doc, minlength=j - i)
                words[i:j] += np.bincount(of_word, minlength=j - i)
                total[i:j] += np.bincount(doc, weights=worth[bucket], minlength=j - i).astype(np.int64)  # whole numbers, below 2**53
        weight = total // np.maximum(n, 1)
        score = weight + np.array([_noise(seed, d) for d in ids], np.int64).reshape(-1)
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n, words, weight, score))], ["doc_id", "n_features", "n_words", "weight", "score"])


def weighed(docs: DataFrame, worth: np.ndarray, low: int = 1, high: int = 1, seed: int = 2024) -> DataFrame:
    """WEIGHED of docs (doc_id, text): weight is the mean gain of a text's features, rounded down; score adds the noise."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_weighed, worth=worth, low=low, high=high, seed=seed), WEIGHED)


def drawn(rows: DataFrame, share: int = 10, least: int = 20) -> DataFrame:
    """rows (WEIGHED, written) with rank: 1, 2, 3 ... for the share (in percent) of those with so many words that score highest, else null.

    Ties go to the smaller doc_id, null last, then to the row written first. Counts by bins of scores, of which there are a few
    thousand at most as a score is a sum of logs, tell which bins can be drawn from; only their rows are sorted.
    """
    able = F.col("n_words") >= least
    bin_ = F.floor(F.col("score") / BIN)
    bins = sorted(((r["bin"], r["count"]) for r in rows.where(able).groupBy(bin_.alias("bin")).count().collect()), reverse=True)
    want = sum(n for _, n in bins) * share // 100
    above, cut = 0, None
    for b, n in bins:
        if above >= want:
            break
        above, cut = above + n, b
    none = F.lit(None).cast("long")
    if cut is None:
        return rows.withColumn("rank", none)
    near = able & (bin_ >= cut)
    top = placed(rows.where(near), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "rank", "long")
    top = top.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    return top.select(*rows.columns, "rank").unionByName(rows.where(~near).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024, share: int = 10, least: int = 20) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) of docs (doc_id, text), resampled toward target (text).

    Features are runs of low to high words. A null text has none and weighs 0; null and repeated doc_ids are rows of their own,
    and share their noise. Other columns are ignored; an empty docs gives no rows, an empty target counts
    nothing. Two passes over the texts; between them one number per bucket passes the driver.
    """
    worth = gains(counts(docs, low, high, buckets), counts(target, low, high, buckets))
    rows = weighed(docs, worth, low, high, seed).withColumn("row", F.monotonically_increasing_id())
    return drawn(written(rows, "weighed"), share, least).drop("row")
