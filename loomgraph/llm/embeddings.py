"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import connected_components, written

#: Tables, hashes of a table's code, and buckets of a table besides its own into which a vector goes.
TABLES, HASHES, PROBES = 4, 2, 2
COSINE = 0.98
#: Vectors of a bucket that one task compares with each other; a larger bucket is dealt out as pairs of blocks.
BLOCK = 2048
SMALL = 8


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x (length a power of two) after three rounds of sign flips and the Hadamard transform."""
    for s in signs:
        x = x * s
        width = 1
        while width < x.shape[1]:
            y = x.reshape(len(x), -1, 2, width)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
            width *= 2
        x = x / np.sqrt(x.shape[1])
    return x


def codes(x: np.ndarray, seed: int = 17) -> np.ndarray:
    """int32 (rows, TABLES, 1 + PROBES): each vector's bucket in every table, then its next ones.

    A hash is the closest of the signed axes after a random rotation. The next buckets swap one hash
    for its second closest axis, the hash with the closest runner-up first.
    """
    size = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    rng = np.random.default_rng(seed)
    out = np.zeros((len(x), TABLES, 1 + PROBES), np.int32)
    rows = np.arange(len(x))
    for t in range(TABLES):
        best, gaps = [], []
        for _ in range(HASHES):
            y = _rotated(x, rng.choice([-1.0, 1.0], (3, size)))
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.abs(np.take_along_axis(y, two, 1))
            two = np.where((value[:, 0] >= value[:, 1])[:, None], two, two[:, ::-1])
            sign = np.take_along_axis(y, two, 1) < 0
            best.append(2 * two + sign)
            gaps.append(np.abs(value[:, 0] - value[:, 1]))
        own = np.stack([b[:, 0] for b in best], 1)
        order = np.argsort(np.stack(gaps, 1), axis=1, kind="stable")
        for p in range(1 + PROBES):
            code = own.copy()
            if p:
                swap = order[:, p - 1]
                code[rows, swap] = np.stack([b[:, 1] for b in best], 1)[rows, swap]
            out[:, t, p] = code @ (2 * size) ** np.arange(HASHES)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of x at length 1, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows (label, rep, mult, vector): one row per bucket, with the vector and all its codes."""
    for b in batches:
        label, rep, mult, vector = b.columns
        size = vector.value_lengths().to_numpy()
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            some = vector.take(pa.array(at))
            x = some.flatten().to_numpy().astype(dtype).reshape(len(at), n)
            code = codes(_unit(x))
            raw = [r.tobytes() for r in x]
            packed = [c.tobytes() for c in code]
            each = np.repeat(np.arange(len(at)), TABLES * (1 + PROBES))
            table = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), len(at))
            take = pa.array(each)
            columns = [pa.array(np.full(len(each), n, np.int32)), label.take(pa.array(at)).take(take), pa.array(table), pa.array(code.reshape(-1)), rep.take(pa.array(at)).take(take), mult.take(pa.array(at)).take(take), pa.array(raw, pa.binary()).take(take), pa.array(packed, pa.binary()).take(take)]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "label", "tab", "code", "rep", "mult", "vec", "codes"])


def _first_met(a: np.ndarray, b: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether the pairs with codes a and b (pairs, tables, probes) have this bucket as the first they share."""
    same = a[:, :, :, None] == b[:, :, None, :]
    meets = same.any((2, 3))
    first = meets.argmax(1)
    rows = np.arange(len(a))
    shared = np.where(same[rows, first].any(2), a[rows, first], np.iinfo(np.int32).max).min(1)
    return (first == table) & (shared == code)


def _linked(batches: Iterator[pa.RecordBatch], dtype: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and block pair: links that connect what is near (a, b), and counts (a, n) of links first met here."""
    names = ["dim", "label", "tab", "code", "lo", "hi"]

    def told(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t.column(c).to_numpy() for c in names], 1)
        group = np.r_[0, np.cumsum((key[1:] != key[:-1]).any(1))]
        sizes = np.bincount(group)
        many = sizes[group] > 1
        t, key, group = t.filter(pa.array(many)).combine_chunks(), key[many], np.unique(group[many], return_inverse=True)[1]
        rep, mult, block = (t.column(c).to_numpy() for c in ("rep", "mult", "block"))
        code = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int32).reshape(-1, TABLES, 1 + PROBES)
        sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        raw = t.column("vec").to_pylist()
        links, ends, count = [], [], []

        def counted(i: np.ndarray, j: np.ndarray) -> None:
            """Of near pairs, those met first in this bucket, and in one block pair only."""
            for k in range(0, len(i), 1 << 15):
                a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                own = (block[a] != block[b]) | (key[a, 4] == key[a, 5])
                own &= _first_met(code[a], code[b], key[a, 2], key[a, 3])
                a, b = a[own], b[own]
                ends.extend((rep[a], rep[b]))
                count.extend((mult[b], mult[a]))

        def unit(rows: list[bytes]) -> np.ndarray:
            return _unit(np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1))

        few = sizes[group] <= SMALL if len(group) else np.zeros(0, bool)
        dims = np.unique(key[:, 0]) if len(key) else []
        for d in dims:
            at = np.flatnonzero(few & (key[:, 0] == d))
            if not len(at):
                continue
            x = unit([raw[k] for k in at])
            for o in range(1, min(SMALL, len(at))):
                i = np.flatnonzero(group[at[o:]] == group[at[:-o]])
                i = i[np.einsum("ij,ij->i", x[i], x[i + o]) >= cosine]
                links.append(np.stack([rep[at[i]], rep[at[i + o]]], 1))
                counted(at[i], at[i + o])
        for g in np.flatnonzero(sizes > SMALL):
            x = unit(raw[starts[g] : starts[g + 1]])
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            i, j = np.nonzero(np.triu(near))
            counted(starts[g] + i, starts[g] + j)
            left, queue = np.flatnonzero(near.any(1)), []
            while len(left):
                if queue:
                    k = queue.pop()
                else:
                    k, left = left[0], left[1:]
                hit = near[k, left]
                links.append(np.stack([np.full(hit.sum(), rep[starts[g] + k]), rep[starts[g] + left[hit]]], 1))
                queue += list(left[hit])
                left = left[~hit]
        pairs = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        count = np.concatenate(count) if count else np.zeros(0, np.int64)
        who, where = np.unique(ends, return_inverse=True)
        total = np.zeros(len(who), np.int64)
        np.add.at(total, where, count)
        a = pa.array(np.r_[pairs[:, 0], who])
        b = pa.array(np.r_[pairs[:, 1], np.zeros(len(who), np.int64)], mask=np.r_[np.zeros(len(pairs), bool), np.ones(len(who), bool)])
        return pa.RecordBatch.from_arrays([a, b, pa.array(np.r_[np.zeros(len(pairs), np.int64), total])], ["a", "b", "n"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < 4 * BLOCK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([t.column(c).to_numpy() for c in names], 1)
        cut = np.flatnonzero((key != key[-1]).any(1))
        if len(cut):
            yield told(t.slice(0, cut[-1] + 1))
            held = t.slice(cut[-1] + 1).to_batches()
            rows -= cut[-1] + 1
    if rows:
        yield told(pa.Table.from_batches(held).combine_chunks())


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings (vec_id, embedding, label).

    Vectors link if their labels and lengths are equal and their cosine in double precision reaches
    cosine, and the hashing finds them: candidates share a bucket of some table, and each is verified.
    Equal vectors are one class beforehand. A pair is counted in the first bucket it shares; buckets
    over BLOCK classes are dealt out as pairs of blocks. Null labels and vectors that are null, empty,
    zero or hold null or non-finite parts link with nothing; nor does a row without vec_id, which stays as its own component,
    null, and kept. Rows that repeat a vec_id are vectors of their own and have a row each; where they are equal all of them have the
    component's least id and so are kept. Other columns are ignored; no rows: no rows.
    """
    dtype = "<f8" if isinstance(rows.schema["embedding"].dataType.elementType, T.DoubleType) else "<f4"
    rows = rows.select("vec_id", "embedding", "label")
    sound = F.expr("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    usable = rows.where(F.coalesce(sound, F.lit(False)))
    classes = written(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "vectors")
    label = classes.schema["label"].dataType.simpleString()
    schema = f"dim int, label {label}, tab int, code int, rep long, mult long, vec binary, codes binary"
    hashed = classes.select("label", F.col("rep").cast("long"), "mult", "embedding").mapInArrow(partial(_hashed, dtype=dtype), schema)
    hashed = written(hashed, "buckets")
    keys = ["dim", "label", "tab", "code"]
    hot = hashed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = (
        hashed.join(hot, keys, "left")
        .withColumn("n", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
        .withColumn("block", F.expr("cast(pmod(xxhash64(rep), n) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(*keys, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "mult", "vec", "codes")
    )
    by = [*keys, "lo", "hi"]
    found = written(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(partial(_linked, dtype=dtype, cosine=cosine), "a long, b long, n long"), "links")
    groups = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    told = classes.join(links, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    told = told.select("label", "embedding", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
