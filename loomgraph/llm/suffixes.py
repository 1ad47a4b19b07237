"""Exact substring dedup over a sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import in_order, tidy
from loomgraph.scratch import written

#: Bytes of a string that counts as repeated.
MATCH = 100
#: Leading bytes by which suffixes are ordered, three words of 8.
LEAD = 24
#: Suffix starts among which each string of MATCH bytes picks one.
SPAN = MATCH - LEAD + 1
#: Suffixes of a bucket, about: a task sorts one bucket in memory.
BUCKET = 1_000_000
#: Classes with one lead that a task compares together; beyond it their strings are sorted as suffixes of their own.
GROUP = 20_000
#: Heads that a task compares at once, unless one group has more.
CHUNK = 4096
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (last axis), as unsigned integers."""
    shape = (*data.shape[:-1], data.shape[-1] - 7)
    return np.ndarray(shape, "<u8", data.data, strides=data.strides)


def _hash(words: np.ndarray, at: list[int], size: int) -> np.ndarray:
    """A 64-bit hash of the words at each of size places plus the offsets at."""
    h = np.zeros((*words.shape[:-1], size), np.uint64)
    for k, o in enumerate(at):
        h += words[..., o : o + size]
        h *= MIX[k % 3]
        h ^= h >> np.uint64(29)
    return h


def suffix_starts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the chosen suffix starts, and the first and last string start each stands for.

    Every string of MATCH bytes chooses the leftmost start in it whose lead has the least hash. Equal
    strings so choose alike, wherever they stand, and the strings of one start are consecutive.
    """
    n = len(text)
    if n < MATCH:
        none = np.zeros(0, np.int64)
        return none, none, none
    lead = _hash(_words(np.frombuffer(text, np.uint8)), list(range(0, LEAD, 8)), n - LEAD + 1)
    least = (lead >> np.uint64(32)).astype(np.uint32)
    where = np.arange(len(least), dtype=np.int32)
    have = 1
    while have < SPAN:
        step = min(have, SPAN - have)
        less = least[step:] < least[:-step]
        where = np.where(less, where[step:], where[:-step])
        least = np.minimum(least[step:], least[:-step])
        have += step
    new = np.r_[True, where[1:] != where[:-1]]
    first = np.flatnonzero(new)
    return where[first].astype(np.int64), first, np.r_[first[1:], len(where)] - 1


#: A suffix: its leading bytes as three words in their order, a 128-bit hash of all bytes that its strings cover, and its text and place.
SUFFIX = ["l0", "l1", "l2", "around", "beyond", "doc_id", "place"]
SUFFIXES = ", ".join(f"{c} long" for c in SUFFIX)


def _leads(raw: bytes, start: np.ndarray) -> list[np.ndarray]:
    """The LEAD bytes from each start on, as words that compare as the bytes do."""
    words = np.ndarray(len(raw) - 7, ">u8", raw, strides=(1,))
    return [(words[start + o].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for o in range(0, LEAD, 8)]


def _halves(digests: bytes) -> np.ndarray:
    """The two words of each 128-bit digest, as two columns."""
    return np.frombuffer(digests, ">i8").reshape(-1, 2).T.astype(np.int64)


def _place(start: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Start, and how far before it the first and the last string start lie, in one number."""
    return (start << 16) | ((start - first) << 8) | (start - last)


def _span(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = place >> 16
    return start - ((place >> 8) & 255), start - (place & 255)


@tidy
def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh128_digest

    def told(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], SUFFIX)

    for b in batches:
        out, rows = [[] for _ in SUFFIX], 0
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            start, first, last = suffix_starts(raw)
            if not len(start):
                continue
            around = b"".join([digest(raw[i : j + MATCH], s - i) for s, i, j in zip(start.tolist(), first.tolist(), last.tolist())])
            for column, x in zip(out, (*_leads(raw, start), *_halves(around), np.full(len(start), doc), _place(start, first, last))):
                column.append(x)
            rows += len(start)
            if rows >= 1 << 16:
                yield told(out)
                out, rows = [[] for _ in SUFFIX], 0
        if rows:
            yield told(out)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the first key, then by the next: a multikey quicksort over words.

    All rows are sorted by one word; only runs of equal words go on to the next one, all runs together.
    """
    order = np.argsort(keys[0])
    value = keys[0][order]
    fresh = np.r_[True, value[1:] != value[:-1]][: len(order)]
    for key in keys[1:]:
        tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        if not len(tied):
            break
        run = np.cumsum(fresh)[tied]
        rows = order[tied]
        by = np.lexsort((key[rows], run))
        rows = rows[by]
        order[tied] = rows
        value = key[rows]
        fresh[tied] |= np.r_[True, value[1:] != value[:-1]]
    return order


def _streamed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by the first column, in tables of at least that many rows that end where its value changes."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


#: What a row of a sorted bucket is: a repeat, the head of a class, one at the bucket's edge, its first row, its last row.
REPEAT, HEAD, EDGE, BORDER, END = range(5)
CLASSES = f"kind int, part int, n long, {SUFFIXES}"


@tidy
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket of suffixes: which repeat an earlier one with all around it, and the heads of classes that share a lead with others.

    n is how many classes of the bucket have the row's lead. What depends on the neighbouring buckets is
    marked: the first row, the last row's key, and the heads of the first and the last lead.
    """
    part = TaskContext.get().partitionId()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    columns = [c.to_numpy() for c in pa.Table.from_batches(held).combine_chunks().columns]
    held.clear()
    order = multikey_order(columns)
    columns = [c[order] for c in columns]
    differs = lambda some: np.r_[True, np.any([c[1:] != c[:-1] for c in some], 0)]
    fresh = differs(columns[:3])
    head = fresh | differs(columns[3:5])
    group = np.cumsum(fresh) - 1
    classes = np.bincount(group[head])[group]
    edge = (group == 0) | (group == group[-1])
    border = np.arange(len(head)) == 0

    def told(at: np.ndarray, kind: int) -> pa.RecordBatch:
        own = [np.full(len(at), kind, np.int32), np.full(len(at), part, np.int32), classes[at], *(c[at] for c in columns)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in own], ["kind", "part", "n", *SUFFIX])

    for kind, rows in ((REPEAT, ~head), (HEAD, head & ~edge & (classes > 1)), (EDGE, head & edge & ~border), (BORDER, border)):
        at = np.flatnonzero(rows)
        for i in range(0, len(at), 1 << 16):
            yield told(at[i : i + (1 << 16)], kind)
    yield told(np.array([len(head) - 1]), END)


def _sorted_classes(suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a written table of suffixes: those that repeat others whole (doc_id, place), and the heads (lead, n, doc_id, place) of leads with several classes.

    Spark samples the splitters and range-partitions the suffixes by their leading bytes, then by what
    decides ties, so that a lead, or a class, of any size spreads over buckets.
    """
    spark = suffixes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // BUCKET))
    classes = written(suffixes.repartitionByRange(parts, *SUFFIX).mapInArrow(_classes, CLASSES), "classes")
    # Two rows per bucket: its last row and its first one, which repeats the last of the bucket before if their keys are equal.
    key = SUFFIX[:5]
    ends = {r["part"]: r for r in classes.where(F.col("kind") == END).collect()}
    firsts = {r["part"]: r for r in classes.where(F.col("kind") == BORDER).collect()}
    same, before = [], None
    for p in sorted(ends):
        if before is not None and all(ends[before][c] == firsts[p][c] for c in key):
            same.append(p)
        before = p
    # The leads at the buckets' edges, two a bucket: how many classes they have in all buckets.
    total: dict[tuple, int] = {}
    for p in ends:
        for lead, n in {tuple(r[c] for c in key[:3]): r["n"] for r in (firsts[p], ends[p])}.items():
            total[lead] = total.get(lead, 0) + n
    joins = F.col("part").isin(same) if same else F.lit(False)
    first = F.col("kind") == BORDER
    whole = classes.where((F.col("kind") == REPEAT) | (first & joins)).select("doc_id", "place")
    lead = F.xxhash64(*key[:3]).alias("lead")
    inner = classes.where(F.col("kind") == HEAD).select(lead, "n", "doc_id", "place")
    several = [(*lead, n) for lead, n in total.items() if n > 1]
    edges = spark.createDataFrame(several, "l0 long, l1 long, l2 long, total long")
    outer = classes.where((F.col("kind") == EDGE) | (first & ~joins)).join(F.broadcast(edges), key[:3]).select(lead, F.col("total").alias("n"), "doc_id", "place")
    return whole, inner.unionByName(outer)


@tidy
def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        raw = [squeeze((t or "").encode()) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), *b.columns[2:]], ["doc_id", "packed", *b.schema.names[2:]])


@tidy
def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, packed, heads): the bytes that each head's strings cover, under its lead."""
    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        out = [[], [], [], []]
        for doc, packed, heads in zip(*(c.to_pylist() for c in b.columns)):
            raw = expand(packed)
            for h in heads:
                start = h["place"] >> 16
                i, j = start - ((h["place"] >> 8) & 255), start - (h["place"] & 255)
                for column, x in zip(out, (h["lead"], doc, i, raw[i : j + MATCH])):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "doc_id", "first", "cover"])


@tidy
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, packed, heads): each string that the heads stand for as a suffix of its own, alone with its bytes."""
    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for doc, packed, heads in zip(*(c.to_pylist() for c in b.columns)):
            raw = expand(packed)
            place = np.array([h["place"] for h in heads], np.int64)
            first, last = _span(place)
            count = last - first + 1
            start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            around = b"".join([xxhash.xxh128_digest(raw[i : i + MATCH]) for i in start.tolist()])
            columns = [*_leads(raw, start), *_halves(around), np.full(len(start), doc), _place(start, start, start)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SUFFIX)


@tidy
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id, first, cover) sorted by key: the strings that an earlier one under the key equals."""
    most = MATCH + SPAN - 1
    at = [*range(0, MATCH - 7, 8), MATCH - 8]
    for t in _streamed(batches, CHUNK):
        doc, first = t.column("doc_id").to_numpy(), t.column("first").to_numpy().astype(np.int64)
        covers = t.column("cover").to_pylist()
        size = np.fromiter(map(len, covers), np.int64, len(covers))
        data = np.frombuffer(b"".join(c.ljust(most, b"\0") for c in covers), np.uint8).reshape(len(covers), most)
        hashes = _hash(_words(data), at, SPAN)
        row, column = np.nonzero(np.arange(SPAN) <= (size - MATCH)[:, None])
        begin = first[row] + column
        repeat = _later(data, row, column, hashes[row, column], doc[row], begin)
        if repeat is None:  # two different strings share a hash: number the strings by their bytes
            number: dict[bytes, int] = {}
            ids = [number.setdefault(covers[r][c : c + MATCH], len(number)) for r, c in zip(row.tolist(), column.tolist())]
            repeat = _later(data, row, column, np.array(ids), doc[row], begin)
        d, s = doc[row[repeat]], begin[repeat]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        run = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)][: len(d)])
        stop = np.r_[run[1:], len(d)][: len(run)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(d[run]), pa.array(s[run], pa.int32()), pa.array(s[stop], pa.int32())], ["doc_id", "first", "last"])


def _later(data: np.ndarray, row: np.ndarray, column: np.ndarray, h: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray | None:
    """Which strings (row, column of data, their hashes, texts and starts) an earlier one equals; None if hashes are equal where bytes aren't."""
    order = np.lexsort((begin, doc, h))
    fresh = np.r_[True, h[order][1:] != h[order][:-1]][: len(order)]
    head = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
    found, head = order[~fresh], head[~fresh]
    take = np.arange(MATCH)
    for i in range(0, len(found), 1 << 16):
        a, b = found[i : i + (1 << 16)], head[i : i + (1 << 16)]
        if not (data[row[a][:, None], column[a][:, None] + take] == data[row[b][:, None], column[b][:, None] + take]).all():
            return None
    return found


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repeated strings' starts, (doc_id, first, last), and the compressed texts, (doc_id, packed, own), of (doc_id, text, own).

    doc_id must be unique; own, whatever it is, goes with the text.

    Suffixes at the chosen starts are range-partitioned by their leading bytes, sorted within the buckets
    by a multikey quicksort, ties by what surrounds them, then by document and place; neighbours are
    compared, also across buckets. Most repeats show there, as whole classes, whatever their size. Only
    heads of classes that share a lead without sharing all around it are compared string by string; where
    more than GROUP classes share a lead, their strings are sorted as suffixes of their own. What is alike
    around a suffix is told by its leading bytes and a 128-bit hash of all.
    """
    rows = docs.select("doc_id", "text")
    # Written, as Spark reads the rows twice: once to sample the splitters.
    whole, heads = _sorted_classes(written(rows.mapInArrow(_suffixes, SUFFIXES), "suffixes"))
    packed = docs.mapInArrow(_squeezed, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType()), docs.schema["own"]]))

    def asked(some: DataFrame) -> DataFrame:
        by_doc = some.groupBy("doc_id").agg(F.collect_list(F.struct("lead", "place")).alias("heads"))
        return packed.join(by_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "packed", "heads")

    covers = asked(heads.where(F.col("n") <= GROUP)).mapInArrow(_covers, "key long, doc_id long, first int, cover binary")
    single = written(covers.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, "doc_id long, first int, last int"), "strings")
    hot = heads.where(F.col("n") > GROUP)
    if not hot.isEmpty():
        alone, _ = _sorted_classes(written(asked(hot).mapInArrow(_strings, SUFFIXES), "hot-strings"))
        whole = whole.unionByName(alone)
    start = F.shiftright("place", 16)
    first, last = (start - F.shiftright("place", k).bitwiseAND(F.lit(255)) for k in (8, 0))
    return whole.select("doc_id", first.cast("int").alias("first"), last.cast("int").alias("last")).unionByName(single), packed


def _runs(spans: pa.ListArray, sizes: list[int]) -> list[list[tuple[int, int]]]:
    """For each text the maximal runs of bytes that strings starting in its spans cover."""
    count = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    inner = spans.flatten()
    first, last = (inner.field(k).to_numpy().astype(np.int64) for k in range(2))
    text = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((first, text))
    text, first, end = text[order], first[order], last[order] + MATCH
    # Texts are laid out apart from each other, so that one running maximum serves all.
    base = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)][text]
    far = np.maximum.accumulate(base + end) if len(end) else end
    new = np.r_[True, base[1:] + first[1:] > far[:-1]][: len(text)]
    at = np.flatnonzero(new)
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    ends = far[np.r_[at[1:], len(text)][: len(at)] - 1] - base[at]
    for t, i, j in zip(text[at].tolist(), first[at].tolist(), ends.tolist()):
        out[t].append((i, j))
    return out


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for i, j in runs:
        kept.append(raw[at:i])
        at = j
    return b"".join([*kept, raw[at:]])


@tidy
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        rows = []
        texts = [expand(p) for p in b.column(1).to_pylist()]
        for doc, raw, runs in zip(b.column(0).to_pylist(), texts, _runs(b.column(2), [len(t) for t in texts])):
            rows.append((doc, len(raw), sum(j - i for i, j in runs), len(runs), hashlib.sha256(_cut(raw, runs)).hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()])], names)


@tidy
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        kept, texts = [], [expand(p) for p in b.column(1).to_pylist()]
        for raw, runs in zip(texts, _runs(b.column(2), [len(t) for t in texts])):
            whole = [(_char(raw, i, 1), _char(raw, j, -1)) for i, j in runs]
            kept.append(_cut(raw, [(i, j) for i, j in whole if i < j]).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], ["own", "text"])


def _char(raw: bytes, at: int, step: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


def _with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, packed, spans, own): rows by numbers of their own in the order of doc_id, null last, and what else they hold as own."""
    found, packed = repeats(in_order(docs))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return packed.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "packed", "spans", "own")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents (doc_id, text).

    A byte goes if a string of MATCH bytes over it also starts earlier, in a smaller doc_id or before
    in its own text. Rows of one doc_id, or of none, are texts of their own, in some order; null comes
    last. Null texts are empty, short texts lose nothing, no rows give no rows. Other columns are ignored.
    """
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rows = _with_spans(docs.select("doc_id", "text")).select("own.doc_id", "packed", "spans")
    return rows.mapInArrow(_digests, kinds)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with text without the removed bytes; a character that is only partly in a removed run stays."""
    rows = _with_spans(docs)
    out = rows.select("own", "packed", "spans").mapInArrow(_texts, T.StructType([rows.schema["own"], T.StructField("text", T.StringType())]))
    return out.select("own.*", "text").select(*docs.columns)
