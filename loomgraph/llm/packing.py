"""Sequence packing, shortest pack first over the length histogram."""

from __future__ import annotations

import heapq
import os
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import tidy, written
from loomgraph.llm.pretokens import Memory, gathered, pretokens

#: Pieces of one length that one task ranks together, about.
RANKED = 4096
#: Pre-tokens that the library gets at once: a Python worker keeps the memory that the most of them took.
TOGETHER = 8192


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _known(path: str) -> Memory:
    t = _tokenizer(path)
    forms = [struct.Struct(f"<{n}I").pack for n in range(64)]  # most pre-tokens have a few ids
    one = lambda ids: forms[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
    parts = lambda words: (words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER))
    return Memory(lambda words: [one(e.ids) for part in parts(words) for e in t.encode_batch_fast(part, add_special_tokens=False)])


def _encoded(texts: pa.Array, path: str, at_once: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices [i, j) of texts (as pretokens has them): their ids, one text after the other, and where each begins and the last ends.

    A text with the string of an added token goes through the library as a whole, which makes it that token's id.
    """
    added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    special = np.zeros(len(texts), bool)
    for t in added:
        special |= pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
    for i, j, tokens, counts in pretokens(texts, at_once):
        flat, upto = gathered(_known(path).of(tokens.dictionary.to_pylist()), tokens.indices.to_numpy(), counts)
        if special[i:j].any():
            each = np.split(flat, upto[1:-1])
            for k in np.flatnonzero(special[i:j]):
                each[k] = np.array(_tokenizer(path).encode(texts[i + int(k)].as_py(), add_special_tokens=False).ids, "<u4")
            flat, upto = np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        yield i, j, flat, upto


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int, with_ids: bool, at_once: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, flat, upto in _encoded(b.column(1), path, at_once):
            flat = np.insert(flat, upto[1:], end)
            upto = upto + np.arange(len(upto))
            total = np.diff(upto)
            cuts = -(-total // size)
            doc = np.repeat(np.arange(j - i), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
            length = np.minimum(size, total[doc] - start)
            begin = upto[doc] + start
            raw = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist())]
            columns = {"doc_id": b.column(0).slice(i, j - i).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total[doc])}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(flat)], pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 0, with_ids: bool = False, at_once: int | None = None) -> DataFrame:
    """Each text's ids under the tokenizer file at path, then the id end, cut every size ids; one row per piece.

    No special tokens are added; where a text holds the string of one, the library's default makes it that token.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(partial(_pieces, path=path, size=size, end=end, with_ids=with_ids, at_once=at_once), schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how many sequences have each.

    Lengths go longest first; each goes to the patterns with the most room, which are counted, not
    listed one by one; where none has room it opens its own. Each length adds two patterns at most.
    """
    open_, room, done = defaultdict(list), [], []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while room and not open_[-room[0]]:
                heapq.heappop(room)
            if room and -room[0] >= length:
                free = -room[0]
                pattern, count = open_[free].pop()
                use = min(count, left)
                if count > use:
                    open_[free].append((pattern, count - use))
            else:
                free, pattern, use = size, (), left
            left -= use
            free -= length
            if free:
                if not open_[free]:
                    heapq.heappush(room, -free)
                open_[free].append(((*pattern, length), use))
            else:
                done.append(((*pattern, length), use))
    return sorted(done + [x for xs in open_.values() for x in xs], reverse=True)


def _slots(found: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) by which its pieces are placed by rank."""
    out, used, first = defaultdict(list), defaultdict(int), 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            out[length].append((used[length], first, offset))
            used[length] += count
            offset += length
        first += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


@tidy
def _placed(batches: Iterator[pa.RecordBatch], slots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            s = slots[int(n)]
            k = np.searchsorted(s[:, 0], rank[at], "right") - 1
            seq[at] = s[k, 1] + rank[at] - s[k, 0]
            offset[at] = s[k, 2]
        keep = b.drop_columns(["rank"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(seq), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])


def pack(rows: DataFrame, size: int = 1024, row: str | None = None) -> DataFrame:
    """rows with sequence_id and offset: pieces (length from 1 to size) packed into sequences of at most size.

    The histogram and the patterns are the only things on the driver: one entry per length, and two
    patterns per length at most. Pieces get a rank among those of their length from row numbers within
    blocks and the blocks' running counts, so that no task ranks all pieces of a common length. rows
    are read twice: give a written table. row names a column that tells all rows apart and spreads them over blocks; without it doc_id and start do, or
    the length. Repeated rows are pieces of their own; no rows: no rows.
    """
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    blocks = max(1, -(-sum(counts.values()) // RANKED))
    slots = _slots(patterns(counts, size))
    order = [row] if row else [c for c in ("doc_id", "start") if c in rows.columns]
    dealt = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64({', '.join(order) or 'length'}), {blocks}) as int)"))
    per = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = per.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "block").orderBy(*order or ["length"])) - 1
    ranked = dealt.withColumn("local", local).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("local"))
    out = ranked.select(*rows.columns, "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return out.mapInArrow(partial(_placed, slots=slots), f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, size: int = 1024, end: int = 0, at_once: int | None = None) -> DataFrame:
    """The pieces of documents (doc_id, text), placed. at_once: bytes of text that a task splits at once, 8 MB if not given; fewer take less memory and more time.

    A null or empty text is the one id end. Null and repeated doc_ids are documents of their own, as pieces have numbers. Other
    columns are ignored.
    """
    numbered = pieces(docs, path, size, end, at_once=at_once).withColumn("row", F.monotonically_increasing_id())
    return pack(written(numbered, "pieces"), size, "row").drop("row")
