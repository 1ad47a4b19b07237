"""Byte-level BPE by a rank queue under a hierarchical bitmap, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.pretokens import Memory, gathered, pretokens

NONE = -1
#: Bytes of new pre-tokens that share one queue; a longer pre-token has its own.
TOGETHER = 4 << 20


class RankQueue:
    """Merge ranks in use, lowest first.

    Each rank has a bucket of places (lists of arrays). A bit per rank says that its bucket has
    entries, a bit per 64 ranks that one of their bits is set, and so on up; the next rank is found by
    find-first-set from the top. Entries are not removed when their pair changes: who pops skips them.
    """

    def __init__(self, ranks: int):
        self.levels = []
        while ranks > 1 or not self.levels:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        at = [0, *cuts.tolist(), len(ranks)]
        for (i, j), rank in zip(pairwise(at), ranks[at[:-1]].tolist()):
            if rank in self.buckets:
                self.buckets[rank].append(places[i:j])
            else:
                self.buckets[rank] = [places[i:j]]
                for level in self.levels:
                    rank, bit = divmod(rank, 64)
                    had = level[rank]
                    level[rank] = had | 1 << bit
                    if had:
                        break

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its bucket, in order of place; None when all are empty."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank * 64 + (word & -word).bit_length() - 1
        places = np.unique(np.concatenate(self.buckets.pop(rank)))
        at = rank
        for level in self.levels:
            at, bit = divmod(at, 64)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        return rank, places


class Vocabulary:
    """Byte-level ranks: bytes to id, where an id is also the rank of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {ranks[b[:k]] * self.size + ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NONE."""
        key = left * self.size + right
        i = np.searchsorted(self.pairs, key)
        i[i == len(self.pairs)] = 0
        return np.where(self.pairs[i] == key, self.merged[i], NONE)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each pre-token. A pre-token that is an id's bytes is that id."""
        raw, out, rest, size = [w.encode() for w in words], [None] * len(words), [], 0
        for k, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                out[k] = np.array([whole])
            elif b:
                rest.append(k)
                size += len(b)
            else:
                out[k] = np.zeros(0, np.int64)
            if rest and (size >= TOGETHER or k == len(raw) - 1):
                for i, ids in zip(rest, self._merge([raw[i] for i in rest])):
                    out[i] = ids
                rest, size = [], 0
        if rest:
            for i, ids in zip(rest, self._merge([raw[i] for i in rest])):
                out[i] = ids
        return out

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Words in one linked list, cut at their ends; all places of the lowest rank merge at once."""
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        ends = np.cumsum([len(w) for w in words])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[np.r_[0, ends[:-1]]] = n
        current = np.full(n + 1, NONE)
        there = np.flatnonzero(after < n)
        current[there] = self.rank(ids[there], ids[after[there]])
        there = there[current[there] != NONE]
        queue = RankQueue(self.size)
        if len(there):
            queue.push(current[there], there)
        while (top := queue.pop()) is not None:
            rank, at = top
            at = at[current[at] == rank]
            if len(at) > 1:
                at = _leftmost(at, after)
            gone = after[at]
            ids[at] = rank
            nxt = after[gone]
            after[at] = nxt
            inner = nxt < n
            before[nxt[inner]] = at[inner]
            current[gone] = NONE
            after[gone] = NONE
            left = before[at]
            left = left[left < n]
            pairs = np.unique(np.r_[left, at[inner]])
            current[at] = NONE
            if len(pairs):
                fresh = self.rank(ids[pairs], ids[after[pairs]])
                current[pairs] = fresh
                use = fresh != NONE
                if use.any():
                    queue.push(fresh[use], pairs[use])
        alive = after != NONE
        kept = ids[alive]
        upto = np.r_[0, np.cumsum(alive)][np.r_[0, ends]]
        return [kept[i:j] for i, j in pairwise(upto.tolist())]


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap in a chain, every second one, from the left."""
    chained = np.r_[False, after[at[:-1]] == at[1:]]
    if not chained.any():
        return at
    begin = np.flatnonzero(~chained)
    step = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    return at[step % 2 == 0]


@cache
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@cache
def _known_ids(path: str) -> Memory:
    encode = vocabulary(path).encode
    return Memory(lambda words: [x.astype("<u4").tobytes() for x in encode(words)])


@cache
def _known_forms(path: str) -> Memory:
    """Of each pre-token: how many ids, the ids in decimal, and the bytes that the ids decode to."""
    vocab = vocabulary(path)
    return Memory(lambda words: [(len(x), ",".join(map(str, x)).encode(), b"".join([vocab.bytes[k] for k in x])) for x in (y.tolist() for y in vocab.encode(words))])


def _joined(values: pa.Array, index: pa.Array, counts: np.ndarray, by: bytes) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values.take(index)), pa.scalar(by, values.type))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    memory = _known_forms(path)
    for b in batches:
        for i, j, tokens, counts in pretokens(b.column(1)):
            forms = memory.of(tokens.dictionary.to_pylist())
            size, shown, again = zip(*forms) if forms else ((), (), ())
            shown, again = pa.array(shown, pa.large_binary()), pa.array(again, pa.large_binary())
            size = np.array(size, np.int64)[tokens.indices.to_numpy()]
            upto = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
            sha = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in _joined(v, tokens.indices, counts, by)], pa.string()) for v, by in ((shown, b","), (again, b""))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(upto)), *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for documents (doc_id, text) under the rank file at path.

    Each row is on its own, so nothing is shuffled; a null text counts as empty (no tokens); repeated
    rows give repeated results; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(partial(_digests, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, tokens, counts in pretokens(b.column(1)):
            flat, upto = gathered(_known_ids(path).of(tokens.dictionary.to_pylist()), tokens.indices.to_numpy(), counts)
            ids = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of each text; a null text has no ids."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(partial(_encoded, path=path), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path).bytes
    for b in batches:
        raw = pa.array([b"".join([vocab[k] for k in x or []]) for x in b.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), raw], ["doc_id", "bytes"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary) of rows (doc_id, ids); null ids: no bytes."""
    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(partial(_decoded, path=path), "doc_id long, bytes binary")
