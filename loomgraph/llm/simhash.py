"""SimHash near-dedup over an inverted index of byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import connected_components, numbered, tidy, written

BYTES = 8
#: Fingerprints that differ in at most RADIUS bits agree in at least BYTES - RADIUS of their bytes.
RADIUS = 4
#: A block of an index list that one task compares; a longer list is dealt out as pairs of blocks.
BLOCK = 4096
#: Groups up to this size are compared by offset, all groups of a batch at once.
SMALL = 8
#: Rows of an index partition that are compared at once, unless one list has more.
STREAMED = 50_000


def _thirds() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions hold one of them.

    Positions fall into three groups in a ring; a triple lies in one group, or has two positions in
    a group and one in the next (Turan's construction): 20 of the 56 triples.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(BYTES), 3):
        g = sorted(group[i] for i in t)
        if len(set(g)) == 1:
            out.append(t)
        elif len(set(g)) == 2:
            twice = max(g, key=g.count)
            once = min(g, key=g.count)
            if (twice + 1) % 3 == once:
                out.append(t)
    return out


TRIPLES = _thirds()


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles; 0 without words."""
    if not text:
        return 0
    parts = text.encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    n = len(parts)
    if n <= words:
        h = [xxhash.xxh64_intdigest(line, seed)]
    else:
        digest = xxhash.xxh64_intdigest
        h = [digest(line[i : j - 1], seed) for i, j in zip([0, *ends], ends[words - 1 :])]
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.array(h[k : k + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h)).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text. Null and word-free texts get 0."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(partial(_fingerprints, words=words), "doc_id long, fp long")


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of the last axis of x, the xor of two rows, are equal in both."""
    return (np.ascontiguousarray(x).view(np.uint8) == 0).sum(-1)


def _near(a: np.ndarray, b: np.ndarray, least: int | None) -> np.ndarray:
    """Whether rows (fp, node, checks...) are near: first the tally of equal bytes of fp, then, for those that
    reach it, the differing bits of fp, or the equal bytes of the checks if least says how many they need."""
    x = a[..., 0] ^ b[..., 0]
    out = _equal_bytes(x[:, None]) >= BYTES - RADIUS
    at = np.flatnonzero(out)
    if least is None:
        out[at] = np.bitwise_count(x[at].view(np.uint64)) <= RADIUS
    else:
        a = a[at] if a.ndim > 1 else a
        out[at] = _equal_bytes(a[..., 2:] ^ b[at][:, 2:]) >= least
    return out


def _forest(rows: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the near pairs among rows, fewer than there are rows: a breadth-first walk."""
    left, queue, links = np.arange(len(rows)), [], []
    while len(left):
        if queue:
            i = queue.pop()
        else:
            i, left = left[0], left[1:]
        hit = _near(rows[i], rows[left], least)
        found = left[hit]
        links += [(i, j) for j in found]
        queue += list(found)
        left = left[~hit]
    out = np.array(links, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


@tidy
def spanning_links(batches: Iterator[pa.RecordBatch], least: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, fp, node, checks...), sorted by the first three: links between the nodes of near rows."""

    def links(rows: np.ndarray) -> pa.RecordBatch:
        group = np.r_[0, np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(1))]
        sizes = np.bincount(group)
        own, left, right = np.ascontiguousarray(rows[:, 3:]), [], []
        few = sizes[group] <= SMALL
        for o in range(1, min(SMALL, len(rows))):
            i = np.flatnonzero((group[o:] == group[:-o]) & few[o:])
            i = i[_near(own[i], own[i + o], least)]
            left.append(own[i, 1])
            right.append(own[i + o, 1])
        starts = np.r_[0, np.cumsum(sizes)]
        for g in np.flatnonzero(sizes > SMALL):
            part = own[starts[g] : starts[g + 1]]
            i, j = _forest(part, least)
            left.append(part[i, 1])
            right.append(part[j, 1])
        ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])

    held, rows = [], 0
    for b in batches:
        held.append(np.stack([c.to_numpy() for c in b.columns], 1))
        rows += b.num_rows
        if rows < STREAMED:
            continue
        table = np.concatenate(held)
        cut = np.flatnonzero((table[:, :3] != table[-1, :3]).any(1))
        cut = cut[-1] + 1 if len(cut) else 0
        held, rows = [table[cut:]], len(table) - cut
        if cut:
            yield links(table[:cut])
    if rows:
        yield links(np.concatenate(held))


def near_links(reps: DataFrame, prints: list[str], checks: list[str] = (), least: int | None = None) -> DataFrame:
    """Links (a, b) that connect the nodes of reps (node, prints, checks) that are near, transitively.

    Rows are near if one of their prints agrees in BYTES - RADIUS bytes and then differs in at most
    RADIUS bits, or, with checks, if these agree in at least `least` bytes together. The inverted index
    lists each print under three positioned bytes (a list for a single byte would hold a 256th of all
    rows). Any pair that shares BYTES - RADIUS bytes meets in a list; there the shared bytes of the
    pair are tallied and the pair is verified. A list longer than BLOCK is dealt out as pairs of
    blocks, so no task holds an unbounded list, and only a spanning forest of each block leaves it.
    """
    entries = []
    for p, name in enumerate(prints):
        byte = [F.shiftrightunsigned(name, 8 * (BYTES - 1 - i)).bitwiseAND(F.lit(255)) for i in range(BYTES)]
        for k, (i, j, m) in enumerate(TRIPLES):
            key = F.lit((p * len(TRIPLES) + k) << 24) + byte[i] * (1 << 16) + byte[j] * (1 << 8) + byte[m]
            entries.append(F.struct(key.alias("key"), F.col(name).alias("fp")))
    index = reps.select("node", *checks, F.explode(F.array(*entries)).alias("e")).select("e.key", "e.fp", "node", *checks)
    hot = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    dealt = (
        index.join(hot, "key", "left")
        .withColumn("n", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
        .withColumn("c", F.expr("cast(pmod(xxhash64(node), n) as int)"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("c", "d").cast("long").alias("lo"), F.greatest("c", "d").cast("long").alias("hi"), "fp", "node", *checks)
    )
    spread = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return spread.mapInArrow(partial(spanning_links, least=least), "a long, b long").distinct()


def simhash_components(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for documents (doc_id, text): groups linked within RADIUS bits.

    Rows with one doc_id more than once each get a row. Null, empty and word-free texts have
    fingerprint 0 and link like any other. A null doc_id links too; a group without any doc_id has a
    null component_id. Other columns are ignored. No rows: no rows.
    """
    fps = written(fingerprints(docs, words), "simhash")
    # A node is a fingerprint: equal ones are one node, with or without doc_ids.
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-reps")
    groups = connected_components(near_links(reps.select("fp", F.col("fp").alias("node")), ["fp"]))
    named = reps.join(groups, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(firsts, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: For groups of near copies: each byte of a print or check is of the least hash of the shingles by a function of its own.
PRINTS, CHECKS = 2, 6
_random = np.random.default_rng(5)
FLIPS, ODDS = (_random.integers(0, 1 << 32, BYTES * (PRINTS + CHECKS), dtype=np.uint32) for _ in range(2))
ODDS |= np.uint32(1)
#: The share of pairs just at the similarity that the checks may refuse.
MISSED = 1e-4
#: Shingles of the texts that one task compares in full, twice; larger groups are dealt out as pairs of blocks.
VOLUME = 1 << 19
NAMES = [*(f"p{i}" for i in range(PRINTS)), *(f"c{i}" for i in range(CHECKS))]


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of the text's word shingles, as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[i : j - 1]) for i, j in zip([0, *ends], ends[words - 1 :])] or [digest(line)], np.uint64))


def _minima(hashes: np.ndarray) -> np.ndarray:
    """PRINTS + CHECKS numbers of eight bytes; two sets agree in each byte with their Jaccard similarity's chance, or a 256th of the rest."""
    least = np.full(len(ODDS), 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1024):
        least = np.minimum(least, ((short[k : k + 1024, None] ^ FLIPS) * ODDS).min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).view(np.int64)


@tidy
def _sketched(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.zeros((b.num_rows, 2 + PRINTS + CHECKS), np.int64)
        for row, text in enumerate(b.column(2).to_pylist()):
            own = shingles(text, words)
            out[row, :2] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
            out[row, 2:] = _minima(own)
        columns = [pa.array(np.ascontiguousarray(c)) for c in out.T]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["row", "doc_id", "s0", "s1", *NAMES])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [shingles(t, words) for t in b.column(b.num_columns - 1).to_pylist()]
        columns = [*b.columns[:-1], pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["component", "node", *NAMES[PRINTS:], "size", "own"])


def least_equal(similarity: float, missed: float = MISSED) -> int:
    """How many check bytes sets of that similarity agree in, but for that share of them (by the binomial)."""
    n, below = BYTES * CHECKS, 0.0
    for k in range(n + 1):
        below += comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > missed:
            return k
    return n


def _exact_links(node: np.ndarray, checks: np.ndarray, sets: list[np.ndarray], similarity: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the pairs whose sets have that Jaccard similarity, by a breadth-first walk as in _forest."""
    size = np.array([len(x) for x in sets])
    left, queue, links = np.arange(len(node)), [], []
    while len(left):
        if queue:
            i = queue.pop()
        else:
            i, left = left[0], left[1:]
        near = np.minimum(size[left], size[i]) >= similarity * np.maximum(size[left], size[i])
        near &= _equal_bytes(checks[left] ^ checks[i]) >= least
        at = np.flatnonzero(near & (size[left] > 0))
        if not len(at):
            continue
        asked = np.concatenate([sets[j] for j in left[at]])
        place = np.searchsorted(sets[i], asked)
        place[place == len(sets[i])] = 0
        starts = np.r_[0, np.cumsum(size[left[at]])[:-1]]
        both = np.add.reduceat((sets[i][place] == asked).astype(np.int64), starts)
        at = at[both / (size[i] + size[left[at]] - both) >= similarity]
        links += [(i, j) for j in left[at]]
        queue += list(left[at])
        left = np.delete(left, at)
    out = np.array(links, np.int64).reshape(-1, 2)
    return node[out[:, 0]], node[out[:, 1]]


@tidy
def _verified(batches: Iterator[pa.RecordBatch], similarity: float, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (component, lo, hi, node, checks..., own), sorted by the first three: links between nodes whose sets are similar."""

    def links(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate([r for r, _ in held])
        return _exact_links(rows[:, 3], np.ascontiguousarray(rows[:, 4:]), [x for _, part in held for x in part], similarity, least)

    held: list = []
    for b in batches:
        rows = np.stack([c.to_numpy() for c in b.columns[:-1]], 1)
        sets = [np.frombuffer(x, np.uint64) for x in b.column(b.num_columns - 1).to_pylist()]
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]) if len(rows) else []
        found = []
        for i, j in zip(starts, [*starts[1:], len(rows)]):
            if held and (held[-1][0][-1, :3] != rows[i, :3]).any():
                found.append(links(held))
                held = []
            held.append((rows[i:j], sets[i:j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], ["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(held)], ["a", "b"])


def exact_links(candidates: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect the similar nodes of each component of candidates (component, node, checks, size, own).

    Each pair of a component that the checks don't refuse is compared by its whole sets, but for those that a
    walk over the links found has joined already. A component of more than VOLUME shingles is dealt out as pairs of blocks;
    such components are few, so they are broadcast and no component's sets meet in one task before.
    """
    blocks = candidates.groupBy("component").agg(F.ceil(F.sum("size") / VOLUME).cast("int").alias("n")).where("n > 1")
    dealt = (
        candidates.join(F.broadcast(blocks), "component", "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
        .withColumn("c", F.expr("cast(pmod(xxhash64(node), n) as int)"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("component", F.least("c", "d").cast("long").alias("lo"), F.greatest("c", "d").cast("long").alias("hi"), "node", *NAMES[PRINTS:], "own")
    )
    spread = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return spread.mapInArrow(partial(_verified, similarity=similarity, least=least_equal(similarity)), "a long, b long").distinct()


def copy_groups(rows: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, doc_id, component, first) of a written table (row, doc_id, text): groups of near copies, and their first (unnamed, doc_id, row).

    A pair links if the Jaccard similarity of its sets of word shingles (as 64-bit hashes) is at least
    `similarity`. Candidates meet in the index of byte positions: their bytes are of min-hashes, so a
    pair at 0.8 reaches the tally in one print with 0.9896, in one of two with 0.9999, and the checks
    refuse MISSED at most. Only components of candidates are compared by whole sets. Equal sets are one node.
    """
    kinds = ", ".join(f"{n} long" for n in ("row", "doc_id", "s0", "s1", *NAMES))
    sketched = written(rows.select("row", "doc_id", "text").mapInArrow(partial(_sketched, words=words), kinds), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    reps = written(sketched.groupBy("s0", "s1", *NAMES).agg(F.min(first).alias("first")).withColumn("node", F.col("first.row")), "sketch-reps")
    groups = connected_components(near_links(reps, NAMES[:PRINTS], NAMES[PRINTS:], least_equal(similarity)))
    asked = groups.join(reps.select("node", *NAMES[PRINTS:]), "node").join(rows.select(F.col("row").alias("node"), "text"), "node")
    kinds = ", ".join(f"{n} long" for n in ("component", "node", *NAMES[PRINTS:], "size")) + ", own binary"
    candidates = written(asked.select("component", "node", *NAMES[PRINTS:], "text").mapInArrow(partial(_sets, words=words), kinds), "sets")
    true = connected_components(exact_links(candidates, similarity))
    named = reps.join(true, "node", "left").select("s0", "s1", "first", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    return sketched.join(named.drop("first").join(firsts, "component"), ["s0", "s1"]).select("row", "doc_id", "component", "first")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents (doc_id, text): groups of near copies as in copy_groups, by their least doc_id.

    Texts without words are copies of each other. Rows of one doc_id each get a row; component_id is
    null for groups without any doc_id.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    return copy_groups(rows, words, similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def without_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: of the least doc_id, null last."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    rows = numbered(docs, name)
    found = copy_groups(rows.select(F.col(name).alias("row"), F.col("doc_id").cast("long"), "text"), words, similarity)
    kept = found.where("row = first.row").select(F.col("row").alias(name))
    return rows.join(kept.hint("shuffle_hash"), name, "left_semi").select(*docs.columns)
