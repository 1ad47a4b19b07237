"""Conversation structure repair: the cheapest edits that make turns alternate, by iterative-deepening A*.

A repaired conversation is empty, or has the roles system at most once and first, then user and
assistant in turn, ending with assistant. Edits are letters: D deletes a row, I inserts an empty row
before it (or at the end), K keeps it, R gives it the role that is due. A string of edits tells all
of the repair, as after each place only one of user and assistant is due.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.scratch import written

#: Costs of the edits, and what a truncated row adds where it stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant. What keeping a role leads to; what an inserted or renamed row leads to, and its role.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: What is still to be inserted at the end, by state.
ENDING = ("", "II", "I", "")
AFTER = tuple(INSERT * len(x) for x in ENDING)
NEVER = 1 << 40
SPACE = " \t\n\x0b\x0c\r"
#: Conversations beyond these bounds are cut into blocks of BLOCK rows.
MOST_ROWS, MOST_BYTES, BLOCK = 512, 16 << 20, 256
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def row_code(role: str, fault: str) -> str:
    """A row in one letter: D has to go; else the role's initial (x: neither s, u nor a), upper case if truncated."""
    if fault in ("blank", "duplicate"):
        return "D"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


class _Bound:
    """A lower bound of the cost from each place and state on, above the least of after.

    Sums what no repair avoids: rows that have to go, truncated rows, rows whose role is never due, all
    but one s, and one edit for each pair of neighbours that can't stand together, over disjoint pairs.
    """

    def __init__(self, codes: str, after: tuple[int, ...]):
        n = self.n = len(codes)
        self.codes, self.after, self.base = codes, after, min(after)
        self.must, self.systems, self.pairs, self.next = [0] * (n + 1), [0] * (n + 1), [0] * (n + 2), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            c = codes[i]
            low = c.lower()
            self.must[i] = self.must[i + 1] + (DELETE if c == "D" else TRUNCATED * (c != low) + REROLE * (low == "x"))
            self.systems[i] = self.systems[i + 1] + (low == "s")
            self.next[i] = self.next[i + 1] if c == "D" else i
            self.pairs[i] = self.pairs[i + 1]
            if low in ("u", "a"):
                j = self.next[i + 1]
                if self._apart(2 if low == "u" else 3, j):
                    self.pairs[i] = max(self.pairs[i], 1 + self.pairs[min(j + 1, n)])

    def _apart(self, state: int, j: int) -> bool:
        """Whether an edit is needed where row j comes next in this state."""
        if j >= self.n:
            return self.after[state] - self.base >= INSERT
        c = self.codes[j].lower()
        return c in ("u", "a") and c not in KEPT[state]

    def __call__(self, i: int, state: int) -> int:
        if i == self.n:
            return self.after[state] - self.base
        pairs, j = self.pairs[i], self.next[i]
        if self._apart(state, j):
            pairs = max(pairs, 1 + self.pairs[min(j + 1, self.n)])
        return self.must[i] + REROLE * max(0, self.systems[i] - (state == 0)) + INSERT * pairs


def _edits(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows taken, next state, cost) of the edits at a row, in ASCII order."""
    out = [("D", 1, state, DELETE), ("I", 0, DUE[state], INSERT)]
    if code != "D":
        more = TRUNCATED * code.isupper()
        if code.lower() in KEPT[state]:
            out.append(("K", 1, KEPT[state][code.lower()], more))
        out.append(("R", 1, DUE[state], REROLE + more))
    return out


def cheapest(codes: str, state: int = 0, after: tuple[int, ...] = AFTER) -> tuple[int, str, int]:
    """(cost, edits, last state) of the cheapest repair of rows from a state on; after: what each last state costs beyond.

    Iterative deepening: depth first in ASCII order of the edits under a bound that grows by one, from the
    lower bound on. What failed with some cost left isn't tried again with as much or less, in any
    round. The first path that ends under the bound is the cheapest and of these the least.
    """
    bound = _Bound(codes, after)
    failed: dict[tuple[int, int], int] = {}
    left = bound(0, state)
    while True:
        path = [(0, state, left, iter(_edits(codes[0], state)) if codes else iter(()))]
        letters: list[str] = []
        while path:
            i, q, rest, edits = path[-1]
            if i == len(codes) and rest >= after[q] - bound.base:
                return left + bound.base, "".join(letters), q
            for letter, step, q2, cost in edits:
                i2, rest2 = i + step, rest - cost
                if rest2 >= 0 and failed.get((i2, q2), -1) < rest2 and bound(i2, q2) <= rest2:
                    letters.append(letter)
                    path.append((i2, q2, rest2, iter(_edits(codes[i2], q2)) if i2 < len(codes) else iter(())))
                    break
            else:
                failed[i, q] = max(rest, failed.get((i, q), -1))
                path.pop()
                if letters:
                    letters.pop()
        left += 1


def between(codes: str, state: int, last: int) -> tuple[int, str]:
    """(cost, edits) of the cheapest way through a block of rows from one state to another; NEVER where there is none."""
    if state == last and state < 2:
        return DELETE * len(codes), "D" * len(codes)  # every other edit leaves these states for good
    if last == 0 or last == 1 and state or not codes and last != state:
        return NEVER, ""
    if last == 1:  # one system row stays, of the cheapest ones the last
        at = codes.rfind("s") if "s" in codes else codes.rfind("S")
        return (NEVER, "") if at < 0 else (DELETE * (len(codes) - 1) + TRUNCATED * (codes[at] == "S"), "D" * at + "K" + "D" * (len(codes) - at - 1))
    cost, letters, _ = cheapest(codes, state, tuple(0 if q == last else NEVER for q in range(4)))
    return cost, letters


def fault_of(role: str, text: str, seen: set) -> str:
    """A row's first fault; seen holds the roles and texts before it."""
    end = text.rstrip(SPACE)
    key = (role, text)
    repeated = key in seen
    seen.add(key)
    return "blank" if not end else "duplicate" if repeated else "truncated" if end[-1] not in ".!?" else ""


class Tally:
    """What is told of a conversation, from its rows in order: counts, edits, and the hash of the repaired rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.first, self.turn, self.distinct, self.role = conv_id, None, None, 0, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal = self.cost = self.state = 0
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def _say(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _insert(self, n: int) -> None:
        for _ in range(n):
            self._say(ROLE[self.state], "")
            self.state = DUE[self.state]
        self.cost += INSERT * n

    def row(self, turn: int | None, role: str, text: str, fault: str, edits: str) -> None:
        """A row and its edits: insertions before it, then its own."""
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.distinct = turn, self.distinct + 1
        self.illegal += self.role is not None and self.role + role[:1] not in ("su", "ua", "au")
        self.role = role[:1]
        self.faults[fault] += 1
        self.audit.append(edits)
        self._insert(len(edits) - 1)
        if edits[-1] == "D":
            self.cost += DELETE
            return
        role = role if edits[-1] == "K" else ROLE[self.state]
        self.cost += TRUNCATED * (fault == "truncated") + REROLE * (edits[-1] == "R")
        self._say(role, text)
        self.state = KEPT[self.state][role[:1]]

    def end(self) -> tuple:
        self.audit.append(ENDING[self.state])
        self._insert(len(ENDING[self.state]))
        gaps = self.turn - self.first + 1 - self.distinct if self.distinct else 0
        return self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def per_row(edits: str) -> list[str]:
    """The edits of a block, row by row."""
    out, at = [], 0
    for i, c in enumerate(edits, 1):
        if c != "I":
            out.append(edits[at:i])
            at = i
    return out


def repaired(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result of one conversation of rows (turn, role, text) in order."""
    tally, seen = Tally(conv_id), set()
    faults = [fault_of(role, text, seen) for _, role, text in rows]
    _, edits, _ = cheapest("".join(row_code(r[1], f) for r, f in zip(rows, faults)))
    for row, fault, own in zip(rows, faults, per_row(edits)):
        tally.row(*row, fault, own)
    return tally.end()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [f[0] for f in fields])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [repaired(c, [(r["turn"], r["role"], r["text"]) for r in rows]) for c, rows in zip(b.column("conv_id").to_pylist(), b.column("rows").to_pylist())]
        yield _batch(out, RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows damaged by the checksum of `conv_id:turn`; times says how often a row stands, 0 if dropped.

    A null role or text, and a null number in the checksum, is one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role").alias("role"), said("text").alias("text"))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def _flow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of rows that come sorted, one row in memory at a time beside its batch."""
    return groupby((row for b in batches for row in b.to_pylist()), key=lambda r: r["conv_id"])


def _in_batches(rows: Iterator[tuple], schema: str, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


WAYS = "conv_id long, block long, codes string, costs array<long>"
NEXT = "conv_id long, block long, codes string, after array<long>"
CHOSEN = "conv_id long, block long, edits string"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the cost from every state to every state."""
    for b in batches:
        out = [(r["conv_id"], r["block"], r["codes"], [between(r["codes"], q, p)[0] for q in range(4) for p in range(4)]) for r in b.to_pylist()]
        yield _batch(out, WAYS)


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first: what each of its last states costs beyond the block."""

    def rows() -> Iterator[tuple]:
        for conv_id, blocks in _flow(batches):
            after = list(AFTER)
            for r in blocks:
                yield conv_id, r["block"], r["codes"], after
                after = [min(NEVER, min(r["costs"][4 * q + p] + after[p] for p in range(4))) for q in range(4)]

    return _in_batches(rows(), NEXT)


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the best edits from every state, given what comes after, each with its last state."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            found = [cheapest(r["codes"], q, tuple(r["after"])) for q in range(4)]
            out.append((r["conv_id"], r["block"], "|".join(f"{edits}{last}" for _, edits, last in found)))
        yield _batch(out, CHOSEN)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the first to the last: the edits from the state in which the block is reached."""

    def rows() -> Iterator[tuple]:
        for conv_id, blocks in _flow(batches):
            state = 0
            for r in blocks:
                own = r["edits"].split("|")[state]
                state = int(own[-1])
                yield conv_id, r["block"], own[:-1]

    return _in_batches(rows(), CHOSEN)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv_id, found in _flow(batches):
            tally = Tally(conv_id)
            for r in found:
                if r["edits"] is not None:  # else a conversation of which nothing is left
                    tally.row(r["turn"], r["role"], r["text"], r["fault"], r["edits"])
            yield tally.end()

    return _in_batches(rows(), RESULT, 1)


def _streamed(rows: DataFrame, order: Column, step: Callable, schema: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), order).mapInArrow(step, schema)


def _fault(text: Column, first: Column) -> Column:
    end = F.rtrim(text, F.lit(SPACE))
    return F.when(end == "", "blank").when(~first, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


def _by_blocks(rows: DataFrame) -> DataFrame:
    """The results of long conversations: their rows are sorted and numbered over all tasks and searched block by block.

    A block's costs between states are found on their own. One stream per conversation adds them up from
    the end, four numbers at a time; another follows the states from the start. The texts
    meet the edits by the rows' numbers, and flow in order through the hash, which is of one text. No
    stream holds a conversation, but the string of its edits, which is a value of the result.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = rows.withColumn("again", F.explode(F.expr("sequence(1, greatest(times, 1))"))).drop("again").withColumn("tie", F.monotonically_increasing_id())
    dealt = again.repartitionByRange(parts, *order, F.substring("text", 1, 64), "tie").sortWithinPartitions(*order, "text", "tie").drop("tie")
    placed = written(dealt.withColumn("n", F.monotonically_increasing_id()), "turns")
    there = placed.where("times > 0")
    first = there.groupBy("conv_id", "role", F.sha2("text", 256).alias("h")).agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    fault = _fault(F.col("text"), F.coalesce("first", F.lit(False)))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    block = F.floor(F.col("n") / BLOCK).cast("long")
    marked = written(placed.join(first, "n", "left").withColumn("fault", fault).withColumn("code", code).withColumn("block", block), "marked")
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]), "")
    blocks = marked.where("times > 0").groupBy("conv_id", "block").agg(codes.alias("codes"))
    ways = blocks.mapInArrow(_ways, WAYS)
    after = _streamed(ways, F.desc("block"), _costs_after, NEXT)
    chosen = _streamed(after.mapInArrow(_choices, CHOSEN), F.asc("block"), _chosen, CHOSEN)
    own = F.posexplode(F.regexp_extract_all("edits", F.lit("I*[DKR]"), F.lit(0))).alias("at", "edits")
    edits = chosen.select("conv_id", "block", own)
    at = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("n")) - 1
    numbered = marked.where("times > 0").select("conv_id", "block", "n", at.alias("at"))
    by_row = numbered.join(edits, [numbered.conv_id.eqNullSafe(edits.conv_id), numbered.block == edits.block, numbered["at"] == edits["at"]]).select("n", "edits")
    return _streamed(marked.join(by_row, "n", "left"), F.asc("n"), _told, RESULT)


def repairs(conversations: DataFrame, rows: int = MOST_ROWS, size: int = MOST_BYTES) -> DataFrame:
    """RESULT of every conversation of conversations (conv_id, turn, role, text), damaged first.

    Rows stand in the order of turn (null first), then role and text; repeated rows are duplicates. A null conv_id is a
    conversation like any other; one of which the damage leaves nothing has zeros, an empty audit and the
    hash of the empty string. Other columns are ignored; no rows: no rows. Conversations of at most
    so many rows and bytes are searched whole; longer ones, which one task can't hold, block by block, with
    the same result.
    """
    found = damaged(conversations)
    sizes = found.groupBy("conv_id").agg(F.sum(F.greatest("times", F.lit(1))).alias("n"), F.sum(F.octet_length("text") + 64).alias("bytes"))
    long = written(sizes.where(f"n > {rows} or bytes > {size}").select(F.col("conv_id").alias("long_id")), "long")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    any_long = not long.isEmpty()
    short = found.join(long, is_long, "left_anti") if any_long else found
    turns = F.sort_array(F.collect_list(F.when(F.col("times") > 0, F.struct("turn", "role", "text", "times"))))
    again = F.flatten(F.transform(turns, lambda r: F.array_repeat(r, r["times"])))
    whole = short.groupBy("conv_id").agg(again.alias("rows")).mapInArrow(_repaired, RESULT)
    return whole.unionByName(_by_blocks(found.join(long, is_long, "left_semi"))) if any_long else whole
