"""Secret scans over a trigram inverted index, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keyed

try:
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_parse as parser

#: Matches of a text that are run through one after the other before the next block begins.
TOGETHER = 256
#: Alternatives that a part of a rule may branch into; a part with more says nothing.
BRANCHES = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of group, if given, a match needs at least `least` characters, else the match itself."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules and the added ones, public formats of credentials.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of which a match needs one, each a set of trigrams it holds (letters a-z for either case).

    None where some match may do without any trigram: such a rule has to scan every text.
    """
    def closed(state: list[tuple[str, frozenset]]) -> list[tuple[str, frozenset]]:
        return list({("", grams) for _, grams in state})

    def extended(state, texts):
        out = set()
        for (run, grams), text in product(state, texts):
            run += text
            out.add((run[-2:], grams | {run[i : i + 3] for i in range(len(run) - 2)}))
        return list(out)

    def walk(items, state):
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                state = extended(state, [chr(arg).lower()])
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 6:
                state = extended(state, sorted({chr(a).lower() for _, a in arg}))
            elif name == "SUBPATTERN":
                state = walk(arg[3], state)
            elif name == "BRANCH":
                state = [s for branch in arg[1] for s in walk(branch, state)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
                state = state + walk(arg[2], state)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] and arg[0] <= 8:
                for _ in range(arg[0]):
                    state = walk(arg[2], state)
            elif name != "AT":
                state = closed(state)
            if len(state) > BRANCHES * 4:
                state = closed(state)
        return state

    done = [set(g) for _, g in walk(parser.parse(pattern), [("", frozenset())])]
    least = {frozenset(g) for g in done if not any(o < g for o in done)}
    return None if frozenset() in least else sorted(least, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules ask for, letters in either case."""
    folded = docs.select("doc_id", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): texts in which every trigram of one of a kind's alternatives occurs."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    terms = [(kind, k, len(grams), t) for kind, query in asked.items() for k, grams in enumerate(query) for t in sorted(grams)]
    if not terms:
        return docs.select("doc_id", F.array().cast("array<string>").alias("kinds")).limit(0)
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(kind)}, {k}, {n}, {quoted(t)})" for kind, k, n, t in terms)
    query = docs.sparkSession.sql(f"select * from values {rows} as t(kind, alternative, needed, trigram)")
    index = trigram_index(docs, sorted({t[3] for t in terms}))
    # The query has a row for each trigram of a fixed rule list.
    met = index.join(F.broadcast(query), "trigram").groupBy("doc_id", "kind", "alternative").agg(F.countDistinct("trigram").alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(items: Column, value: Callable, joined: Callable, zero: int, out: Callable) -> Column:
    """out(item, before) of each item, where before joins zero and the values of all items before it.

    An array that grows by one is copied each time, so items are run through in blocks of TOGETHER;
    then each block gets what the blocks before it come to. Time stays in proportion to the items.
    """
    pair = lambda item, at: F.struct(item.alias("item"), at.alias("before"))
    start = F.lit(zero)

    def step(state: Column, item: Column) -> Column:
        return F.struct(joined(state["at"], value(item)).alias("at"), F.concat(state["found"], F.array(pair(item, state["at"]))).alias("found"))

    def block(all_: Column, b: Column) -> Column:
        own = F.slice(all_, b * TOGETHER + 1, F.lit(TOGETHER))
        none = F.slice(F.transform(own, lambda x: pair(x, start)), 1, 0)
        return F.aggregate(own, F.struct(start.alias("at"), none.alias("found")), step)

    def shifted(blocks: Column) -> Column:
        upto = F.aggregate(blocks, F.array(start), lambda so_far, b: F.concat(so_far, F.array(joined(F.element_at(so_far, -1), b["at"]))))
        each = F.zip_with(blocks, F.slice(upto, 1, F.size(blocks)), lambda b, o: F.transform(b["found"], lambda p: out(p["item"], joined(o, p["before"]))))
        return F.flatten(each)

    count = lambda x: F.greatest(F.ceil(F.size(x) / TOGETHER) - 1, F.lit(0)).cast("int")
    return _let(items, lambda x: _let(F.transform(F.sequence(F.lit(0), count(x)), lambda b: block(x, b)), shifted))


def _spans(rule: Rule, number: int, measure: Callable[[Column], Column]) -> Column:
    """array<struct<start, number, end, kind>> of a rule's matches in text, places by measure.

    The text between the matches comes from split, so places are running sums of lengths.
    """
    text, pattern = F.col("text"), F.lit(rule.pattern)
    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.transform(F.split(text, rule.pattern, -1), measure).alias("gaps"))
    part = lambda gap, m: F.struct(gap.alias("gap"), measure(m).alias("size"), F.length(F.regexp_extract(m, rule.pattern, rule.group)).alias("asked"))
    parts = _let(both, lambda x: F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], part))

    def place(p: Column, before: Column) -> Column:
        start = before + p["gap"]
        return F.struct(p["asked"].alias("asked"), F.struct(start.alias("start"), F.lit(number).alias("number"), (start + p["size"]).alias("end"), F.lit(rule.kind).alias("kind")).alias("span"))

    placed = _running(parts, lambda p: p["gap"] + p["size"], lambda a, b: a + b, 0, place)
    return F.transform(F.filter(placed, lambda p: p["asked"] >= rule.least), lambda p: p["span"])


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measure: Callable[[Column], Column] = F.length) -> DataFrame:
    """documents with spans array<struct<start, number, end, kind>>, in order of start, then of the rules.

    Places are code points, or bytes with measure octet_length.

    Rules with mandatory trigrams run only on the texts that the index gives; the others on all. A null
    text is empty. Where doc_ids are null or repeat, rows meet the index by numbers of their own, so they keep
    their rows and share no task. Columns other than doc_id and text are dropped.
    """
    rows = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    found = candidates(rows.select(F.col("row").alias("doc_id"), "text"), rules).select(F.col("doc_id").alias("candidate"), "kinds")
    joined = rows.join(found.hint("shuffle_hash"), F.col("row") == F.col("candidate"), "left")
    kind = "array<struct<start:int,number:int,end:int,kind:string>>"
    each = []
    for number, rule in enumerate(rules):
        ask = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) is not None else F.col("text").rlike(rule.pattern)
        each.append(F.when(ask, _spans(rule, number, measure)).otherwise(F.array().cast(kind)))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, per row of documents."""
    base = [r.kind for r in rules if r.base]
    counted = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return scanned(docs, rules).select("doc_id", *counted, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text) with each run of overlapping or touching spans replaced by mark."""
    cut = lambda raw, at, size: F.substring(raw, at + 1, size).cast("string")
    spans = _running(F.col("spans"), lambda s: s["end"], F.greatest, -1, lambda s, before: F.struct(s["start"].alias("start"), before.alias("before")))

    def kept(raw: Column, s: Column) -> Column:
        at = F.greatest(s["before"], F.lit(0))
        return F.concat(cut(raw, at, s["start"] - at), F.lit(mark))

    def whole(raw: Column) -> Column:
        begun = F.transform(F.filter(spans, lambda s: s["start"] > s["before"]), lambda s: kept(raw, s))
        return F.concat(F.array_join(begun, ""), cut(raw, F.array_max(F.transform("spans", lambda s: s["end"])), F.octet_length("text")))

    text = _let(F.col("text").cast("binary"), whole)
    return scanned(docs, rules, F.octet_length).select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"))
