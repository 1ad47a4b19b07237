"""URL filters: path rules first, then a cascade of Bloom filters that is exact over the corpus's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written

#: Bits per key and hash functions of a level: about one false positive in a hundred.
BITS, HASHES = 10, 7
#: Listed keys of a shard, about; a shard's filter is one row of some ten kilobytes.
SHARD = 8192
#: Fixed values of the path rules: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(tail, r"\A([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and all subdomains; path prefix), and its verdict; null if none fits."""
    found = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found, verdict = F.when(fits, F.lit(h + p)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def _pair(level: int, to: str = "") -> dict[str, Column]:
    """The two hashes from which a key's places in a level's filters come: h1 + i * h2."""
    one, two = (f"(xxhash64(key, {2 * level + i}) & 4294967295L)" for i in range(2))
    return {f"h1{to}": F.expr(one), f"h2{to}": F.expr(f"{two} | 1L")}


def _held(words: str, bits: str, of: str = "") -> str:
    """Whether key is in the filter (words of 64 bits)."""
    places = [f"pmod(h1{of} + {i} * h2{of}, {bits})" for i in range(HASHES)]
    tests = [f"(shiftright({words}[cast({p} div 64 as int)], cast({p} % 64 as int)) & 1) = 1" for p in places]
    return " and ".join(tests)


def _filters(keys: DataFrame, level: int) -> DataFrame:
    """(shard, bits, words) over the keys of each shard. Bits are set per word and combined before the shuffle."""
    sized = keys.groupBy("shard").agg((F.ceil(F.count("*") * BITS / 64) * 64).cast("long").alias("bits"))
    placed = keys.join(sized, "shard").withColumns(_pair(level)).withColumn("at", F.explode(F.expr(f"transform(sequence(0, {HASHES - 1}), i -> pmod(h1 + i * h2, bits))")))
    word = placed.groupBy("shard", "bits", F.expr("cast(at div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v"))
    whole = word.groupBy("shard", "bits").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return whole.select("shard", "bits", F.expr("transform(sequence(0, cast(bits div 64 as int) - 1), w -> coalesce(m[w], 0L))").alias("words"))


def cascade(keys: DataFrame, max_levels: int = 40) -> tuple[DataFrame, int]:
    """Filters (shard, b1, w1, b2, w2, ...) for keys (key, listed; distinct keys: the complete universe), and the shards.

    Level 1 holds the listed keys, level 2 the other keys that level 1 lets through, level 3 the
    listed ones that level 2 lets through, and so on until none is left: then membership is exact for
    every key of the universe. Each level is a hundredth of the one before.
    """
    total = keys.where("listed").count()
    shards = max(1, -(-total // SHARD))
    left = written(keys.select("key", "listed", F.expr(f"cast(pmod(xxhash64(key, 1), {shards}) as int)").alias("shard")), "keys")
    out = keys.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    inside = total > 0
    level = 0
    while inside:
        level += 1
        if level > max_levels:
            raise ArithmeticError("keys with equal hashes on both sides")
        listed = level % 2 == 1
        made = written(_filters(left.where(F.col("listed") == listed), level), "filters")
        passed = left.where(F.col("listed") != listed).join(made, "shard").withColumns(_pair(level)).where(_held("words", "bits"))
        out = out.join(made.select("shard", F.col("bits").alias(f"b{level}"), F.col("words").alias(f"w{level}")), "shard", "left")
        kept = left.where(F.col("listed") == listed).select("key", "listed", "shard")
        left = written(passed.select("key", "listed", "shard").unionByName(kept), "keys")
        inside = left.where(F.col("listed") != listed).limit(1).count() > 0
    return written(out, "cascade"), level


def with_membership(rows: DataFrame, filters: DataFrame, levels: int, shards: int) -> DataFrame:
    """rows (with key) and listed: the first level without the key decides, an odd one against it.

    The rows meet a shard's filters by its number, not the list: Spark sends the filters to all tasks
    while they are under its broadcast threshold, and else joins on the shard.
    """
    asked = rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(key, 1), {shards}) as int)"))
    for k in range(1, levels + 1):
        asked = asked.withColumns(_pair(k, f"_{k}"))
    answer = F.lit(levels % 2 == 1)
    for k in range(levels, 0, -1):
        held = F.col(f"w{k}").isNotNull() & F.expr(_held(f"w{k}", f"b{k}", f"_{k}"))
        answer = F.when(F.coalesce(held, F.lit(False)), answer).otherwise(F.lit(k % 2 == 0))
    return asked.join(filters, "shard").withColumn("listed", answer).select(*rows.columns, "listed")


def judged(pages: DataFrame, listed: Column, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages.

    Where no rule fits, a page is blocked if its key, host and path, is on the list: listed marks rows
    of pages whose key is on it. The complete universe of keys are those of pages, so the cascade is
    exact. Null urls and urls without :// have empty host and path; an empty key is no key: it is on no
    list, so they are allowed. Repeated rows stay; other columns are ignored; an empty list blocks nothing.
    """
    host, path = host_path(F.col("url"))
    rows = pages.withColumn("on_list", F.coalesce(listed, F.lit(False))).select("page_id", host.alias("host"), path.alias("path"), "on_list")
    rows = rows.withColumn("key", F.concat("host", "path"))
    named = F.col("on_list") & (F.col("key") != "")
    keys = written(rows.groupBy("key").agg(F.max(named).alias("listed")), "universe")
    filters, levels = cascade(keys)
    shards = filters.count()
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = with_membership(rows.select("page_id", "host", "path", "key"), filters, levels, shards)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
