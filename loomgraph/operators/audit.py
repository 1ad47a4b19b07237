"""Change audits: what a re-index changed, findings, edit guard, completion gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import impact as impacts

# Fixed values.
MAX_FINDINGS, MAX_SYMBOLS, MIN_IMPACTED, TOP_FILES, TOP_COCHANGES = 8, 40, 2, 5, 3
FINDING = "path string, kind string, severity string, message string, file_path string"


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, name, change) of symbols (path, name) that were added or removed."""
    b, a = before.select("path", "name").distinct(), after.select("path", "name").distinct()
    return b.join(a, ["path", "name"], "left_anti").withColumn("change", F.lit("removed")).unionByName(a.join(b, ["path", "name"], "left_anti").withColumn("change", F.lit("added")))


def inbound_callers(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, src, caller_file): nodes of other files with an edge to a symbol of each path."""
    into = nodes.where("kind = 'symbol'").select(F.col("id").alias("dst"), F.col("file_path").alias("path")).join(paths.select("path").distinct(), "path")
    from_ = nodes.where("file_path is not null").select(F.col("id").alias("src"), F.col("file_path").alias("caller_file"))
    links = edges.where("kind <> 'contains'").select("src", "dst")
    return links.join(into, "dst").join(from_, "src").where("caller_file <> path").select("path", "src", "caller_file").distinct()


def dangling(before: DataFrame, after: DataFrame, pending: DataFrame, removed: DataFrame) -> DataFrame:
    """(path, n): callers (path, src) that are gone, and pending names that were removed."""
    gone = before.select("path", "src").distinct().join(after.select("path", "src").distinct(), ["path", "src"], "left_anti").groupBy("path").agg(F.count("*").alias("n"))
    names = pending.select("name").join(removed.where("change = 'removed'").select("path", "name").distinct(), "name").groupBy("path").agg(F.count("*").alias("n"))
    return gone.unionByName(names).groupBy("path").agg(F.sum("n").alias("n"))


def findings(diff: DataFrame, callers: DataFrame, dangling_counts: DataFrame, unresolved: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """Findings of each edited path: stale callers, dangling references, unresolved imports (path, name).

    By severity, then file; beyond `most` one row says how many more there are, with the highest
    severity among them.
    """
    removed = diff.where("change = 'removed'").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    stale = callers.select("path", "caller_file").distinct().join(removed, "path")
    stale = stale.select("path", F.lit("stale_caller").alias("kind"), F.lit("high").alias("severity"), F.format_string("%s referred to symbols removed or renamed in %s (%s)", "caller_file", "path", "names").alias("message"), F.col("caller_file").alias("file_path"))
    none = F.lit(None).cast("string").alias("file_path")
    hang = dangling_counts.where("n > 0").select("path", F.lit("dangling_reference").alias("kind"), F.lit("medium").alias("severity"), F.format_string("%d references elsewhere no longer resolve after the edit of %s", "n", "path").alias("message"), none)
    lost = unresolved.select("path", "name").distinct().groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, 5), ", ").alias("some"))
    lost = lost.select("path", F.lit("unresolved_import").alias("kind"), F.lit("medium").alias("severity"), F.format_string("%d imports of %s did not resolve (%s)", "n", "path", "some").alias("message"), none)
    level = F.array_position(F.array(*[F.lit(s) for s in schema.SEVERITIES]), F.col("severity"))
    w = Window.partitionBy("path").orderBy(F.desc("level"), F.coalesce("file_path", F.lit("")), "message")
    rows = stale.unionByName(hang).unionByName(lost).withColumn("level", level).withColumn("n", F.row_number().over(w))
    over = rows.where(F.col("n") > most).groupBy("path").agg(F.count("*").alias("more"), F.max_by("severity", "level").alias("severity"))
    tail = over.select("path", F.lit("dangling_reference").alias("kind"), "severity", F.format_string("(+%d more findings)", "more").alias("message"), none)
    return rows.where(F.col("n") <= most).select("path", "kind", "severity", "message", "file_path").unionByName(tail)


def edit_guard(nodes: DataFrame, edges: DataFrame, paths: DataFrame, depth: int = 2, max_symbols: int = MAX_SYMBOLS, min_impacted: int = MIN_IMPACTED) -> DataFrame:
    """(path, file_path, max_rank, tier, via_symbols, position) of what the symbols of each path (path) may break.

    All symbols of all paths are roots of one walk. Files with more than max_symbols symbols, or fewer
    than min_impacted impacted files, say nothing. A file has its highest rank and the tier of that rank.
    """
    symbols = nodes.where("kind = 'symbol'").join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path").select("id", "name", F.col("file_path").alias("path"))
    fit = symbols.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") <= max_symbols).select("path")
    symbols = symbols.join(fit, "path")
    hits = impacts.impact(nodes, edges, symbols.select("id"), depth)
    rows = hits.join(symbols.withColumnRenamed("id", "target_id"), "target_id").where("file_path <> path")
    merged = rows.groupBy("path", "file_path").agg(F.max("score").alias("max_rank"), F.max_by("tier", F.struct("score", "target_id")).alias("tier"), F.array_sort(F.collect_set("name")).alias("via_symbols"))
    enough = merged.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= min_impacted).select("path")
    w = Window.partitionBy("path").orderBy(F.desc("max_rank"), "file_path")
    return merged.join(enough, "path").withColumn("position", F.row_number().over(w))


def unopened_cochanges(written: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, with_file): co-change neighbours of the written files (path) that weren't written, with the first of these."""
    files = nodes.where("kind = 'file'").select("id", "file_path")
    own = files.join(written.select(F.col("path").alias("file_path")).distinct(), "file_path").select(F.col("id").alias("a"), F.col("file_path").alias("with_file"))
    pairs = edges.where("kind = 'co_change'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = own.join(both, "a").join(files.select(F.col("id").alias("b"), "file_path"), "b").join(written.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    return found.groupBy("file_path").agg(F.min("with_file").alias("with_file"))


def completion_gate(found: DataFrame, written: DataFrame, nodes: DataFrame, edges: DataFrame, floor: str = "low") -> DataFrame:
    """Findings that hold a turn open: stale callers not written since, and unopened co-changes; one per message."""
    level = F.array_position(F.array(*[F.lit(s) for s in schema.SEVERITIES]), F.col("severity"))
    stale = found.where("kind = 'stale_caller'").join(written.select(F.col("path").alias("file_path")), "file_path", "left_anti").select("kind", "severity", "file_path", "message")
    pairs = unopened_cochanges(written, nodes, edges)
    other = pairs.select(F.lit("unopened_co_change").alias("kind"), F.lit("medium").alias("severity"), "file_path", F.format_string("%s often changes with %s but was not touched", "file_path", "with_file").alias("message"))
    return stale.unionByName(other).where(level >= schema.SEVERITIES.index(floor) + 1).dropDuplicates(["message"])


def f1_at_budget(ranked: DataFrame, gold: DataFrame, budget: int = 20) -> DataFrame:
    """(task, precision, recall, f1) of the first `budget` distinct keys of ranked (task, key, position) against gold (task, key)."""
    first = ranked.groupBy("task", "key").agg(F.min("position").alias("position"))
    w = Window.partitionBy("task").orderBy("position", "key")
    top = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= budget).select("task", "key")
    want = gold.select("task", "key").distinct()
    counts = want.groupBy("task").agg(F.count("*").alias("gold")).join(top.groupBy("task").agg(F.count("*").alias("shown")), "task", "left").join(top.join(want, ["task", "key"]).groupBy("task").agg(F.count("*").alias("hit")), "task", "left")
    hit, shown = F.coalesce("hit", F.lit(0)), F.coalesce("shown", F.lit(0))
    p, r = F.when(shown > 0, hit / shown).otherwise(0.0), hit / F.col("gold")
    return counts.select("task", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
