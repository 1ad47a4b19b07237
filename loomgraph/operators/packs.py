"""Context packs of many tasks in one job: every step is a plan over all tasks, and what a pack has room for is chosen on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text
from loomgraph.operators import rank, reach, search
from loomgraph.operators.context import COMMITS, CORE, HEADER, HOPS, NEXT, SEEDS, SNIPPET_LINES
from loomgraph.operators.traverse import Adjacency
from loomgraph.scratch import written

#: Symbols that are named beside a core file, and beside one of the next.
NAMED = (20, 8)
#: Levels of detail: 0 shows all, 1 leaves out the periphery, 2 also snippets, 3 also the next files. ALWAYS stays at each.
PERIPHERY, SNIPPETS, FILES, ALWAYS = 1, 2, 3, 4


def seeds(nodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, id, position) of tasks (task_id, task): search hits among symbols and files, then nodes of that very name; no tests."""
    queries = tasks.select(F.col("task_id").alias("query_id"), text.search_terms("task").alias("terms"))
    hits = search.search(nodes, queries, ["symbol", "file"], SEEDS).select(F.col("query_id").alias("task_id"), F.col("node_id").alias("id"), F.col("position").cast("long"))
    named = nodes.select("id", "ord", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("task"))
    first = Window.partitionBy("task_id").orderBy("ord", "id")
    exact = named.join(tasks.select("task_id", "task"), "task").withColumn("n", F.row_number().over(first)).where(F.col("n") <= SEEDS)
    both = hits.unionByName(exact.select("task_id", "id", (F.col("n") + SEEDS).cast("long").alias("position")))
    real = nodes.where(~F.coalesce(text.is_test_for_rank("file_path"), F.lit(False))).select("id")
    return both.groupBy("task_id", "id").agg(F.min("position").alias("position")).join(real, "id")


def expanded(edges: DataFrame | Adjacency, start: DataFrame, hops: int = HOPS) -> DataFrame:
    """(task_id, id, depth): each task's seeds (task_id, id) and what is within hops of any, in either direction. 64 tasks share a row."""
    roots = reach.placed(start.select(F.col("task_id").alias("root_id")))
    rows = start.withColumnRenamed("task_id", "root_id").join(roots, "root_id")
    first = rows.groupBy("block", F.col("id").alias("node_id")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = reach.spread(edges, first, hops, "both", list(schema.CONTEXT_KINDS))
    return reach.expanded(found, roots).select(F.col("root_id").alias("task_id"), F.col("node_id").alias("id"), "depth")


def ranked(nodes: DataFrame, reached: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """The first files of each task, (task_id, file_path, refs, score, tier, position, part), `most` of part 3 at most.

    anchors is (task_id, anchor). Spark's limit within groups leaves no more than that many rows of a task to a sort.
    """
    by = reached.join(nodes.select("id", "file_path"), "id").where("file_path is not null").groupBy("task_id", "file_path")
    files = by.agg(F.count("*").alias("refs"), F.bool_or(F.col("depth") == 0).alias("direct")).join(anchors, "task_id")
    order = Window.partitionBy("task_id").orderBy(*rank.order())
    rows = rank.rank(files, F.lit(""), F.col("anchor"), keep_own=True).withColumn("position", F.row_number().over(order))
    part = F.when(F.col("position") <= CORE, 1).when(F.col("position") <= CORE + NEXT, 2).otherwise(3)
    return rows.where(F.col("position") <= CORE + NEXT + most).select("task_id", "file_path", "refs", "score", "tier", "position", part.alias("part"))


def _symbols(nodes: DataFrame, reached: DataFrame, shown: DataFrame) -> DataFrame:
    """(task_id, file_path, symbols): the first names of the symbols reached in the files of parts 1 and 2."""
    own = nodes.where("kind = 'symbol'").select("id", "file_path", "name", "ord")
    rows = reached.join(own, "id").join(shown.where("part < 3").select("task_id", "file_path"), ["task_id", "file_path"])
    order = Window.partitionBy("task_id", "file_path").orderBy("depth", "ord", "id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(NAMED))
    return first.groupBy("task_id", "file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("symbols"))


def _snippets(nodes: DataFrame, core: DataFrame, contents: DataFrame) -> DataFrame:
    """Lines of the widest symbol of each core file; contents is (path, content). A file is cut once for all tasks."""
    paths = core.select("file_path").distinct()
    own = nodes.where("kind = 'symbol' and start_line is not null").join(paths, "file_path")
    widest = own.groupBy("file_path").agg(F.max_by(F.struct("start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), -F.col("ord"))).alias("s"))
    cut = text.snippet("content", F.col("s.start_line"), F.col("s.end_line"), SNIPPET_LINES)
    texts = widest.join(contents.select(F.col("path").alias("file_path"), "content"), "file_path").select("file_path", cut["source"].alias("source"))
    return core.join(texts.where("source <> ''"), "file_path").withColumn("line", F.concat(F.lit("```\n"), "source", F.lit("\n```")))


def _linked(core: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str, direction: str) -> DataFrame:
    """core with the nodes (other, name, path, subject, ord) at the other ends of its files' edges of a kind."""
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    files = nodes.where("kind = 'file'").select(F.col("id").alias("own"), "file_path")
    links = edges.where(F.col("kind") == kind).select(F.col(a).alias("own"), F.col(b).alias("other"))
    ends = nodes.select(F.col("id").alias("other"), "name", F.col("file_path").alias("path"), F.col("doc").alias("subject"), "ord")
    # Each core file meets its links once, however many tasks have it.
    met = core.select("file_path").distinct().join(files, "file_path").join(links, "own").join(ends, "other")
    return core.join(met, "file_path")


def _first(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy(*order))).where(F.col("place") <= most)


def _lines(rows: DataFrame, section: int, sub: int, drop: int, place: str, line: Column | str) -> DataFrame:
    return rows.select("task_id", F.lit(section).alias("section"), F.col(place).alias("place"), F.lit(sub).alias("sub"), F.lit(drop).alias("drop"), (F.col(line) if isinstance(line, str) else line).alias("line"))


def lines(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, shown: DataFrame, symbols: DataFrame, most: int, contents: DataFrame | None) -> DataFrame:
    """(task_id, section, place, sub, drop, line): what packs may hold, in order, and the level of detail that leaves it out."""
    rows = shown.join(symbols, ["task_id", "file_path"], "left")
    names = lambda n: F.array_join(F.slice(F.coalesce("symbols", F.array().cast("array<string>")), 1, n), ", ")
    core = written(shown.where("part = 1").select("task_id", "file_path", "position"), "core")
    head = F.concat(F.lit(f"{HEADER}\n\nTask: "), F.coalesce("task", F.lit("")), F.lit("\n"))
    top = F.concat(F.lit("#### "), "file_path", F.lit("\nscore "), "score", F.lit(", "), "tier", F.lit("; symbols: "), names(NAMED[0]))
    out = [
        _lines(tasks.withColumn("place", F.lit(0)), 0, 0, ALWAYS, "place", head),
        _lines(rows.where("part = 1"), 1, 0, ALWAYS, "position", top),
        _lines(rows.where("part = 2"), 2, 0, FILES, "position", F.concat(F.lit("- "), "file_path", F.lit(" ("), "tier", F.lit("): "), names(NAMED[1]))),
        _lines(rows.where("part = 3"), 3, 0, PERIPHERY, "position", F.concat(F.lit("- "), "file_path")),
    ]
    if contents is not None:
        out.append(_lines(_snippets(nodes, core, contents), 1, 1, SNIPPETS, "position", "line"))
    commits = _linked(core, nodes, edges, "touched_by", "out").groupBy("task_id", "file_path", F.substring("name", 1, 7).alias("sha")).agg(F.min(F.struct("position", "ord", "subject")).alias("r"))
    commits = _first(commits, ["r.position", "r.ord", "sha", "file_path"], COMMITS)
    out.append(_lines(commits, 4, 0, ALWAYS, "place", F.concat(F.lit("- "), "sha", F.lit(" "), F.coalesce("r.subject", F.lit("")), F.lit(" ("), "file_path", F.lit(")"))))
    # A line is a token or more, so lines beyond the budget can't be in the pack, and a pack with that many is cut anyway.
    docs = _first(_linked(core, nodes, edges, "mentions", "in"), ["position", "ord", "other"], most)
    out.append(_lines(docs, 5, 0, ALWAYS, "place", F.concat(F.lit("- "), "name", F.coalesce(F.concat(F.lit(" ("), "path", F.lit(")")), F.lit("")), F.lit(" mentions "), "file_path")))
    features = _first(_linked(core, nodes, edges, "in_feature", "out"), ["position", "name", "other"], most)
    out.append(_lines(features, 6, 0, ALWAYS, "place", F.concat(F.lit("- "), "file_path", F.lit(' is part of feature "'), "name", F.lit('"'))))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def fitted(found: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, first, level, markdown, tokens) of tasks (task_id, first, budget): the lines found for `first` joined at the first level of detail within the budget, else cut.

    A line costs its UTF-16 units and a line end. Sums by level choose the level; prefix sums by level then leave out
    what starts beyond the budget, so a task meets no more text than it may have, and one line. Both are made once for
    all tasks of one `first`.
    """
    cost = text.utf16_units("line") + 1
    room = F.col("budget").cast("long") * 4
    # At the level L a task's text is the sum of lines that L doesn't leave out, without the last line end.
    shown = lambda level: F.when(F.col("drop") > level, F.col("cost")).otherwise(0)
    before = Window.partitionBy("task_id").orderBy("section", "place", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.array(*[F.coalesce(F.sum(shown(level)).over(before), F.lit(0)) for level in range(4)]).alias("starts")
    rows = written(found.withColumn("cost", cost).select(F.col("task_id").alias("first"), "section", "place", "sub", "drop", "line", "cost", starts), "lines")
    sums = rows.groupBy("first").agg(*[F.sum(shown(level)).alias(f"at{level}") for level in range(4)])
    level = F.coalesce(*[F.when(F.col(f"at{x}") - 1 <= room, F.lit(x)) for x in range(4)], F.lit(3))
    chosen = written(tasks.select("task_id", "first", "budget").join(sums, "first").select("task_id", "first", "budget", level.alias("level")), "chosen")
    # A line left out starts after the line end of a text longer than the room, so what is kept is cut as the whole would be.
    fits = (F.col("starts")[F.col("level")] <= room + 1) | (F.col("section") == 0)
    kept = rows.join(chosen, "first").where((F.col("drop") > F.col("level")) & fits)
    parts = F.array_sort(F.collect_list(F.struct("section", "place", "sub", "line")))
    packed = kept.groupBy("task_id", "first", "budget", "level").agg(parts.alias("parts"))
    whole = F.array_join(F.transform("parts", lambda x: x["line"]), "\n")
    # Without a budget there is the heading at least.
    markdown = F.when(F.col("budget") <= 0, F.lit(HEADER)).otherwise(text.clamped(whole, F.col("budget")))
    return packed.select("task_id", "first", "level", markdown.alias("markdown")).withColumn("tokens", text.estimate_tokens("markdown"))


def packs(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, contents: DataFrame | None = None, walked: Adjacency | None = None) -> DataFrame:
    """(task_id, level, markdown, tokens, core_files, symbols) of tasks (task_id long, task string, budget int).

    Each task has a row, also one that nothing is found for, or whose text is null; task_ids are unique and not
    null. tokens is the budget at most, where that is above 0. core_files are those whose headings are in the
    text, symbols the names beside them. `walked` is a kept order of the edges to walk along. Tasks of one text are
    searched, walked and ranked once; they differ by their budgets only.
    """
    tasks = written(tasks.select(F.col("task_id").cast("long"), "task", F.coalesce("budget", F.lit(0)).alias("budget")), "tasks")
    most = max(tasks.agg(F.max("budget")).first()[0] or 0, 0)
    firsts = written(tasks.groupBy("task").agg(F.min("task_id").alias("task_id")), "firsts")
    same = firsts.select(F.col("task").alias("text"), F.col("task_id").alias("first"))
    each = tasks.join(same, F.col("task").eqNullSafe(F.col("text"))).select("task_id", "first", "budget")
    start = written(seeds(nodes, firsts), "seeds")
    reached = written(expanded(walked or edges, start), "reached")
    first = start.join(nodes.select("id", "name"), "id").groupBy("task_id").agg(F.min_by("name", F.struct("position", "id")).alias("name"))
    anchors = firsts.join(first, "task_id", "left").select("task_id", F.coalesce("name", "task", F.lit("")).alias("anchor"))
    shown = written(ranked(nodes, reached, anchors, most), "shown")
    symbols = written(_symbols(nodes, reached, shown), "symbols")
    text_of = fitted(lines(nodes, edges, firsts, shown, symbols, most, contents), each)
    core = shown.where("part = 1").join(symbols, ["task_id", "file_path"], "left")
    own = core.groupBy(F.col("task_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("position", "file_path", "symbols"))).alias("core"))  # CORE at most
    out = text_of.join(own, "first", "left")
    left = F.filter(F.coalesce("core", F.array().cast(own.schema["core"].dataType)), lambda x: F.contains("markdown", F.concat(F.lit("#### "), x["file_path"])))
    named = F.flatten(F.transform("left", lambda x: F.coalesce(x["symbols"], F.array().cast("array<string>"))))
    return out.withColumn("left", left).select("task_id", "level", "markdown", "tokens", F.transform("left", lambda x: x["file_path"]).alias("core_files"), named.alias("symbols"))
