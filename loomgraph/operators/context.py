"""Context packs: seeds, expansion, ranked tiers, and the text made of them within a token budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text
from loomgraph.operators import rank, search
from loomgraph.operators.graph import find_by_name, of_kind
from loomgraph.operators.traverse import walk

# Fixed values.
SEEDS, HOPS, CORE, NEXT, SNIPPET_LINES, COMMITS = 12, 2, 5, 8, 40, 5
HEADER = "## Graph context (computed from the code graph; check it, then refine)"


def seeds(nodes: DataFrame, task: str) -> DataFrame:
    """(id, position): search hits among symbols and files, then nodes of that very name; no tests."""
    spark = nodes.sparkSession
    hits = search.search(nodes, search.as_queries(spark, [task]), ["symbol", "file"], SEEDS).select(F.col("node_id").alias("id"), "position")
    exact = find_by_name(nodes, task, limit=SEEDS).select("id", (F.lit(SEEDS) + F.col("ord")).cast("long").alias("position"))
    both = hits.withColumn("position", F.col("position").cast("long")).unionByName(exact).groupBy("id").agg(F.min("position").alias("position"))
    real = nodes.where(~F.coalesce(text.is_test_for_rank("file_path"), F.lit(False))).select("id")
    return both.join(real, "id")


def expanded(edges: DataFrame, start: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, depth): the seeds and what is within hops of any, in either direction."""
    kinds = list(schema.CONTEXT_KINDS)
    one = start.select(F.lit(0).cast("long").alias("root_id"), "id")
    # All seeds share one frontier: a common root that links to each.
    linked = of_kind(edges, kinds).select("src", "dst")
    rooted = linked.unionByName(one.select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))).withColumn("kind", F.lit("calls"))
    root = edges.sparkSession.range(1).select(F.lit(-1).cast("long").alias("root_id"))
    return walk(rooted, root, hops + 1, "both", ["calls"]).select(F.col("node_id").alias("id"), (F.col("depth") - 1).alias("depth"))


def files(nodes: DataFrame, reached: DataFrame, start: DataFrame) -> DataFrame:
    """(file_path, refs, direct, symbols): reached nodes by file; direct where one is a seed."""
    rows = reached.join(nodes, "id").where("file_path is not null").join(start.select("id", F.lit(True).alias("seed")), "id", "left")
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "symbol", F.struct("depth", "ord", "name")))), lambda x: x["name"])
    return rows.groupBy("file_path").agg(F.count("*").alias("refs"), F.bool_or(F.coalesce("seed", F.lit(False))).alias("direct"), names.alias("symbols"))


def tiered(found: DataFrame, anchor: str) -> DataFrame:
    """Ranked files with position and part 1 (the first CORE), 2 (the next NEXT) or 3."""
    rows = rank.rank(found, F.lit(""), F.lit(anchor), keep_own=True)
    rows = rank.placed(rows, rank.order())
    return rows.withColumn("part", F.when(F.col("position") <= CORE, 1).when(F.col("position") <= CORE + NEXT, 2).otherwise(3))


def recent_commits(core: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = COMMITS) -> DataFrame:
    """(short_sha, file_path, subject) of the first commits of the core files (file_path, position), in order."""
    own = core.join(nodes.where("kind = 'file'").select(F.col("id").alias("src"), "file_path"), "file_path")
    commits = nodes.where("kind = 'commit'").select(F.col("id").alias("dst"), F.col("name").alias("short_sha"), F.col("doc").alias("subject"), F.col("ord").alias("commit_ord"))
    rows = own.join(edges.where("kind = 'touched_by'").select("src", "dst"), "src").join(commits, "dst")
    first = rows.groupBy("short_sha", "file_path").agg(F.min(F.struct("position", "commit_ord", "subject")).alias("r"))
    return first.orderBy("r.position", "r.commit_ord", "short_sha").limit(most).select("short_sha", "file_path", F.col("r.subject").alias("subject"))


def related(core: DataFrame, nodes: DataFrame, edges: DataFrame, kind: str, direction: str) -> DataFrame:
    """(file_path, name) of what mentions the core files, or of features that they are in."""
    own = core.join(nodes.where("kind = 'file'").select(F.col("id").alias("own"), "file_path"), "file_path")
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    links = edges.where(F.col("kind") == kind).select(F.col(a).alias("own"), F.col(b).alias("other"))
    return own.join(links, "own").join(nodes.select(F.col("id").alias("other"), "name"), "other").select("file_path", "name").distinct()


@dataclass
class Pack:
    markdown: str
    tokens: int
    core_files: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)


def tokens_of(markdown: str) -> int:
    return -(-len(markdown.encode("utf-16-be")) // 8)


def clamped(markdown: str, budget: int) -> str:
    """Cut to the budget at a line end if one is in the second half, with a note; never over it."""
    if tokens_of(markdown) <= budget:
        return markdown
    note, room = f"\n… [truncated to ~{budget} tokens]", budget * 4
    cut = markdown[:room]
    end = cut.rfind("\n")
    noted = (cut[:end] if end > room // 2 else cut) + note
    if tokens_of(noted) <= budget:
        return noted
    return markdown[: max(1, room - 1)] + "…" if room > 1 else markdown[: max(1, room)]


def rendered(task: str, rows: list, snippets: dict[str, str], parts: int, commits: list = ()) -> str:
    out = [HEADER, "", f"Task: {task}", ""]
    for r in rows:
        if r["part"] > parts:
            continue
        if r["part"] == 1:
            out += [f"#### {r['file_path']}", f"score {r['score']}, {r['tier']}; symbols: {', '.join(r['symbols'][:20])}"]
            if snippets.get(r["file_path"]):
                out += ["```", snippets[r["file_path"]], "```"]
        elif r["part"] == 2:
            out.append(f"- {r['file_path']} ({r['tier']}): {', '.join(r['symbols'][:8])}")
        else:
            out.append(f"- {r['file_path']}")
    out += [f"- {c['short_sha']} {c['file_path']}: {c['subject']}" for c in commits]
    return "\n".join(out)


def context_pack(nodes: DataFrame, edges: DataFrame, task: str, budget: int = 6000, contents: DataFrame | None = None) -> Pack:
    """The pack of a task within the budget. Less detail step by step: part 3, snippets, part 2, a cut.

    Only the ranked files reach the driver, as many as the budget has tokens at most, and with
    contents (path, content) the snippets of the core files.
    """
    if budget <= 0:
        return Pack(HEADER, tokens_of(HEADER))
    start = seeds(nodes, task)
    first = start.join(nodes, "id").orderBy("position").select("name").first()
    found = tiered(files(nodes, expanded(edges, start), start), first["name"] if first else task)
    ranked = found.orderBy("position").limit(CORE + NEXT + budget).collect()
    core = [r for r in ranked if r["part"] == 1]
    snippets: dict[str, str] = {}
    commits: list = []
    if core:
        spark: SparkSession = nodes.sparkSession
        paths = spark.createDataFrame([(r["file_path"], r["position"]) for r in core], "file_path string, position int")
        commits = recent_commits(paths, nodes, edges).collect()
        if contents is not None:
            widest = nodes.where("kind = 'symbol'").join(paths, "file_path").groupBy("file_path").agg(F.max_by(F.struct("start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), -F.col("ord"))).alias("s"))
            cut = widest.join(contents.withColumnRenamed("path", "file_path"), "file_path")
            snippets = {r["file_path"]: r["x"]["source"] for r in cut.select("file_path", text.snippet("content", F.col("s.start_line"), F.col("s.end_line"), SNIPPET_LINES).alias("x")).collect()}
    for parts, shown in ((3, snippets), (2, snippets), (2, {}), (1, {})):
        markdown = rendered(task, ranked, shown, parts, commits)
        if tokens_of(markdown) <= budget:
            break
    markdown = clamped(markdown, budget)
    kept = [r for r in core if f"#### {r['file_path']}" in markdown]
    return Pack(markdown, tokens_of(markdown), [r["file_path"] for r in kept], [s for r in kept for s in r["symbols"]])
