"""python -m loomgraph.cli COMMAND: index a tree, then ask the graph."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config, scratch
from loomgraph.functions import text
from loomgraph.operators import context, graph, history, impact, locate, packs, search, traverse
from loomgraph.plans import adjacency, build, snapshot, sync, terms
from loomgraph.sources import gitlog, tree


def _resolved(nodes: DataFrame, name: str) -> DataFrame:
    asked = nodes.sparkSession.createDataFrame([(0, name)], "query_id int, name string")
    return locate.resolve(nodes, asked).where("position = 1").select("id")


def _commits(spark: SparkSession, root: str, most: int | None, only: list[str] | None = None) -> DataFrame | None:
    """The log of a local repository, or only of these commits, read on the driver, as git runs there: max_commits at most."""
    with tempfile.TemporaryDirectory(prefix="loomgraph-") as folder:
        if not gitlog.export_log(root, f"{folder}/log", most or config.load(root).max_commits, only):
            return None
        with open(f"{folder}/log", encoding="utf-8", errors="replace") as f:
            records = [(r,) for r in f.read().split("\x1e") if r]
    return scratch.written(history.parse_log(spark.createDataFrame(records, "value string")), "log")


def _pulled(spark: SparkSession, root: str, store: str, now: dict, most: int | None) -> DataFrame | sync.Pulled | None:
    """What came into the window of the log and left it since the version now. Of a version without counts, or if git can't tell, the whole log."""
    window = gitlog.window(root, most or config.load(root).max_commits)
    if window is None or any(name not in now.get("layout", {}) for name in build.COUNTS):
        return _commits(spark, root, most)
    known = {r["sha"] for r in snapshot.table(spark, store, "commits", now).select("sha").collect()}  # max_commits at most
    new = [sha for sha in window if sha not in known]
    come = _commits(spark, root, most, new) if new else snapshot.table(spark, store, "commits", now).limit(0)
    gone = spark.createDataFrame([(sha,) for sha in known.difference(window)], "sha string")
    return _commits(spark, root, most) if come is None else sync.Pulled(come, gone)


def _rules(root: str) -> list[tuple[str, bool]]:
    return tree.ignore_file(root) + tree.ignore_rules("\n".join(config.load(root).ignore))


def index(spark: SparkSession, root: str, store: str, most: int | None = None) -> str:
    files = tree.scan(spark, root, _rules(root))
    return sync.full(spark, store, files, _commits(spark, root, most), manifest={"head": gitlog.head(root)})


def update(spark: SparkSession, root: str, store: str, most: int | None = None, force: bool = False) -> sync.Report:
    """Syncs the store with the tree. If HEAD moved, only commits that are new in the window of the log are read."""
    now, head = snapshot.current(spark, store) or {}, gitlog.head(root)
    commits = _pulled(spark, root, store, now, most) if head != now.get("head") else None
    return sync.sync(spark, root, store, _rules(root), commits, force, {"head": head})


def _line() -> Column:
    """A node on one line. Columns need a session, so none is made at import."""
    return text.node_line("kind", "subkind", "name", "qualified_name", "file_path", "start_line")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("command", choices=["index", "sync", "search", "callers", "callees", "impact", "explore", "context", "contexts", "resolve", "stats", "export"])
    p.add_argument("what", nargs="*")
    p.add_argument("--store", default=".loomgraph")
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--budget", type=int, default=6000)
    p.add_argument("--commits", type=int, help="how many commits of the log are read")
    p.add_argument("--sources", help="explore, contexts: the tree whose lines are shown")
    p.add_argument("--force", action="store_true", help="sync: take every file as changed")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if a.command == "index":
        print(index(spark, a.what[0], a.store, a.commits))
        return
    if a.command == "sync":
        out = update(spark, a.what[0], a.store, a.commits, a.force)
        print(out.counts)
        if out.findings is not None:
            out.findings.show(100, False)
        return
    nodes, edges = snapshot.table(spark, a.store, "nodes"), snapshot.table(spark, a.store, "edges")
    if a.command == "search":
        hits = terms.search(spark, a.store, search.as_queries(spark, [" ".join(a.what)]), limit=a.limit)
        for r in hits.select("node_id", "score", "position").join(nodes.select(F.col("id").alias("node_id"), _line().alias("line")), "node_id").orderBy("position").collect():
            print(f"{r['score']:.2f}  {r['line']}")
    elif a.command in ("callers", "callees"):
        root = _resolved(nodes, a.what[0]).withColumnRenamed("id", "root_id")
        for r in traverse.callers(adjacency.of(spark, a.store, edges), nodes, root, a.depth, a.limit, "in" if a.command == "callers" else "out").orderBy("depth", "symbol").collect():
            print(f"  depth {r['depth']}  {r['symbol']} — {r['file'] or '(no file)'}{':' + str(r['line']) if r['line'] else ''}  (via {' -> '.join(r['via_path'])})")
    elif a.command == "impact":
        files = impact.impact(nodes, adjacency.of(spark, a.store, edges), _resolved(nodes, a.what[0]), a.depth, a.limit)
        for r in files.orderBy("position").collect():
            print(f"  [{r['tier']}] {r['file_path']} (rank {r['score']:.2f}, {', '.join(r['symbols'])})")
        for r in impact.cochanges_of(files, nodes, edges).orderBy("position", "n").collect():
            print(f"  {r['file_path']} co-changes with {r['with_file']} (weight {r['weight']:.2f})")
    elif a.command == "explore":
        ends = [_resolved(nodes, w).first() for w in a.what]
        found = [(0, i, x["id"]) for i, x in enumerate(ends) if x]
        asked = spark.createDataFrame(found, "set_id int, position int, id long")
        contents = tree.scan(spark, a.sources, tree.ignore_file(a.sources)) if a.sources else None
        paths, symbols = traverse.explore(nodes, edges, asked, contents)
        named = paths.join(nodes.select("id", "name"), "id").groupBy("position").agg(F.array_sort(F.collect_list(F.struct("step", "edge_kind", "name"))).alias("steps"))
        for r in named.orderBy("position").collect():
            print("".join(f" --{s['edge_kind']}--> {s['name']}" if s["step"] else s["name"] for s in r["steps"]))
        for r in symbols.collect():
            print(f"### {r['name']} ({r['file_path'] or 'unknown'}:{r['start_line'] or '?'})", r["source"] or "", "… [truncated]" if r["truncated"] else "", sep="\n")
    elif a.command == "context":
        print(context.context_pack(nodes, edges, " ".join(a.what), a.budget).markdown)
    elif a.command == "contexts":  # TASKS OUT: JSON lines of tasks, and the folder for their packs
        tasks = spark.read.schema("task_id long, task string, budget int").json(a.what[0]).withColumn("budget", F.coalesce("budget", F.lit(a.budget)))
        contents = tree.scan(spark, a.sources, _rules(a.sources)) if a.sources else None
        packs.packs(nodes, edges, tasks, contents, adjacency.of(spark, a.store, edges)).write.mode("overwrite").json(a.what[1])
    elif a.command == "resolve":
        _resolved(nodes, a.what[0]).join(nodes, "id").show(1, False)
    elif a.command == "stats":
        graph.count_stats(nodes, edges).show(100, False)
        graph.edge_stats(edges).show(100, False)
    else:
        graph.export_nodes(nodes).write.mode("overwrite").json(f"{a.what[0]}/nodes")
        graph.export_edges(edges).write.mode("overwrite").json(f"{a.what[0]}/edges")


if __name__ == "__main__":
    main()
