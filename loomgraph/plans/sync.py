"""Incremental builds: what changed in a tree, its files extracted again, the graph linked anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import audit, history
from loomgraph.plans import adjacency, build, snapshot, terms
from loomgraph.plans.build import Extracted, Graph
from loomgraph.scratch import written
from loomgraph.sources import tree


def classified(before: DataFrame, now: DataFrame, force: bool = False) -> DataFrame:
    """(path, state) of files (path, hash): new, changed, same or deleted; with force all that are there are changed."""
    rows = before.select("path", F.col("hash").alias("h0")).join(now.select("path", F.col("hash").alias("h1")), "path", "full")
    same = F.lit("changed") if force else F.lit("same")
    return rows.select("path", F.when(F.col("h1").isNull(), "deleted").when(F.col("h0").isNull(), "new").when(F.col("h0") != F.col("h1"), "changed").otherwise(same).alias("state"))


def _all_tables(x: Extracted, g: Graph, commits: DataFrame | None) -> dict:
    """The tables of a version that is built from nothing."""
    bucketed = {
        "nodes": snapshot.Bucketed(g.owned["nodes"], "_owner", "id"),
        "edges": snapshot.Bucketed(g.owned["edges"], "_owner", "src"),
        "pending_refs": snapshot.Bucketed(g.owned["pending_refs"], "_owner", "src_node"),
        "linked": snapshot.Bucketed(g.owned["linked"], "from_file", "from_file"),
        "resolved": snapshot.Bucketed(g.owned["resolved"], "from_path", "from_path"),
        **{name: snapshot.Bucketed(rows, "path", "path") for name, rows in x.tables().items()},
    }
    bucketed |= terms.built(g.owned["nodes"]) | adjacency.built(g.owned["edges"])
    return bucketed if commits is None else {**bucketed, "commits": commits, **{name: g.owned[name] for name in build.COUNTS}}


def full(spark: SparkSession, store: str, files: DataFrame, commits: DataFrame | None = None, repo_id: int = 1, manifest: dict | None = None) -> str:
    """Builds the graph of files from nothing and publishes it."""
    x = build.extracted(written(files, "contents"))
    return snapshot.publish(spark, store, _all_tables(x, build.link(x, repo_id, commits), commits), {"repo_id": repo_id, "history": commits is not None, **(manifest or {})})


@dataclass
class Report:
    """What a re-index changed: (path, name, change) of symbols, and findings as in audit.findings."""

    version: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    symbols: DataFrame | None = None
    findings: DataFrame | None = None


def _unresolved(g: Graph) -> DataFrame:
    """(path, name): imports of each file within the tree, by their form, that resolve to nothing."""
    lost = g.pending.where("kind = 'imports' and name like '.%'").select(F.col("src_node").alias("id"), F.col("name").alias("raw"))
    return lost.join(g.nodes.select("id", "file_path"), "id").select(F.col("file_path").alias("path"), F.col("raw").alias("name"))


def report(before: Graph, after: Graph, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol changes, findings) of the re-index of paths (path), from the graphs before and after it."""
    symbols = lambda g: g.nodes.where("kind = 'symbol'").join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("file_path").alias("path"), "name")
    diff = written(audit.symbol_diff(symbols(before), symbols(after)), "symbol-diff")
    callers, still = audit.inbound_callers(before.edges, before.nodes, paths), audit.inbound_callers(after.edges, after.nodes, paths)
    lost = written(callers.join(still.select("path", "src"), ["path", "src"], "left_anti"), "lost-callers")
    counts = audit.dangling(callers, still, after.pending.where("kind <> 'imports'"), diff)
    unresolved = _unresolved(after).join(paths.select("path"), "path", "left_semi")
    return diff, audit.findings(diff, lost, counts, unresolved)


def _differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The values of key in rows that only one of a and b has."""
    return a.exceptAll(b).select(key).unionByName(b.exceptAll(a).select(key)).where(f"{key} is not null").distinct()


def _within(rows: DataFrame, column: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows whose column is (or with left_anti isn't) among keys, a table of one column."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, how)


@dataclass
class Pulled:
    """How a history changed: parsed commits that came into its window, and (sha) of those that left it."""

    come: DataFrame
    gone: DataFrame


def _history(spark: SparkSession, store: str, now: dict, commits: DataFrame | Pulled | None) -> tuple[DataFrame, tuple[DataFrame, DataFrame], dict]:
    """The commits of the next version, their counts, and the tables to write for them.

    Of commits that were pulled only these are counted; those that the version has or lacks already don't count again.
    """
    if isinstance(commits, Pulled) and all(name in now["layout"] for name in build.COUNTS):
        old = snapshot.table(spark, store, "commits", now)
        counts = tuple(snapshot.table(spark, store, name, now) for name in build.COUNTS)
        gone = written(old.join(commits.gone.select("sha").distinct(), "sha", "left_semi"), "gone-commits")
        left = old.join(gone.select("sha"), "sha", "left_anti")
        come = written(commits.come.dropDuplicates(["sha"]).join(old.select("sha"), "sha", "left_anti"), "new-commits")
        stored = written(left.unionByName(come.select(*old.columns)), "commits")
        counts = build.kept_counts(history.adjusted_counts(counts, history.changed_files(come), history.changed_files(gone)))
    elif isinstance(commits, Pulled):
        raise ValueError("this version keeps no counts of its history: give all its commits")
    elif commits is None and all(name in now["layout"] for name in build.COUNTS):
        return snapshot.table(spark, store, "commits", now), tuple(snapshot.table(spark, store, name, now) for name in build.COUNTS), {}
    else:
        stored = written(snapshot.table(spark, store, "commits", now) if commits is None else commits, "commits")
        counts = build.kept_counts(history.change_counts(history.changed_files(stored)))
    return stored, counts, {"commits": stored, **dict(zip(build.COUNTS, counts))}


@dataclass
class Delta:
    """Tables in which a version differs from the one before, how many references were linked anew, and the graph after it."""

    tables: dict
    linked: int
    after: Graph


def delta(spark: SparkSession, store: str, now: dict, x: Extracted, gone: DataFrame, commits: DataFrame | Pulled | None) -> Delta:
    """What files extracted anew (x) and files gone (path) change in the graph of the version now.

    Imports are resolved again for these files only, unless files come, go or change their package: then for all, and
    files whose imports changed count too. A reference is linked again if it is in such a file, or if
    symbols of its name changed in the files; for all others the counts by name, file, directory and package that
    decide are the same as before. Mentions and tests are made again where what they name may have changed, history
    where files come or go.
    """
    old = lambda name: snapshot.table(spark, store, name, now, whole=True)
    repo_id = now["repo_id"]
    paths = written(x.files.select("path").unionByName(gone.select("path")).distinct(), "paths")
    files0, nodes0 = old("extracted_files"), old("nodes")
    files1 = written(_within(files0, "path", paths, "left_anti").unionByName(x.files, allowMissingColumns=True), "files")
    shape = ["path", "role", "language", "package", "module"]
    moved = not _differ(_within(files0, "path", paths).select(*shape), x.files.select(*shape), "path").isEmpty()

    fresh_nodes = written(build.owned_nodes(build.file_nodes(x, repo_id)), "fresh-nodes")
    old_nodes = _within(nodes0, "_owner", paths)
    tree_nodes = written(_within(nodes0.where("kind in ('file', 'symbol', 'doc')"), "_owner", paths, "left_anti").unionByName(fresh_nodes), "tree-nodes")
    told = ["id", "name", "subkind", "qualified_name", "file_path"]
    symbols = lambda n: n.where("kind = 'symbol'").select(*told)
    names = symbols(old_nodes).unionByName(symbols(fresh_nodes)).select("name").distinct() if moved else _differ(symbols(old_nodes), symbols(fresh_nodes), "name")
    names = written(names, "names")

    imports1 = _within(old("extracted_imports"), "path", paths, "left_anti").unionByName(x.imports)
    resolved0 = old("resolved")
    if moved:
        resolved1 = written(build.resolved_imports(imports1, files1), "resolved")
        importers = written(_differ(resolved0.select("from_path", "raw", "to_path"), resolved1.select("from_path", "raw", "to_path"), "from_path").unionByName(paths.select(F.col("path").alias("from_path"))).distinct(), "importers")
    else:
        again = build.resolved_imports(x.imports, files1)
        resolved1 = written(_within(resolved0, "from_path", paths, "left_anti").unionByName(again.select(*resolved0.columns)), "resolved")
        importers = paths.select(F.col("path").alias("from_path"))
    fresh_resolved = _within(resolved1, "from_path", importers)

    refs1 = _within(old("extracted_refs"), "path", paths, "left_anti").unionByName(x.refs)
    touched = _within(refs1, "path", importers).unionByName(_within(_within(refs1, "path", importers, "left_anti"), "name", names).select(*refs1.columns))
    numbered = written(build.numbered_refs(touched, files1), "numbered")
    known = build.own_symbols(tree_nodes, files1)
    sources = numbered.select("from_file")
    linked = written(build.linked_refs(numbered, _within(known, "name", numbered.select("name")), _within(known, "file_path", sources), _within(resolved1, "from_path", sources)), "linked")
    owners = written(sources.unionByName(importers.select(F.col("from_path").alias("from_file"))).distinct(), "owners")
    kept = _within(_within(_within(old("linked"), "from_file", owners), "from_file", importers, "left_anti"), "ref_id", numbered.select("ref_id"), "left_anti")
    fresh_linked = written(linked.unionByName(kept.select(*linked.columns)), "fresh-linked")

    edges0 = old("edges")
    redo = lambda keys, group: keys.select(F.col(keys.columns[0]).alias("_owner"), F.lit(group).alias("_group"))
    file_ids = paths.select(build.file_id("path").alias("dst"))
    tests = edges0.where("kind = 'tests'")
    testing = tests.select("_owner").distinct().unionByName(refs1.select(F.col("path").alias("_owner")).distinct()) if moved else _within(tests, "dst", file_ids).select("_owner").unionByName(paths.select(F.col("path").alias("_owner")))
    testing = written(testing.distinct(), "testing")
    only = None if moved else testing.select(F.col("_owner").alias("path"))
    docs = _within(old("extracted_docs"), "path", paths, "left_anti").unionByName(x.docs) if moved or not names.isEmpty() else x.docs
    docs = written(docs, "docs")
    groups = [redo(owners, "ref"), redo(importers, "imports"), redo(paths, "contains"), redo(testing, "tests"), redo(docs.select("path").unionByName(paths), "mentions")]
    fresh = [build.ref_edges(fresh_linked, repo_id), build.import_edges(fresh_resolved, repo_id), build.contains(x.symbols, fresh_nodes, repo_id), build.tests(tree_nodes, refs1, repo_id, only), build.mentions(docs, tree_nodes, repo_id)]
    redo_nodes, fresh_all = paths.select(F.col("path").alias("_owner")), fresh_nodes
    everywhere = commits is not None or bool(now.get("history") and moved)  # history is spread over all buckets
    told_tables = {}
    if everywhere:
        stored, counts, told_tables = _history(spark, store, now, commits)
        more, links = build.told_history(stored, tree_nodes, repo_id, counts)
        groups.append(redo(spark.createDataFrame([("",)], "_owner string"), "history"))
        fresh.append(links)
        redo_nodes = redo_nodes.unionByName(spark.createDataFrame([("",)], "_owner string"))
        fresh_all = fresh_nodes.unionByName(build.owned_nodes(more))
    all_groups, all_fresh = groups[0], fresh[0]
    for g, f in zip(groups[1:], fresh[1:]):
        all_groups, all_fresh = all_groups.unionByName(g), all_fresh.unionByName(f)
    all_fresh, all_groups = written(all_fresh, "fresh-edges"), written(all_groups.distinct(), "redo-edges")
    waiting = written(build.pending_refs(fresh_linked, _within(imports1, "path", owners), _within(resolved1, "from_path", owners), repo_id), "waiting")
    by_path = redo(paths, "").select("_owner")
    revised = lambda rows, keys, key, spread=None, all_=False: snapshot.Revised(keys, rows, key, spread or key, all_)
    named = lambda keys, name: keys.select(F.col(keys.columns[0]).alias(name))
    tables = {
        "nodes": revised(fresh_all, redo_nodes, "_owner", "id", everywhere),
        "edges": revised(all_fresh, all_groups, "_owner", "src", everywhere),
        "pending_refs": revised(waiting, named(owners, "_owner"), "_owner", "src_node"),
        "linked": revised(fresh_linked, owners, "from_file"),
        "resolved": revised(fresh_resolved, importers, "from_path"),
        **{name: revised(rows, named(by_path, "path"), "path") for name, rows in x.tables().items()},
    }
    tables |= terms.changed(spark, store, now, nodes0.join(redo_nodes, "_owner", "left_semi"), fresh_all)
    tables |= adjacency.changed(now, edges0.join(all_groups, ["_owner", "_group"], "left_semi"), all_fresh)
    tables |= told_tables
    plain = lambda rows: rows.select(*[c for c in rows.columns if not c.startswith("_")])
    nodes1 = nodes0.join(redo_nodes, "_owner", "left_anti").unionByName(fresh_all)
    edges1 = edges0.join(all_groups, ["_owner", "_group"], "left_anti").unionByName(all_fresh)
    pending1 = old("pending_refs").join(named(owners, "_owner"), "_owner", "left_anti").unionByName(waiting)
    return Delta(tables, numbered.count(), Graph(plain(nodes1), plain(edges1), plain(pending1)))


#: How often a re-index begins anew because another was published meanwhile.
ATTEMPTS = 5


def reindex(spark: SparkSession, store: str, files: DataFrame, gone: DataFrame, commits: DataFrame | Pulled | None = None, manifest: dict | None = None) -> Report:
    """Takes new contents of files (path, role, language, content, ...) and files gone (path) into the graph.

    Only these files are extracted, and only what they may have changed is linked again, so that the graph
    equals a full build. Inbound edges of symbols that stay are kept, as their ids don't depend on
    lines. commits, if given, replace the stored history, or, as Pulled, come to it and leave it. If another version was published meanwhile, it is done again
    from that one, so that neither's changes are lost.
    """
    files, gone = written(files, "contents"), written(gone.select("path").distinct(), "gone")
    x = build.extracted(files)
    for attempt in range(ATTEMPTS):
        now = snapshot.current(spark, store)
        if now is None:
            raise FileNotFoundError(f"no snapshot in {store}")
        before = Graph(*[snapshot.table(spark, store, t, now) for t in ("nodes", "edges", "pending_refs")])
        found = delta(spark, store, now, x, gone, commits)
        diff, findings = report(before, found.after, files.select("path").unionByName(gone).distinct())
        diff, findings = written(diff, "diff"), written(findings, "findings")
        counts = {"indexed": files.count(), "deleted": gone.count(), "linked": found.linked}
        told = {k: v for k, v in now.items() if k not in ("version", "number", "layout", "schemas", "buckets")}
        try:
            version = snapshot.publish(spark, store, found.tables, {**told, "history": commits is not None or bool(now.get("history")), **(manifest or {})}, now)
        except snapshot.Conflict:
            if attempt == ATTEMPTS - 1:
                raise
            continue
        return Report(version, counts, diff, findings)


def sync(spark: SparkSession, root: str, store: str, rules: list[tuple[str, bool]] = (), commits: DataFrame | Pulled | None = None, force: bool = False, manifest: dict | None = None) -> Report:
    """Brings the graph in store up to the tree at root.

    Files of known size and time aren't read; of the others the content decides. A tree without changes
    publishes nothing, unless there are new commits.
    """
    now = snapshot.current(spark, store)
    if now is None:
        raise FileNotFoundError(f"no snapshot in {store}")
    known = snapshot.table(spark, store, "extracted_files", now).select("path", "hash", "size", "mtime")
    listed = written(tree.listing(spark, root, list(rules)), "listing")
    touched = listed if force else listed.join(known.drop("hash"), ["path", "size", "mtime"], "left_anti")
    gone = known.join(listed, "path", "left_anti").select("path")
    files = written(tree.contents(spark, root, touched), "contents")
    states = classified(known.join(files, "path", "left_semi"), files, force)
    changed = files.join(states.where("state in ('new', 'changed')"), "path", "left_semi")
    counts = {"listed": listed.count(), "read": files.count()}
    if commits is None and changed.isEmpty() and gone.isEmpty():
        return Report(counts={**counts, "indexed": 0, "deleted": 0})
    out = reindex(spark, store, changed, gone, commits, manifest)
    out.counts = {**counts, **out.counts}
    return out


def applied(spark: SparkSession, store: str) -> Callable[[DataFrame, int], None]:
    """A sync for streaming.changes.apply_changes: takes batches of the last writes (path, content; null content: deleted) into the graph."""

    def one(batch: DataFrame, number: int) -> None:
        rows = tree.kept(batch.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0))))
        text = rows.where("content is not null").withColumn("language", tree.text.language("path")).withColumn("hash", F.sha2(F.encode("content", "UTF-8"), 256)).withColumn("mtime", F.lit(None).cast("long"))
        reindex(spark, store, text.select("path", "size", "mtime", "hash", "role", "language", "content"), batch.where("content is null").select("path"), manifest={"batch": number})

    return one
