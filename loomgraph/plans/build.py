"""Graph tables of a working tree: files to nodes, edges and pending references.

What a file says by itself is extracted once and kept in tables; linking joins these tables. Each step is
a written table, so that no plan derives lines or symbols anew.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import docs as documents
from loomgraph.operators import history, resolve
from loomgraph.scratch import written
from loomgraph.sources import extract


@dataclass
class Graph:
    """The graph, and what a version keeps of it: tables by name, whose rows have an _owner, the path that they come from."""

    nodes: DataFrame
    edges: DataFrame
    pending: DataFrame
    owned: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Extracted:
    """What files say by themselves: tables with a column path."""

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    imports: DataFrame
    docs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f"extracted_{f.name}": getattr(self, f.name) for f in fields(self)}


def extracted(files: DataFrame) -> Extracted:
    """Of files (path, role, language, content, ...)."""
    code = files.where("role = 'code'").select("path", "language", "content")
    rows = written(extract.statements(code), "statements")
    place = Window.partitionBy("path", "qualified_name").orderBy("start_line", "kind")
    symbols = written(extract.symbols(rows).withColumn("ordinal", F.row_number().over(place)), "symbols")
    found = symbols.drop("stmt", "last_stmt")
    about = [c for c in ("hash", "size", "mtime") if c in files.columns]
    own = files.select("path", "role", "language", *about).join(extract.packages(code), "path", "left")
    module = F.when(F.col("path") == "go.mod", F.nullif(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1), F.lit("")))
    own = own.join(files.select("path", module.alias("module")), "path")
    return Extracted(written(own, "files"), found, written(extract.references(rows, symbols), "refs"), written(extract.imports(code), "imports"), written(files.where("role = 'doc'").select("path", F.col("content").alias("body")), "docs"))


def _id(*parts: str | Column) -> Column:
    return F.xxhash64(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def _shaped(rows: DataFrame, kind: str, id_: Column, repo_id: int, **columns: Column) -> DataFrame:
    """rows as nodes without ord; columns that aren't given are null."""
    given = {"id": id_, "repo_id": F.lit(repo_id), "kind": F.lit(kind), "exported": F.lit(False), **columns}
    names = [c.strip().split(" ") for c in schema.NODES.split(",")]
    return rows.select(*[given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in names if name != "ord" or "ord" in given])


def file_nodes(x: Extracted, repo_id: int) -> DataFrame:
    """Nodes of files, symbols and docs."""
    code = x.files.where("role = 'code'")
    path = F.col("path")
    files = _shaped(code, "file", _id(F.lit("file"), "path"), repo_id, name=path, file_path=path, language=F.col("language"))
    # Lines aren't part of a symbol's id, so that an edit above it leaves its id and the edges to it.
    named = x.symbols.join(code.select("path", "language"), "path")
    symbols = _shaped(named, "symbol", _id(F.lit("symbol"), "path", "qualified_name", "ordinal"), repo_id, subkind=F.col("kind"), file_path=path, **{c: F.col(c) for c in ("name", "qualified_name", "start_line", "end_line", "language", "signature", "doc", "exported")})
    said = documents.described(x.docs)
    docs = _shaped(said, "doc", _id(F.lit("doc"), "path"), repo_id, subkind=F.col("subkind"), name=F.col("title"), file_path=path, doc=F.col("summary"))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("kind", "start_line", "name", "id"))
    return files.unionByName(symbols).unionByName(docs).withColumn("ord", (F.xxhash64("file_path") % 1_000_000_007) * 100_000 + place)


#: Kinds of edges that are made together, from one owner.
GROUPS = {"contains": "contains", "imports": "imports", "tests": "tests", "mentions": "mentions", "touched_by": "history", "co_change": "history", "in_feature": "history"}


def file_id(path: str) -> Column:
    return _id(F.lit("file"), path)


def owned_edges(rows: DataFrame, owner: Column, repo_id: int) -> DataFrame:
    """rows (src, dst, kind[, weight, meta]) as edges with _owner and _group. Edges from one node belong to one owner, so only its rows can repeat."""
    group = F.lit("ref")
    for kind, name in GROUPS.items():
        group = F.when(F.col("kind") == kind, name).otherwise(group)
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    meta = F.col("meta") if "meta" in rows.columns else F.lit(None).cast("string")
    out = rows.select(owner.alias("_owner"), "src", "dst", "kind", weight.alias("weight"), meta.alias("meta")).dropDuplicates(["src", "dst", "kind"])
    return out.select(F.xxhash64("src", "dst", "kind").alias("id"), F.lit(repo_id).cast("long").alias("repo_id"), "src", "dst", "kind", "weight", "meta", "_owner", group.alias("_group"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, raw, to_path) of imports (path, language, raw) within files (path, role, language, package, module)."""
    asked = imports.select(F.col("path").alias("from_path"), "language", "raw")
    paths = files.where("role = 'code'").select("path", "language", "package")
    module = files.where("module is not null").select("module").first()  # of the one go.mod
    relative = resolve.relative_imports(asked.where("language not in ('go', 'java')"), paths)
    java = resolve.java_imports(asked.where("language = 'java'"), paths)
    go = resolve.go_imports(asked.where("language = 'go'"), paths, module["module"] if module else None)
    return relative.unionByName(java).unionByName(go).where("from_path <> to_path")


def import_edges(resolved: DataFrame, repo_id: int) -> DataFrame:
    rows = resolved.select("from_path", file_id("from_path").alias("src"), file_id("to_path").alias("dst"), F.lit("imports").alias("kind"))
    return owned_edges(rows, F.col("from_path"), repo_id)


def numbered_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, from_file, from_symbol, name, kind, language, package) of refs (path, from_symbol, name, kind)."""
    rows = refs.withColumn("ref_id", F.xxhash64("path", F.coalesce("from_symbol", F.lit("")), "name", "kind")).withColumnRenamed("path", "from_file").dropDuplicates(["ref_id"])
    return rows.join(files.where("role = 'code'").select(F.col("path").alias("from_file"), "language", "package"), "from_file")


def own_symbols(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Symbol nodes as resolution takes them: (node_id, name, file_path, subkind, qualified_name, package, ord)."""
    packages = files.where("role = 'code'").select(F.col("path").alias("file_path"), "package")
    return nodes.where("kind = 'symbol'").select(F.col("id").alias("node_id"), "name", "file_path", "subkind", "qualified_name", "ord").join(packages, "file_path")


def linked_refs(numbered: DataFrame, known: DataFrame, around: DataFrame, resolved: DataFrame) -> DataFrame:
    """(ref_id, from_file, src, name, kind, target) of numbered refs; target is null where nothing is found.

    known are the symbols of the refs' names, around those of their files, resolved the imports of their files.
    """
    imported = resolved.select(F.col("from_path").alias("from_file"), F.col("to_path").alias("to_file"))
    targets = resolve.references(numbered, known, imported)
    sources = resolve.enclosing(numbered.withColumn("file_node", file_id("from_file")), around).join(numbered.select("ref_id", "from_file", "name", "kind"), "ref_id")
    return sources.join(targets.select("ref_id", "target"), "ref_id", "left").select("ref_id", "from_file", "src", "name", "kind", "target")


def ref_edges(linked: DataFrame, repo_id: int) -> DataFrame:
    return owned_edges(linked.where("src <> target").withColumnRenamed("target", "dst"), F.col("from_file"), repo_id)


def pending_refs(linked: DataFrame, imports: DataFrame, resolved: DataFrame, repo_id: int) -> DataFrame:
    """(repo_id, src_node, name, kind, _owner) of refs without a target, and of imports that resolve to no file."""
    repo = F.lit(repo_id).cast("long").alias("repo_id")
    refs = linked.where("target is null").select(repo, F.col("src").alias("src_node"), "name", "kind", F.col("from_file").alias("_owner"))
    asked = imports.select(F.col("path").alias("from_path"), "raw").join(resolved, ["from_path", "raw"], "left_anti")
    return refs.unionByName(asked.select(repo, file_id("from_path").alias("src_node"), F.col("raw").alias("name"), F.lit("imports").alias("kind"), F.col("from_path").alias("_owner"))).distinct()


def contains(symbols: DataFrame, nodes: DataFrame, repo_id: int) -> DataFrame:
    """Edges from files and outer symbols to the symbols in them."""
    id_ = _id(F.lit("symbol"), "path", "qualified_name", "ordinal").alias("node_id")
    rows = symbols.select(id_, F.col("path").alias("file_path"), "name", "qualified_name", "parent_name", file_id("path").alias("file_node")).join(nodes.select(F.col("id").alias("node_id"), "ord"), "node_id")
    rows = written(rows, "own")
    found = resolve.contains_edges(rows).join(rows.select(F.col("node_id").alias("dst"), "file_path"), "dst")
    return owned_edges(found.withColumn("kind", F.lit("contains")), F.col("file_path"), repo_id)


def tests(nodes: DataFrame, refs: DataFrame, repo_id: int, only: DataFrame | None = None) -> DataFrame:
    """Edges from test files, of only (path) if given, to what they test."""
    order = nodes.where("kind = 'file'").select(F.col("file_path").alias("path"), "ord")
    found = resolve.tests_edges(order, nodes.where("kind in ('file', 'symbol')"), refs.select(F.col("path").alias("from_file"), "name"), only)
    return owned_edges(found, F.col("test_path"), repo_id)


def mentions(docs: DataFrame, nodes: DataFrame, repo_id: int) -> DataFrame:
    """Edges from docs (path, body) to the files and symbols that they mention."""
    said = docs.withColumn("doc_id", _id(F.lit("doc"), "path"))
    found = documents.mentions(said, nodes).join(said.select("doc_id", "path"), "doc_id")
    return owned_edges(found.select("path", F.col("doc_id").alias("src"), "dst", F.lit("mentions").alias("kind")), F.col("path"), repo_id)


def owned_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_owner", F.coalesce("file_path", F.lit("")))


def link(x: Extracted, repo_id: int = 1, commits: DataFrame | None = None) -> Graph:
    """The graph of extracted files. Ids are hashes of what a node is, so that a full build equals an incremental one.

    Imports that resolve to no file of the tree stay pending, like references. commits are parsed log records.
    """
    nodes = written(file_nodes(x, repo_id), "nodes")
    resolved = written(resolved_imports(x.imports, x.files), "resolved")
    known = written(own_symbols(nodes, x.files), "own")
    linked = written(linked_refs(written(numbered_refs(x.refs, x.files), "numbered"), known, known, resolved), "linked")
    edges = import_edges(resolved, repo_id).unionByName(contains(x.symbols, nodes, repo_id)).unionByName(ref_edges(linked, repo_id))
    edges = edges.unionByName(tests(nodes, x.refs, repo_id)).unionByName(mentions(x.docs, nodes, repo_id))
    if commits is not None:
        commits = written(commits, "commits")
        counts = kept_counts(history.change_counts(history.changed_files(commits)))
        more, links = told_history(commits, nodes, repo_id, counts)
        nodes, edges = nodes.unionByName(more), edges.unionByName(links)
    owned = {"nodes": owned_nodes(nodes), "edges": edges, "pending_refs": pending_refs(linked, x.imports, resolved, repo_id)}
    owned = {k: written(v, k) for k, v in owned.items()}
    plain = [v.select(*[c for c in v.columns if not c.startswith("_")]) for v in owned.values()]
    told = {} if commits is None else dict(zip(COUNTS, counts))
    return Graph(*plain, {**owned, "linked": linked, "resolved": resolved, **told})


def build(files: DataFrame, repo_id: int = 1, commits: DataFrame | None = None) -> Graph:
    """Nodes, edges and pending references of files (path, role, language, content)."""
    return link(extracted(files), repo_id, commits)


#: The tables of history.change_counts that a version keeps.
COUNTS = ("pair_counts", "file_counts")


def kept_counts(counts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return written(counts[0], COUNTS[0]), written(counts[1], COUNTS[1])


def told_history(commits: DataFrame, nodes: DataFrame, repo_id: int, counts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Commit and feature nodes; touched_by, co_change and in_feature edges. counts are the commits' history.change_counts."""
    files = nodes.where("kind = 'file'").select("id", "file_path")
    dated = commits.join(history.commit_totals(commits).drop("short_sha"), "sha")
    commit_id, feature_id = F.xxhash64(F.lit("commit"), "sha"), F.xxhash64(F.lit("feature"), "scope")
    newest = -F.col("ts")
    commit_nodes = _shaped(dated, "commit", commit_id, repo_id, name=F.substring("sha", 1, 7), qualified_name=F.col("sha"), doc=F.col("subject"), meta=F.to_json(F.struct("author", "email", "ts", "insertions", "deletions")), ord=newest)
    touches = written(history.touched_by(commits, files), "touches")
    none = F.lit(None).cast("string").alias("meta")
    told = touches.select(F.col("file_id").alias("src"), commit_id.alias("dst"), F.lit("touched_by").alias("kind"), F.lit(1.0).alias("weight"), F.to_json(F.struct("insertions", "deletions")).alias("meta"))
    together = history.apply_cochanges(history.together(counts), files)
    found, members, in_files = history.features(commits.select("sha", "subject", newest.alias("ord")), touches)
    feature_nodes = _shaped(found, "feature", feature_id, repo_id, name=F.col("scope"), qualified_name=F.col("scope"), doc=F.col("doc"), meta=F.to_json(F.struct(F.col("commits").alias("commitCount"), "types")), ord=F.lit(0))
    of_commit = members.select(commit_id.alias("src"), feature_id.alias("dst"), F.lit("in_feature").alias("kind"), F.lit(1.0).alias("weight"), none)
    of_file = in_files.select(F.col("file_id").alias("src"), feature_id.alias("dst"), F.lit("in_feature").alias("kind"), F.col("weight").cast("double"), none)
    links = told.unionByName(together).unionByName(of_commit).unionByName(of_file)
    return commit_nodes.unionByName(feature_nodes), owned_edges(links, F.lit(""), repo_id)
