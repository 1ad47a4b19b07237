"""Re-indexes whose cost follows the edit, and versions that lose no update; the command line in a process of its own."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import impact, search, traverse
from loomgraph.plans import adjacency, build, snapshot, sync, terms
from loomgraph.sources import tree

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = 300


def source(i, extra=""):
    return f"import {{ fn{(i + 1) % COUNT} }} from './f{(i + 1) % COUNT}'\nexport function fn{i}() {{\n  fn{(i + 1) % COUNT}()\n  common()\n}}\n{extra}"


def table(spark, rows):
    files = tree.kept(spark.createDataFrame([(p, len(c), c) for p, c in rows.items()], "path string, size long, content string"))
    return files.withColumn("language", F.lit("typescript")).withColumn("hash", F.sha2("content", 256)).withColumn("mtime", F.lit(0).cast("long"))


def graph(spark, store):
    return build.Graph(*[snapshot.table(spark, store, t) for t in ("nodes", "edges", "pending_refs")])


def same(a, b):
    for x, y in ((a.nodes, b.nodes), (a.edges, b.edges), (a.pending, b.pending)):
        columns = sorted(x.columns)
        assert sorted(map(str, x.select(columns).collect())) == sorted(map(str, y.select(columns).collect()))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = {f"src/f{i}.ts": source(i) for i in range(COUNT)}
    folder = f"file://{tmp_path_factory.mktemp('delta')}/s"
    sync.full(spark, folder, table(spark, rows))
    return folder, rows


def searched(spark, folder):
    """The kept index finds what a search of all nodes does, with equal scores."""
    asked = search.as_queries(spark, ["fn7 added", "common", "f1", "nothing here", "x"])
    hits = lambda rows: sorted((r.query_id, r.node_id, r.kind, r.position, round(r.score, 9)) for r in rows.collect())
    want = hits(search.search(snapshot.table(spark, folder, "nodes"), asked))
    assert want and hits(terms.search(spark, folder, asked)) == want


def walked(spark, folder):
    """The kept adjacency holds the edges, and walks over it find what walks over all edges do."""
    nodes, edges = snapshot.table(spark, folder, "nodes"), snapshot.table(spark, folder, "edges")
    rows = lambda df: sorted(map(str, df.collect()))
    for name, at, goal in adjacency.SIDES.values():
        assert rows(snapshot.table(spark, folder, name).select("at", "next", "kind")) == rows(edges.select(F.col(at).alias("at"), F.col(goal).alias("next"), "kind").distinct())
    kept, some = adjacency.of(spark, folder, edges), nodes.where("name in ('fn7', 'fn8', 'src/f9.ts')").select("id")
    assert isinstance(kept, adjacency.Kept)
    roots = some.withColumnRenamed("id", "root_id")
    for direction in ("in", "out", "both"):
        assert rows(traverse.walk(kept, roots, 2, direction)) == rows(traverse.walk(edges, roots, 2, direction)) != []
    assert rows(impact.impact(nodes, kept, some, 2)) == rows(impact.impact(nodes, edges, some, 2)) != []
    moves = kept.moves("in", ["calls"])
    one = moves.near(nodes.where("name = 'fn7'").select(F.col("id").alias("node_id")))
    whole = snapshot.table(spark, folder, "moves_in")
    assert len(one.inputFiles()) == 1 < len(whole.inputFiles()) / 20
    assert {r["at"] for r in one.collect()} == {r["id"] for r in nodes.where("name = 'fn7'").collect()}


def test_walks_of_wide_frontiers_read_buckets(spark, store, monkeypatch):
    folder, _ = store
    monkeypatch.setattr(adjacency, "ASKED", 3)
    walked_rows = lambda edges: sorted(map(str, traverse.walk(edges, roots, 2, "in").collect()))
    edges = snapshot.table(spark, folder, "edges")
    roots = snapshot.table(spark, folder, "nodes").select(F.col("id").alias("root_id")).orderBy("root_id").limit(20)
    assert walked_rows(adjacency.of(spark, folder, edges)) == walked_rows(edges)


def test_an_edit_links_what_it_touches(spark, store):
    folder, rows = store
    none = spark.createDataFrame([], "path string")
    before = snapshot.current(spark, folder)
    rows["src/f5.ts"] = source(5, "export function added() {\n  fn7()\n}\n")
    out = sync.reindex(spark, folder, table(spark, {"src/f5.ts": rows["src/f5.ts"]}), none)
    assert out.counts["linked"] == 3 and {(r.name, r.change) for r in out.symbols.collect()} == {("added", "added")}
    now = snapshot.current(spark, folder)
    new = {name: found.get(now["version"]) or [] for name, found in now["layout"].items()}
    assert all(len(found) <= 2 for found in new.values()), new  # of 64 buckets
    assert now["number"] == before["number"] + 1
    searched(spark, folder)
    walked(spark, folder)
    assert now["layout"]["postings"] == before["layout"]["postings"]  # the main segment isn't written again
    read, whole = terms.index(spark, folder, ["fn7"]).inputFiles(), terms.index(spark, folder).inputFiles()
    assert 0 < len(read) < len(whole) / 4
    merged = terms.changed(spark, folder, now, snapshot.table(spark, folder, "nodes").limit(0), snapshot.table(spark, folder, "nodes").limit(0), share=-1)
    assert merged["postings"].rows.count() == terms.index(spark, folder).count()


def test_two_reindexes_from_one_base(spark, store, monkeypatch):
    """Another re-index is published between this one's reading and its publication: both stay.

    One of them makes a name known that all files call, which takes the edges of all its callers.
    """
    folder, rows = store
    none = spark.createDataFrame([], "path string")
    rows["src/f20.ts"], rows["src/f21.ts"] = source(20, "export function one() {\n}\n"), source(21, "export function common() {\n}\n")
    plain, done = sync.delta, []

    def delayed(*args):
        out = plain(*args)
        if not done:
            done.append(True)
            other = sync.reindex(spark, folder, table(spark, {"src/f21.ts": rows["src/f21.ts"]}), none)
            assert other.counts["linked"] >= COUNT
        return out

    monkeypatch.setattr(sync, "delta", delayed)
    sync.reindex(spark, folder, table(spark, {"src/f20.ts": rows["src/f20.ts"]}), none)
    searched(spark, folder)
    walked(spark, folder)
    names = {r.name for r in snapshot.table(spark, folder, "nodes").where("name in ('one', 'common')").collect()}
    assert names == {"one", "common"}
    same(graph(spark, folder), build.build(table(spark, rows)))


def test_a_version_from_an_old_base_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    rows = spark.range(5).select(F.concat(F.lit("p"), "id").alias("path"), "id")
    snapshot.publish(spark, folder, {"t": snapshot.Bucketed(rows, "path", "id")}, buckets=4)
    base = snapshot.current(spark, folder)
    redo = spark.createDataFrame([("p1",)], "path string")
    change = lambda n: {"t": snapshot.Revised(redo, spark.createDataFrame([("p1", n)], "path string, id long"), "path", "id")}
    snapshot.publish(spark, folder, change(10), base=base)
    with pytest.raises(snapshot.Conflict):
        snapshot.publish(spark, folder, change(20), base=base)
    assert sorted(map(tuple, snapshot.table(spark, folder, "t").collect())) == [("p0", 0), ("p1", 10), ("p2", 2), ("p3", 3), ("p4", 4)]
    gone = {"t": snapshot.Revised(rows.select("path"), rows.limit(0), "path", "id")}
    snapshot.publish(spark, folder, gone, base=snapshot.current(spark, folder))
    assert snapshot.table(spark, folder, "t").count() == 0 and snapshot.table(spark, folder, "t").columns == ["path", "id"]
    assert len(os.listdir(tmp_path / "s")) <= 4  # pointers, the current version, and what it and the one before refer to


def test_the_command_line_starts(tmp_path):
    few = {"PYSPARK_SUBMIT_ARGS": "--master local[4] --conf spark.sql.shuffle.partitions=4 --conf spark.ui.enabled=false pyspark-shell"}
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=REPO, env=os.environ | few, capture_output=True, text=True, timeout=400)
    assert "impact" in run("-m", "loomgraph.cli", "--help").stdout
    out = run("-c", "import bench; print(len(bench.HEADLINE))")
    assert out.returncode == 0, out.stderr
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def low():\n    pass\n")
    (root / "b.py").write_text("from .a import low\n\n\ndef high():\n    low()\n")
    assert (out := run("-m", "loomgraph.cli", "index", str(root), "--store", f"file://{tmp_path}/store")).returncode == 0, out.stderr[-2000:]
    out = run("-m", "loomgraph.cli", "impact", "low", "--store", f"file://{tmp_path}/store")
    assert out.returncode == 0 and "b.py" in out.stdout, out.stderr[-2000:]
