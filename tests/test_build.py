import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import build, snapshot, sync
from loomgraph.scratch import written
from loomgraph.sources import extract, gitlog, tree
from loomgraph.streaming import changes

# Own sources: a small harbour in each language.
TS = """import { Vessel } from './vessel.js'

// Moors a boat at the quay.
export function moor(boat: string): string {
  return signal(boat)
}

export const toll = (tons: number) => {
  return tons * 3
}

export class Ferry extends Vessel implements Afloat {
  private cars = 0

  sail(): void {
    this.cars++
    toll(this.cars)
    const pilot = new Pilot()
    pilot.guide()
  }

  load(
    cars: number,
    trucks: number,
  ): void {
    this.cars += cars
  }
}

export interface Afloat {
  draught(): number
}

export type Berth = { length: number }

export enum Flag {
  Red,
}
"""
PY = '''import math
from .vessel import Vessel


def moor(boat):
    return signal(boat)


class Ferry(Vessel):
    class Deck:
        def wash(self):
            scrub()

    def sail(
        self,
        speed,
    ):
        toll(speed)
        pilot.guide()


def _sink():
    pass
'''
GO = """package harbour

import (
	"os"
	"harbour.test/vessel"
)

type Ferry struct {
	Cars int
}

const Berths = 12

func Launch(cars int) *Ferry {
	return rig(cars)
}

func (f *Ferry) Sail() {
	toll(f.Cars)
}
"""
JAVA = """package test.harbour;

import test.harbour.vessel.Vessel;
import test.harbour.crew.*;
import static test.harbour.Tides.high;

public class Ferry extends Vessel implements Afloat {
    private int cars;

    public void sail() {
        Pilot.guide(cars);
    }

    class Deck {
        void wash(
                int times) {
            scrub(times);
        }
    }
}
"""
RUST = """use crate::vessel::Vessel;

pub struct Ferry {
    pub cars: u32,
}

pub trait Afloat {
    fn draught(&self);
}

impl Afloat for Ferry {
    fn draught(&self) {
        toll(&self.cars);
    }
}
"""


def test_extraction(spark):
    files = spark.createDataFrame([("f.ts", "typescript", TS), ("f.py", "python", PY), ("f.go", "go", GO), ("F.java", "java", JAVA), ("f.rs", "rust", RUST)], "path string, language string, content string")
    rows_ = written(extract.statements(files), "statements")
    found = written(extract.symbols(rows_), "symbols")
    rows = found.collect()
    s = {(r.path, r.qualified_name, r.kind): (r.start_line, r.end_line) for r in rows}
    assert s == {
        ("f.ts", "moor", "function"): (4, 6), ("f.ts", "toll", "function"): (8, 10), ("f.ts", "Ferry", "class"): (12, 28), ("f.ts", "Ferry.sail", "method"): (15, 20), ("f.ts", "Ferry.load", "method"): (22, 27),
        ("f.ts", "Afloat", "interface"): (30, 32), ("f.ts", "Berth", "type"): (34, 34), ("f.ts", "Flag", "enum"): (36, 38),
        ("f.py", "moor", "function"): (5, 6), ("f.py", "Ferry", "class"): (9, 19), ("f.py", "Ferry.Deck", "class"): (10, 12), ("f.py", "Deck.wash", "method"): (11, 12), ("f.py", "Ferry.sail", "method"): (14, 19), ("f.py", "_sink", "function"): (22, 23),
        ("f.go", "Ferry", "struct"): (8, 10), ("f.go", "Berths", "constant"): (12, 12), ("f.go", "Launch", "function"): (14, 16), ("f.go", "Ferry.Sail", "method"): (18, 20),
        ("F.java", "Ferry", "class"): (7, 20), ("F.java", "Ferry.cars", "variable"): (8, 8), ("F.java", "Ferry.sail", "method"): (10, 12), ("F.java", "Ferry.Deck", "class"): (14, 19), ("F.java", "Deck.wash", "method"): (15, 18),
        ("f.rs", "Ferry", "struct"): (3, 5), ("f.rs", "Afloat", "trait"): (7, 9), ("f.rs", "Afloat.draught", "method"): (8, 8), ("f.rs", "Ferry", "impl"): (11, 15), ("f.rs", "Ferry.draught", "method"): (12, 14),
    }
    by = {(r.path, r.name): r for r in rows}
    assert by["f.ts", "moor"].exported and not by["f.py", "_sink"].exported and by["f.ts", "moor"].doc == "Moors a boat at the quay."
    refs = {(r.path, r.from_symbol, r.name, r.kind) for r in extract.references(rows_, found).collect()}
    assert refs >= {
        ("f.ts", "sail", "toll", "calls"), ("f.ts", "moor", "signal", "calls"), ("f.ts", "sail", "guide", "calls"), ("f.ts", "Ferry", "Vessel", "extends"), ("f.ts", "Ferry", "Afloat", "implements"),
        ("f.py", "sail", "toll", "calls"), ("f.py", "wash", "scrub", "calls"), ("f.py", "Ferry", "Vessel", "extends"), ("f.go", "Sail", "toll", "calls"), ("F.java", "sail", "guide", "calls"), ("F.java", "wash", "scrub", "calls"),
        ("F.java", "Ferry", "Vessel", "extends"), ("f.rs", "draught", "toll", "calls"), ("f.rs", "Ferry", "Afloat", "implements"),
    }
    assert not any(name == "pilot" for _, _, name, _ in refs)
    raws = {(r.path, r.raw) for r in extract.imports(files).collect()}
    assert raws == {("f.ts", "./vessel.js"), ("f.py", ".vessel"), ("f.py", "math"), ("f.go", "os"), ("f.go", "harbour.test/vessel"), ("F.java", "test.harbour.vessel.Vessel"), ("F.java", "test.harbour.crew.*"), ("f.rs", "crate::vessel::Vessel")}


def test_long_literals_are_masked(spark):
    long_ = '"' + "{ab\\n" * 20_000 + '"'
    files = spark.createDataFrame([("a.ts", "typescript", f"export const tide = {long_}\nexport function ebb() {{\n  flow()\n}}\n")], "path string, language string, content string")
    found = {(r.name, r.start_line, r.end_line) for r in extract.symbols(extract.statements(files)).collect()}
    assert found == {("tide", 1, 1), ("ebb", 2, 4)}


def _write(root, files):
    for path, body in files.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_text(body)


QUAY = "import { crane } from './crane'\n\nexport function quay() {\n  crane()\n  lost()\n}\n"
CRANE = "export function crane() {\n  return 1\n}\n"
TREE = {
    "src/quay.ts": QUAY, "src/crane.ts": CRANE, "src/crane.test.ts": "import { crane } from './crane'\ncrane()\n", "README.md": "# Port\n\nSee `src/quay.ts` and `crane`.\n",
    "skipped/x.ts": "export function x() {\n}\n", "dist/y.ts": "export function y() {\n}\n", "z.generated.ts": "export function z() {\n}\n", ".gitignore": "skipped/\n*.generated.ts\n",
}


def _pairs(nodes, edges):
    names = nodes.select("id", "name")
    both = edges.join(names.withColumnsRenamed({"id": "src", "name": "a"}), "src").join(names.withColumnsRenamed({"id": "dst", "name": "b"}), "dst")
    return {(r.a, r.b, r.kind) for r in both.collect()}


def test_build_publish_and_rebuild(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    _write(root, TREE)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(3):
        for name in ("quay", "crane"):
            (root / f"src/{name}.ts").write_text((root / f"src/{name}.ts").read_text() + f"// {i}\n")
        git("add", "-A")
        git("commit", "-qm", f"feat(dock): step {i}")
    log = tmp_path / "log"
    assert gitlog.export_log(str(root), str(log)) and len(gitlog.head(str(root))) == 40
    commits = gitlog.read_log(spark, f"file://{log}")
    assert commits.count() == 3
    files = tree.scan(spark, str(root), tree.ignore_file(str(root)))
    assert sorted(r.path for r in files.collect()) == ["README.md", "src/crane.test.ts", "src/crane.ts", "src/quay.ts"]
    g = build.build(files, commits=commits)
    assert g.nodes.count() == g.nodes.select("id").distinct().count()
    kinds = {r.kind: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    assert kinds == {"file": 3, "symbol": 2, "doc": 1, "commit": 3, "feature": 1}
    got = _pairs(g.nodes, g.edges)
    code = {x for x in got if x[2] not in ("touched_by", "in_feature", "co_change")}
    assert code == {
        ("src/quay.ts", "src/crane.ts", "imports"), ("src/crane.test.ts", "src/crane.ts", "imports"), ("quay", "crane", "calls"), ("src/crane.test.ts", "crane", "calls"), ("src/quay.ts", "quay", "contains"), ("src/crane.ts", "crane", "contains"),
        ("src/crane.test.ts", "src/crane.ts", "tests"), ("src/crane.test.ts", "crane", "tests"), ("Port", "src/quay.ts", "mentions"), ("Port", "crane", "mentions"),
    }
    assert {x[:2] for x in got if x[2] == "co_change"} in ({("src/quay.ts", "src/crane.ts")}, {("src/crane.ts", "src/quay.ts")})
    assert {x[:2] for x in got if x[2] == "in_feature" and x[0].startswith("src")} == {("src/quay.ts", "dock"), ("src/crane.ts", "dock")}
    assert sum(x[2] == "touched_by" for x in got) == 7  # two files in three commits, the test in the first
    assert [(r.name, r.kind) for r in g.pending.collect()] == [("lost", "calls")]
    store = f"file://{tmp_path}/store"
    assert snapshot.current(spark, store) is None
    first = snapshot.publish(spark, store, {"nodes": g.nodes, "edges": g.edges})
    ids = {r.id for r in snapshot.table(spark, store, "nodes").collect()}
    again = build.build(tree.scan(spark, str(root), tree.ignore_rules("skipped/\n*.generated.ts\n")), commits=commits)
    assert {r.id for r in again.nodes.collect()} == ids  # an unchanged tree keeps its ids
    for k in range(3):
        assert snapshot.publish(spark, store, {"nodes": again.nodes.limit(1)}) != first and snapshot.current(spark, store)["number"] == k + 2
    assert len([d for d in os.listdir(tmp_path / "store") if d != "_pointers"]) == 2  # the current version and one before


def _same(a, b):
    for x, y in ((a.nodes, b.nodes), (a.edges, b.edges), (a.pending, b.pending)):
        columns = sorted(x.columns)
        assert sorted(map(str, x.select(columns).collect())) == sorted(map(str, y.select(columns).collect()))


@pytest.fixture(scope="module")
def port(spark, tmp_path_factory):
    """A tree and its store, and what brings the store up to date and compares it with a full build."""
    root, store = tmp_path_factory.mktemp("port"), f"file://{tmp_path_factory.mktemp('store')}/s"
    _write(root, TREE)
    rules = tree.ignore_file(str(root))
    sync.full(spark, store, tree.scan(spark, str(root), rules))

    def up(files, gone=(), compare=False):
        _write(root, files)
        for path in gone:
            os.remove(root / path)
        out = sync.sync(spark, str(root), store, rules)
        if compare:
            _same(build.Graph(*[snapshot.table(spark, store, t) for t in ("nodes", "edges", "pending_refs")]), build.build(tree.scan(spark, str(root), rules)))
        return out, {(r.name, r.change) for r in out.symbols.collect()} if out.symbols is not None else set(), [r.asDict() for r in out.findings.collect()] if out.findings is not None else []

    return up


def test_sync_without_changes_reads_nothing(spark, port):
    out, _, _ = port({})
    assert out.counts == {"listed": 4, "read": 0, "indexed": 0, "deleted": 0} and out.version is None


def test_sync_adds_a_symbol(spark, port):
    out, symbols, findings = port({"src/crane.ts": CRANE + "\nexport function winch() {\n  return 7\n}\n"})
    assert out.counts["indexed"] == 1 and symbols == {("winch", "added")} and findings == []


def test_sync_of_a_touched_file_loses_no_caller(spark, port):
    """Lines move and a caller within the file stays: nothing dangles."""
    out, symbols, findings = port({"src/crane.ts": "// above\n" + CRANE + "\nexport function winch() {\n  return crane()\n}\n"})
    assert symbols == set() and findings == []


def test_sync_of_a_renamed_symbol(spark, port):
    _, symbols, findings = port({"src/crane.ts": CRANE.replace("crane", "hoist") + "\nexport function winch() {\n  return hoist()\n}\n"})
    assert symbols == {("crane", "removed"), ("hoist", "added")}
    assert {f["file_path"] for f in findings if f["kind"] == "stale_caller"} >= {"src/quay.ts"}
    assert any(f["kind"] == "dangling_reference" for f in findings)


def test_sync_resolves_pending_references_and_deletes_files(spark, port):
    _, symbols, _ = port({"src/lost.ts": "export function lost() {\n}\n", "src/crane.ts": CRANE}, compare=True)
    assert ("lost", "added") in symbols
    out, symbols, findings = port({}, ["src/crane.ts"], compare=True)
    assert out.counts["deleted"] == 1 and symbols == {("crane", "removed")} and any(f["kind"] == "stale_caller" for f in findings)


def test_change_feed_keeps_the_graph(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    rows = [("src/quay.ts", QUAY), ("src/crane.ts", CRANE)]
    files = tree.kept(spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size long, content string")).withColumn("language", F.lit("typescript")).withColumn("hash", F.sha2("content", 256)).withColumn("mtime", F.lit(0).cast("long"))
    sync.full(spark, store, files)
    feed = spark.createDataFrame([("src/crane.ts", 1, "nothing"), ("src/crane.ts", 3, CRANE.replace("crane", "hoist")), ("src/quay.ts", 2, None)], "path string, seq long, content string")
    feed.write.parquet(str(tmp_path / "feed"))
    changes.apply_changes(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed")), sync.applied(spark, store), str(tmp_path / "cp")).awaitTermination(120)
    nodes = snapshot.table(spark, store, "nodes")
    assert {r.name for r in nodes.collect()} == {"src/crane.ts", "hoist"}


def test_ignore_rules(spark):
    rules = tree.ignore_rules("*.log\n!keep.log\n/build\ndocs/**/tmp\nsub/\n# note\n")
    paths = ["a.log", "x/keep.log", "build/a", "x/build/a", "docs/a/b/tmp", "x/sub/f", "sub"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", tree.ignored(F.col("path"), rules).alias("i"))
    assert {r.path: r.i for r in rows.collect()} == {"a.log": True, "x/keep.log": False, "build/a": True, "x/build/a": False, "docs/a/b/tmp": True, "x/sub/f": True, "sub": False}


def test_classified(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {r.path: r.state for r in sync.classified(a, b).collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}


def test_change_feed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y"), ("a", 2, "w")], "path string, seq long, body string")
    rows.write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "feed"))
    seen = []
    changes.apply_changes(feed, lambda batch, n: seen.extend((r.path, r.seq, r.body) for r in batch.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == [("a", 3, "z"), ("b", 2, "y")]
    assert {(r.path, r.row.body, r.writes) for r in changes.latest_states(rows).collect()} == {("a", "z", 3), ("b", "y", 1)}
