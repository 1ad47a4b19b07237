import math
import sqlite3

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import text
from loomgraph.operators import audit, context, docs, graph, history, impact, locate, rank, resolve, search, traverse


def node(id, name, path=None, kind="symbol", subkind=None, qname=None, exported=False, doc=None, line=1, repo=1):
    return Row(id=id, repo_id=repo, kind=kind, subkind=subkind, name=name, qualified_name=qname, file_path=path, start_line=line, end_line=line + 3, language="typescript", signature=None, doc=doc, exported=exported, meta=None, ord=id)


def edge(src, dst, kind="calls", weight=1.0):
    return Row(id=src * 1000 + dst, repo_id=1, src=src, dst=dst, kind=kind, weight=weight, meta=None)


@pytest.fixture(scope="module")
def diamond(spark):
    """top calls left and right, both call bottom; each in a file of its own."""
    names = ["top", "left", "right", "bottom"]
    nodes = [node(i + 1, n, f"{p}.ts") for i, (n, p) in enumerate(zip(names, "abcd"))] + [node(10 + i, f"{p}.ts", f"{p}.ts", "file") for i, p in enumerate("abcd")]
    edges = [edge(1, 2), edge(1, 3), edge(2, 4), edge(3, 4)] + [edge(10 + i, i + 1, "contains") for i in range(4)]
    return spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(edges, schema.EDGES)


def roots(spark, *ids, name="root_id"):
    return spark.createDataFrame([(i,) for i in ids], f"{name} long")


def test_callees_and_callers(spark, diamond):
    nodes, edges = diamond
    down = {r.symbol: r for r in traverse.callees(edges, nodes, roots(spark, 1), 2).collect()}
    assert {k: r.depth for k, r in down.items()} == {"left": 1, "right": 1, "bottom": 2}
    assert down["bottom"].via_path == ["top", "left", "bottom"]
    up = {r.symbol: r for r in traverse.callers(edges, nodes, roots(spark, 4), 2).collect()}
    assert {k: r.depth for k, r in up.items()} == {"left": 1, "right": 1, "top": 2}
    assert up["top"].via_path == ["top", "left", "bottom"]
    assert traverse.callers(edges, nodes, roots(spark, 4), 2, limit=2).count() == 2
    assert traverse.callers(edges, nodes, roots(spark, 99), 2).count() == 0


def test_impact_of_diamond(spark, diamond):
    nodes, edges = diamond
    found = {r.file_path: r for r in impact.impact(nodes, edges, roots(spark, 4, name="id"), 3).collect()}
    assert set(found) == {"a.ts", "b.ts", "c.ts"}
    assert found["b.ts"].direct and found["b.ts"].max_score == 1.0 and found["a.ts"].max_score == 0.5
    assert {r.file_path for r in impact.impact(nodes, edges, roots(spark, 4, name="id"), 1).collect()} == {"b.ts", "c.ts"}


def test_impact_seeds_containers_and_cochanges(spark):
    nodes = [node(1, "Box", "box.go", subkind="struct"), node(2, "Serve", "box.go", subkind="method"), node(3, "main", "main.go", subkind="function"), node(10, "box.go", "box.go", "file"), node(11, "main.go", "main.go", "file"), node(12, "conf.go", "conf.go", "file")]
    edges = [edge(1, 2, "contains"), edge(3, 2), edge(11, 12, "co_change", 0.8)]
    n, e = spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame(edges, schema.EDGES)
    files = impact.impact(n, e, roots(spark, 1, name="id"))
    assert [r.file_path for r in files.collect()] == ["main.go"]
    assert [(r.with_file, r.file_path, r.weight) for r in impact.cochanges_of(files, n, e).collect()] == [("main.go", "conf.go", 0.8)]


def test_rank_scores_and_tiers(spark):
    rows = spark.createDataFrame([("src/core/a.ts", 1, True), ("lib/MonotonicClock.ts", 1, False), ("src/core/clock.test.ts", 10, True), ("x/b.ts", 3, False), ("x/c.ts", 1, False), ("y/Clock.ts", 9, True)], "file_path string, refs long, direct boolean")
    out = {r.file_path: (r.score, r.tier) for r in rank.rank(rows, F.lit("src/core/Clock.ts"), F.lit("Clock2")).collect()}
    assert out == {"src/core/a.ts": (13, "direct"), "lib/MonotonicClock.ts": (11, "strong"), "src/core/clock.test.ts": (10 + 8 + 4 + 10 - 100000, "test"), "x/b.ts": (3, "strong"), "x/c.ts": (1, "weak")}


def test_shortest_paths(spark, diamond):
    nodes, edges = diamond
    pairs = spark.createDataFrame([(1, 1, 4), (2, 2, 3), (3, 1, 99), (4, 10, 13)], "pair_id int, a long, b long")
    found = {r.pair_id: (r.hops, r.path) for r in traverse.shortest_paths(edges, pairs, 4).collect()}
    assert found == {1: (2, [1, 2, 4]), 2: (2, [2, 1, 3]), 4: (4, [10, 1, 2, 4, 13])}


def test_neighbors_are_a_bag(spark, diamond):
    nodes, edges = diamond
    both = graph.neighbors(edges, nodes, roots(spark, 2, name="id"))
    assert sorted((r.direction, r.id) for r in both.collect()) == [("in", 1), ("in", 12 - 1), ("out", 4)]


def test_upserts_and_deletes(spark, diamond):
    rows = spark.createDataFrame([(1, 2, "calls", 0.5, 1), (1, 2, "calls", 0.2, 2), (1, 3, "calls", 1.0, 1)], "src long, dst long, kind string, weight double, seq long")
    assert sorted((r.dst, r.weight) for r in graph.upsert_edges(rows).collect()) == [(2, 0.2), (3, 1.0)]
    nodes, edges = diamond
    pending = spark.createDataFrame([(1, 2, "x", "calls"), (1, 3, "y", "calls")], schema.PENDING)
    n, e, p = graph.delete_nodes(nodes, edges, pending, roots(spark, 2, 11, name="id"))
    assert n.count() == 6 and sorted((r.src, r.dst) for r in e.collect()) == [(1, 3), (3, 4), (10, 1), (12, 3), (13, 4)]
    assert [r.src_node for r in p.collect()] == [3]


def test_bm25_equals_sqlite_fts5(spark):
    words = ["getUser", "setUserName", "HTTPServer2Run", "parse_config", "user", "config loader", "café bar", "x"]
    nodes = [node(i, w, f"f{i}.ts", qname=f"Mod.{w}", doc=f"The {w} of user {'user ' * (i % 3)}") for i, w in enumerate(words)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(name, qualified_name, tokens, doc, tokenize=\"unicode61 tokenchars '_$'\")")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    frame = spark.createDataFrame(nodes, schema.NODES)
    for r in search.indexed(frame).collect():
        db.execute("insert into f(rowid, name, qualified_name, tokens, doc) values (?,?,?,?,?)", (r.node_id, r.name, r.qualified_name or "", r.tokens, r.doc or ""))
    for asked in (["user"], ["conf", "get"], ["cafe", "http"], ["zzz"]):
        match = " OR ".join(f'"{t}"*' for t in asked)
        want = {i: -s for i, s in db.execute("select rowid, bm25(f, 10, 5, 8, 1) from f where f match ?", (match,))}
        q = spark.createDataFrame([(0, asked)], "query_id int, terms array<string>")
        got = {r.node_id: r.score for r in search.bm25(search.indexed(frame), q).collect()}
        assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_resolve_takes_the_first_tier(spark):
    nodes = spark.createDataFrame([node(1, "Foo", "src/foo.ts"), node(2, "Foo", "lib/foo.ts", exported=True), node(3, "foo.ts", "src/foo.ts", "file"), node(4, "fooBar", "src/x.ts")], schema.NODES)
    asked = spark.createDataFrame([(0, " Foo "), (1, "SRC/foo.ts"), (2, "bar"), (3, "  "), (4, "nothing")], "query_id int, name string")
    got = sorted((r.query_id, r.tier, r.position, r.id) for r in locate.resolve(nodes, asked).collect())
    assert got == [(0, 1, 1, 2), (0, 1, 2, 1), (1, 2, 1, 3), (2, 3, 1, 4)]


def test_cochanges(spark):
    def mined(commits):
        rows = [(i, f) for i, files in enumerate(commits) for f in files]
        return [(r.file_a, r.file_b, r.support, r.confidence) for r in history.mine_cochanges(spark.createDataFrame(rows, "commit int, file string")).collect()]

    ab = ["a.ts", "b.ts"]
    assert mined([ab] * 3) == [("a.ts", "b.ts", 3, 1.0)]
    assert mined([ab] * 2) == []
    assert mined([ab] * 3 + [["a.ts"]] * 5 + [["b.ts"]] * 5) == []
    assert mined([ab] * 3 + [[f"f{i}" for i in range(35)]] * 3) == [("a.ts", "b.ts", 3, 1.0)]
    files = spark.createDataFrame([(2, "a.ts"), (1, "b.ts")], "id long, file_path string")
    pairs = spark.createDataFrame([("a.ts", "b.ts", 3, 0.75), ("a.ts", "gone.ts", 3, 0.5)], "file_a string, file_b string, support long, confidence double")
    assert [(r.src, r.dst, r.weight, r.meta) for r in history.apply_cochanges(pairs, files).collect()] == [(1, 2, 0.75, '{"support":3}')]


def test_log_records(spark):
    value = "abc1234567\x1fAda\x1fa@x\x1f1700000000\x1ffeat(auth): x\n3\t1\tsrc/{old => new}/a.ts\n-\t-\tb.png => c.png\nbroken\n"
    rows = spark.createDataFrame([(value,), ("no header\n",), ("s\x1fa\x1fb\x1fnot a time\x1fx",)], "value string")
    (r,) = history.parse_log(rows).collect()
    assert (r.sha, r.ts, r.subject) == ("abc1234567", 1700000000, "feat(auth): x")
    assert [(f.path, f.insertions, f.deletions) for f in r.files] == [("src/new/a.ts", 3, 1), ("c.png", 0, 0)]


def test_features(spark):
    subjects = ["feat(auth): a", "feat(auth): b", "Feat(auth): c", "fix(auth): d", "chore: e", "feat(once): f"]
    commits = spark.createDataFrame([(str(i), s, i) for i, s in enumerate(subjects)], "sha string, subject string, ord long")
    touches = spark.createDataFrame([(1, "0"), (1, "1"), (2, "0"), (2, "3"), (3, "0")], "file_id long, sha string")
    found, members, files = history.features(commits, touches)
    (f,) = found.collect()
    assert (f.scope, f.commits, f.types) == ("auth", 4, ["feat", "fix"]) and f.doc.startswith("feat(auth): a; ")
    assert members.count() == 4 and sorted((r.file_id, r.weight) for r in files.collect()) == [(1, 2), (2, 2)]


def test_mentions(spark):
    nodes = [node(i, "Many", f"m{i}.ts") for i in range(1, 5)] + [node(7, "Few", "few.ts"), node(8, "src/few.ts", "src/few.ts", "file")]
    rows = spark.createDataFrame([(100, "docs/a.md", "See `src/few.ts` and `Few`, `Many`, `None`; src/few.ts again")], "doc_id long, path string, body string")
    assert sorted((r.dst, r.how) for r in docs.mentions(rows, spark.createDataFrame(nodes, schema.NODES)).collect()) == [(7, "symbol"), (8, "file")]


SYM = "node_id long, name string, file_path string, subkind string, qualified_name string, package string, ord long"
REF = "ref_id long, name string, from_file string, language string, package string"


@pytest.mark.parametrize(
    ("symbols", "ref", "imported", "want"),
    [
        ([(1, "h", "a.ts"), (2, "h", "b.ts")], ("h", "a.ts", "typescript"), [], 1),
        ([(2, "h", "b.ts")], ("h", "a.ts", "typescript"), ["b.ts"], 2),
        ([(1, "h", "b.ts"), (2, "h", "c.ts")], ("h", "a.ts", "typescript"), ["c.ts"], 2),
        ([(1, "W", "src/ui/w.ts"), (2, "W", "other/w.ts")], ("W", "src/ui/e.ts", "typescript"), [], 1),
        ([(1, "W", "a/w.ts"), (2, "W", "b/w.ts")], ("W", "c/e.ts", "typescript"), [], None),
        ([(1, "b", "in/n/n.go"), (2, "b", "in/d/d.go")], ("b", "in/n/s.go", "go"), [], 1),
        ([(1, "Foo", "b/Foo.java", "class"), (2, "Foo", "b/Foo.java", "method")], ("Foo", "a/A.java", "java"), ["b/Foo.java"], 1),
        ([(1, "F", "x/F.java", "class", "F"), (2, "F", "y/O.java", "class", "O.F")], ("F", "a/A.java", "java"), ["x/F.java", "y/O.java"], 1),
        ([(1, "P", "p/P.java", "class", "P", "com.p"), (2, "P", "q/P.java", "class", "P", "com.q")], ("P", "a/A.java", "java", "com.q"), [], 2),
        ([(1, "h", "b.ts"), (2, "h", "c.ts"), (3, "h", "x/d.ts")], ("h", "x/a.ts", "typescript"), ["b.ts", "c.ts"], None),
    ],
)
def test_reference_resolution(spark, symbols, ref, imported, want):
    pad = lambda row, n: (*row, *[None] * (n - len(row)))
    s = spark.createDataFrame([(*pad(x, 6), x[0]) for x in symbols], SYM)
    r = spark.createDataFrame([(0, *pad(ref, 4))], REF)
    i = spark.createDataFrame([(ref[1], x) for x in imported], "from_file string, to_file string")
    got = resolve.references(r, s, i).collect()
    assert [x.target for x in got] == ([] if want is None else [want])


def test_stored_symbols_only_for_unseen_names(spark):
    none = spark.createDataFrame([], SYM)
    refs = spark.createDataFrame([(0, "G", "a.ts", "typescript", None), (1, "W", "src/ui/e.ts", "typescript", None)], REF)
    stored = spark.createDataFrame([(5, "G", "z.ts"), (6, "W", "src/ui/w.ts"), (7, "W", "o/w.ts")], "node_id long, name string, file_path string")
    got = resolve.references(refs, none, spark.createDataFrame([], "from_file string, to_file string"), stored)
    assert sorted((r.ref_id, r.tier, r.target) for r in got.collect()) == [(0, 4, 5), (1, 4, 6)]


def test_relative_imports(spark):
    known = ["src/foo.ts", "src/bar/index.ts", "src/baz.ts", "pkg/mod.py", "pkg/__init__.py", "src/base.ts"]
    files = spark.createDataFrame([(k,) for k in known], "path string")
    asked = [("src/entry.ts", "typescript", "./foo"), ("src/entry.ts", "typescript", "./bar"), ("src/nested/e.ts", "typescript", "../baz"), ("pkg/mod.py", "python", "./__init__"), ("src/entry.ts", "typescript", "react"), ("src/entry.ts", "typescript", "./missing"), ("src/entry.ts", "typescript", "./base.js"), ("src/entry.ts", "typescript", "/src/foo.ts")]
    got = {(r.from_path, r.raw): r.to_path for r in resolve.relative_imports(spark.createDataFrame(asked, "from_path string, language string, raw string"), files).collect()}
    assert got == {("src/entry.ts", "./foo"): "src/foo.ts", ("src/entry.ts", "./bar"): "src/bar/index.ts", ("src/nested/e.ts", "../baz"): "src/baz.ts", ("pkg/mod.py", "./__init__"): "pkg/__init__.py", ("src/entry.ts", "./base.js"): "src/base.ts", ("src/entry.ts", "/src/foo.ts"): "src/foo.ts"}


def test_tested_files(spark):
    paths = ["src/foo.ts", "src/foo.test.ts", "a/Bar.java", "t/BarTest.java", "x/y/z.ts", "q/z.ts", "x/tests/z.test.ts", "lone.test.ts"]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord long")
    assert {r.test_path: r.path for r in resolve.tested_files(rows).collect()} == {"src/foo.test.ts": "src/foo.ts", "t/BarTest.java": "a/Bar.java", "x/tests/z.test.ts": "x/y/z.ts"}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        text.split_identifier(F.lit("HTTPServer2Run_a_getX")).alias("a"), text.search_terms(F.lit("getUser foo-bar")).alias("b"), text.language(F.lit("x/Y.TSX")).alias("c"), text.language(F.lit(".ts")).alias("d"),
        text.estimate_tokens(F.lit("a😀bcd")).alias("e"), text.anchor_word(F.lit("Http-Server2")).alias("f"), text.common_prefix(F.lit("a/b/c"), F.lit("a/b/d/e")).alias("g"), text.common_prefix(F.lit("a"), F.lit("a")).alias("h"),
        text.stem(F.lit("a/b.test.ts")).alias("i"), text.directory(F.lit("a.ts")).alias("j"), text.commit_scope(F.lit("feat: x")).alias("k"), text.doc_title(F.lit("x\n# Hi\n"), F.lit("a.md")).alias("m"),
    ).first()
    assert row.a == ["http", "server2", "run", "get"] and row.b == ["getuser", "foo", "bar", "get", "user"]
    assert (row.c, row.d, row.e, row.f, row.g, row.h, row.i, row.j, row.k, row.m) == ("tsx", None, 2, "httpserver", 2, 1, "b.test", "", "", "Hi")


@pytest.mark.parametrize("budget", [-5, 0, 1, 3, 10, 40, 100, 6000])
def test_context_pack_keeps_its_budget(spark, diamond, budget):
    nodes, edges = diamond
    pack = context.context_pack(nodes, edges, "bottom", budget)
    assert pack.markdown and (budget <= 0 or pack.tokens <= budget)
    assert all(f"#### {f}" in pack.markdown for f in pack.core_files)
    if budget == 6000:
        assert "d.ts" in pack.core_files


def test_audit(spark):
    before = spark.createDataFrame([("a.ts", "x"), ("a.ts", "y")], "path string, name string")
    after = spark.createDataFrame([("a.ts", "y"), ("a.ts", "z")], "path string, name string")
    diff = audit.symbol_diff(before, after)
    assert sorted((r.name, r.change) for r in diff.collect()) == [("x", "removed"), ("z", "added")]
    callers = spark.createDataFrame([("a.ts", f"c{i:02}.ts") for i in range(10)], "path string, caller_file string")
    counts = spark.createDataFrame([("a.ts", 2)], "path string, n long")
    lost = spark.createDataFrame([("a.ts", "./nope")], "path string, name string")
    found = audit.findings(diff, callers, counts, lost).collect()
    assert len(found) == 9 and [r.severity for r in found if r.message.startswith("(+4")] == ["high"]


def test_federation_keeps_repositories_apart(spark):
    from loomgraph.operators.federation import merged, within_repos

    a = spark.createDataFrame([node(1, "RootWidget", "a.ts", repo=0), node(2, "useRootWidget", "b.ts", repo=0)], schema.NODES)
    b = spark.createDataFrame([node(3, "SnorkelGadget", "c.ts", repo=0), node(4, "RootWidget", "d.ts", repo=0)], schema.NODES)
    both = merged([(1, a), (2, b)])
    q = search.as_queries(spark, ["RootWidget"])
    assert {r.repo_id for r in search.federated_search(both, q).collect()} == {1, 2}
    edges = spark.createDataFrame([edge(2, 1), edge(2, 4)], schema.EDGES)
    assert [(r.src, r.dst) for r in within_repos(edges, both).collect()] == [(2, 1)]


def test_explore_shows_paths_and_sources(spark, diamond):
    nodes, edges = diamond
    contents = spark.createDataFrame([("a.ts", "one\ntwo\nthree\nfour\nfive"), ("d.ts", "x\ny")], "path string, content string")
    found = spark.createDataFrame([(0, 0, 1), (0, 1, 4), (0, 2, 99), (1, 0, 2)], "set_id int, position int, id long")
    paths, symbols = traverse.explore(nodes, edges, found, contents, most=2)
    assert sorted((r.set_id, r.position, r.step, r.id, r.edge_kind) for r in paths.collect()) == [(0, 0, 0, 1, None), (0, 0, 1, 2, "calls"), (0, 0, 2, 4, "calls")]
    got = [(r.set_id, r.name, r.source, r.truncated) for r in symbols.collect()]
    assert got == [(0, "top", "one\ntwo", True), (0, "left", None, False), (0, "bottom", "x\ny", False), (1, "left", None, False)]


def test_workspace_skips_what_it_cannot_read(spark, tmp_path):
    from loomgraph.operators import federation
    from loomgraph.plans import snapshot

    rows = spark.createDataFrame([node(1, "Hull", "a.ts"), node(2, "Keel", "b.ts")], schema.NODES)
    links = spark.createDataFrame([edge(1, 2)], schema.EDGES)
    for name in ("one", "two", "broken"):
        snapshot.publish(spark, f"file://{tmp_path}/{name}", {"nodes": rows, "edges": links})
    for path in (tmp_path / "broken").rglob("*.parquet"):
        path.write_bytes(b"no parquet")
    notes = []
    nodes, edges, names = federation.opened(spark, [(n, f"file://{tmp_path}/{n}") for n in ("one", "gone", "broken", "two")], notes.append)
    assert names == {1: "one", 4: "two"} and [n.split(":")[0] for n in notes] == ["gone", "broken"]
    assert nodes.count() == 4 == nodes.select("id").distinct().count() and federation.within_repos(edges, nodes).count() == 2


def test_config_merges_field_by_field(tmp_path):
    from loomgraph import config

    assert config.load(str(tmp_path)) == config.Config()
    (tmp_path / config.FILE).write_text('{"max_commits": 7, "ignore": ["a/"], "edit_guard": {"depth": 3}, "unknown": 1}')
    own = config.load(str(tmp_path))
    assert (own.max_commits, own.ignore, own.edit_guard.depth, own.edit_guard.top_files, own.context_pack_tokens) == (7, ("a/",), 3, 5, 6000)
    (tmp_path / config.FILE).write_text("{")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))
