"""Packs of many tasks in one job."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import context, packs

NODE = (
    "id long, repo_id long, kind string, subkind string, name string, qualified_name string, file_path string, start_line int, end_line int, "
    "language string, signature string, doc string, exported boolean, meta string, ord long"
)


def node(i, kind, name, path=None, lines=(None, None), doc=None):
    return (i, 0, kind, None, name, None, path, *lines, "typescript", None, doc, True, None, i)


@pytest.fixture(scope="module")
def shop(spark):
    """30 files of 4 symbols; each file's first calls the next file's first. File 1 has commits, a doc and a feature; its test names it too."""
    nodes, edges = [], []
    for f in range(30):
        path = f"src/part{f}.ts"
        nodes.append(node(f, "file", f"part{f}.ts", path))
        for k in range(4):
            nodes.append(node(1000 + 10 * f + k, "symbol", f"makePart{f}Step{k}", path, (1 + 10 * k, 9 + 10 * k)))
            edges.append((f, 1000 + 10 * f + k, "contains"))
        edges.append((1000 + 10 * f, 1000 + 10 * ((f + 1) % 30), "calls"))
    nodes.append(node(90, "file", "part1.test.ts", "src/part1.test.ts"))
    nodes.append(node(1900, "symbol", "makePart1Step0Test", "src/part1.test.ts", (1, 5)))
    edges += [(90, 1900, "contains"), (1900, 1010, "calls")]
    for c in range(8):
        nodes.append(node(2000 + c, "commit", f"{c}abcdef0123", doc=f"feat(part): change {c}"))
        edges.append((1, 2000 + c, "touched_by"))
    nodes += [node(3000, "doc", "Guide", "docs/guide.md"), node(3001, "feature", "part")]
    edges += [(3000, 1, "mentions"), (1, 3001, "in_feature")]
    contents = [(f"src/part{f}.ts", "\n".join(f"line {i} of part{f}" for i in range(1, 41))) for f in range(30)]
    return (
        spark.createDataFrame(nodes, NODE),
        spark.createDataFrame([(*e, 1.0) for e in edges], "src long, dst long, kind string, weight double"),
        spark.createDataFrame(contents, "path string, content string"),
    )


def test_a_thousand_tasks_keep_to_their_budgets(spark, shop):
    nodes, edges, contents = shop
    tasks = [(i, f"makePart{i % 30}Step{i % 4}", 1 + i * 2 % 900) for i in range(1000)]
    tasks += [(2000, None, 50), (2001, "", 50), (2002, "nothing of that name", 50), (2003, "makePart1Step0", 0), (2004, "makePart1Step0", None)]
    rows = packs.packs(nodes, edges, spark.createDataFrame(tasks, "task_id long, task string, budget int"), contents).collect()
    got = {r.task_id: r for r in rows}
    assert len(rows) == len(got) == 1005
    for i, task, budget in tasks:
        r = got[i]
        assert r.markdown and (r.tokens <= budget if budget else r.markdown == context.HEADER)
        assert r.tokens == context.tokens_of(r.markdown)
        assert len(r.core_files) <= context.CORE and all(f"#### {f}" in r.markdown for f in r.core_files)
    # Larger budgets of a task show no less.
    for i in range(60):
        same = sorted((r.tokens, -r.level) for t, r in got.items() if t < 1000 and t % 60 == i)
        assert [x[1] for x in same] == sorted(x[1] for x in same)
    assert {r.level for r in rows} >= {0, 2, 3}
    assert not got[2000].core_files and not got[2002].symbols


def test_a_pack_holds_what_belongs_to_it(spark, shop):
    nodes, edges, contents = shop
    tasks = spark.createDataFrame([(7, "makePart1Step0", 5000)], "task_id long, task string, budget int")
    (r,) = packs.packs(nodes, edges, tasks, contents).collect()
    assert r.level == 0 and r.core_files[0] == "src/part1.ts" and r.symbols[0] == "makePart1Step0"
    assert "```\nline 1 of part1\n" in r.markdown and "line 10 of part1" not in r.markdown
    assert r.markdown.count("feat(part): change") == context.COMMITS and "- 0abcdef feat(part): change 0 (src/part1.ts)" in r.markdown
    assert "- Guide (docs/guide.md) mentions src/part1.ts" in r.markdown and '- src/part1.ts is part of feature "part"' in r.markdown
    assert "#### src/part1.test.ts" not in r.markdown or r.markdown.index("src/part1.ts") < r.markdown.index("src/part1.test.ts")


def test_tasks_of_one_text_are_walked_once(spark, shop, monkeypatch):
    nodes, edges, _ = shop
    rows, write = {}, packs.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(packs, "written", counted)
    tasks = [(i, "makePart1Step0" if i % 2 else None, i * 10) for i in range(400)]
    got = {r.task_id: r for r in packs.packs(nodes, edges, spark.createDataFrame(tasks, "task_id long, task string, budget int")).collect()}
    assert len(got) == 400 and rows["seeds"] <= 2 * packs.SEEDS and rows["reached"] <= nodes.count()
    assert got[399].core_files and not got[398].core_files
    assert all(r.tokens <= i * 10 for i, r in got.items() if i) and got[0].markdown == context.HEADER
    assert len({r.markdown for i, r in got.items() if i % 2 and r.level == 0}) == 1


def test_lines_that_end_at_the_budget_are_cut_as_the_whole(spark):
    # Units before a line that is left out: below, at, and above the room of 10 tokens.
    sizes = [(i, first, rest) for i, (first, rest) in enumerate((a, b) for a in range(36, 45) for b in (1, 20))]
    lines = [(i, section, 0, 0, packs.ALWAYS, c * n) for i, first, rest in sizes for section, c, n in ((0, "x", first), (1, "y", rest), (4, "z", 9))]
    found = spark.createDataFrame(lines, "task_id long, section int, place int, sub int, drop int, line string")
    tasks = spark.createDataFrame([(i, i, 10) for i, _, _ in sizes], "task_id long, first long, budget int")
    got = {r.task_id: r.markdown for r in packs.fitted(found, tasks).collect()}
    assert got == {i: context.clamped("\n".join(["x" * first, "y" * rest, "z" * 9]), 10) for i, first, rest in sizes}


def test_cut_texts(spark):
    texts = ["", "short", "a" * 400, "line\n" * 100, "😀" * 300, "a" * 30 + "\n" + "b" * 400, "x" * 100 + "\n" + "😀" * 100]
    rows = [(i, t, b) for i, t in enumerate(texts) for b in (1, 2, 7, 20, 60)]
    out = spark.createDataFrame(rows, "i int, t string, b int").select("t", "b", text.clamped("t", F.col("b")).alias("c")).collect()
    for r in out:
        assert context.tokens_of(r.c) <= r.b and (r.c == r.t) == (context.tokens_of(r.t) <= r.b)
        if all(ord(c) < 0x10000 for c in r.t):
            assert r.c == context.clamped(r.t, r.b)
        assert "�" not in r.c and (not r.t or r.c)
