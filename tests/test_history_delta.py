"""Counts of a history kept by deltas, and tested files by directories, against counting and pairing everything."""

import os
import random
import subprocess

from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.functions import text
from loomgraph.operators import history, resolve
from loomgraph.plans import build, snapshot


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_by_deltas(spark):
    rng = random.Random(3)
    commits = [[(c, f"f{rng.randrange(9)}") for _ in range(rng.choice([1, 2, 3, 5]))] + ([(c, f"w{i}") for i in range(9)] if c % 7 == 0 else []) for c in range(40)]
    table = lambda some: spark.createDataFrame([r for c in some for r in c], "commit long, file string")
    counts = history.change_counts(table(commits[:20]), 6)
    for first, last in ((0, 25), (10, 30), (12, 40), (40, 40)):
        before = getattr(test_counts_by_deltas, "at", (0, 20))
        test_counts_by_deltas.at = (first, last)
        come, gone = commits[max(before[1], first) : last], commits[before[0] : first]
        counts = tuple(spark.createDataFrame(d.collect(), d.schema) for d in history.adjusted_counts(counts, table(come), table(gone), 6))
        for kept, anew in zip(counts, history.change_counts(table(commits[first:last]), 6)):
            assert rows(kept) == rows(anew)
        assert rows(history.together(counts, 2, 0.1)) == rows(history.mine_cochanges(table(commits[first:last]), 6, 2, 0.1))


def git(root, *args):
    env = os.environ | {f"GIT_{who}_{what}": value for who in ("AUTHOR", "COMMITTER") for what, value in (("NAME", "a"), ("EMAIL", "a@b"))}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


def commit(root, n, **files):
    for name, body in files.items():
        (root / f"{name}.py").write_text(body)
    git(root, "add", "-A")
    git(root, "-c", "commit.gpgsign=false", "commit", "-q", "-m", f"feat(core): {n}", "--date", f"2024-01-{n:02}T00:00:00")


def test_pulls_equal_the_whole_window(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "tree", f"file://{tmp_path}/store"
    root.mkdir()
    git(root, "init", "-q")
    for n in range(1, 5):
        commit(root, n, a=f"def a():\n    return {n}\n", b=f"def b():\n    return {n}\n")
    cli.index(spark, str(root), store, most=5)
    asked, plain = [], cli.gitlog.export_log
    monkeypatch.setattr(cli.gitlog, "export_log", lambda repo, to, most, only=None: asked.append(only) or plain(repo, to, most, only))
    for n in range(5, 8):
        commit(root, n, a=f"def a():\n    return {n}\n", c=f"def c():\n    return {n}\n")
    cli.update(spark, str(root), store, most=5)
    git(root, "reset", "-q", "--hard", "HEAD~1")  # a rewritten history: one commit goes, one comes back
    commit(root, 8, b="def b():\n    return 8\n")
    cli.update(spark, str(root), store, most=5)
    assert [len(only) for only in asked] == [3, 1]  # only new commits were read
    log = cli._commits(spark, str(root), 5)
    assert rows(snapshot.table(spark, store, "commits").select("sha")) == rows(log.select("sha"))
    for name, want in zip(build.COUNTS, history.change_counts(history.changed_files(log))):
        assert rows(snapshot.table(spark, store, name).select(want.columns)) == rows(want)
    cli.index(spark, str(root), f"{store}-anew", most=5)
    for name in ("nodes", "edges"):
        one, two = snapshot.table(spark, store, name), snapshot.table(spark, f"{store}-anew", name)
        assert rows(one) == rows(two.select(one.columns))


def test_tested_files_without_pairs(spark):
    rng = random.Random(8)
    folder = lambda: "".join(f"{rng.choice('ab')}/" for _ in range(rng.randrange(5)))
    paths = sorted({("/" if rng.random() < 0.1 else "") + folder() + rng.choice(["x.ts", "x.test.ts", "y.ts", "y.spec.ts", "index.ts", "index.test.ts", "only.test.ts"]) for _ in range(400)})
    files = spark.createDataFrame([(p, rng.randrange(50)) for p in paths], "path string, ord long")
    tests = files.where(text.is_test_for_index("path")).select(F.col("path").alias("test_path"), text.tested_stem("path").alias("stem"), text.directory("path").alias("tdir")).collect()
    known = files.select("path", "ord", text.stem("path").alias("stem"), text.directory("path").alias("dir")).collect()
    want = {}
    for t in tests:
        shared = lambda k: next((i for i, (x, y) in enumerate(zip(k.dir.split("/"), t.tdir.split("/"))) if x != y), min(len(k.dir.split("/")), len(t.tdir.split("/"))))  # noqa: E731,B023
        found = sorted((k.dir != t.tdir, -shared(k), k.ord, k.path) for k in known if k.stem == t.stem)
        if found:
            want[t.test_path] = found[0][3]
    assert want and {r.test_path: r.path for r in resolve.tested_files(files).collect()} == want
