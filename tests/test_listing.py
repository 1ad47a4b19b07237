"""Listings that prune while they go down, and git's rules, against git itself."""

import os
import random
import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.sources import tree

RULES = """# comment
ignored/
*.gen.ts
!keep.gen.ts
/top.ts
[!a]x.ts
d[0-9]/*.py
docs/**/deep.md
ignored/again.ts
!ignored/again.ts
**/tmp
a?.go
!d1/
"""


def make(root, paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x = 1\n" + p.encode())


def git_kept(root, paths):
    subprocess.run(["git", "-C", str(root), "init", "-q"], check=True, capture_output=True)
    out = subprocess.run(["git", "-C", str(root), "ls-files", "-o", "--exclude-per-directory=.gitignore"], check=True, capture_output=True, text=True)
    return set(out.stdout.split("\n")) & set(paths)


def test_rules_equal_git(spark, tmp_path):
    rng = random.Random(2)
    names = ["a.ts", "ax.ts", "bx.ts", "x.gen.ts", "keep.gen.ts", "top.ts", "m.py", "deep.md", "ab.go", "again.ts"]
    folders = ["", "ignored/", "sub/", "sub/ignored/", "d1/", "d2/e/", "docs/", "docs/p/q/", "tmp/", "sub/tmp/", "a b/"]
    paths = sorted({rng.choice(folders) + rng.choice(names) for _ in range(120)})
    make(tmp_path, paths)
    (tmp_path / ".gitignore").write_text(RULES)
    want = git_kept(tmp_path, paths)
    assert 0 < len(want) < len(paths)
    rules = tree.ignore_file(str(tmp_path))
    assert {r.path for r in tree.listing(spark, str(tmp_path), rules).collect()} == want
    feed = spark.createDataFrame([(p, 1) for p in paths], "path string, size long")
    assert {r.path for r in tree.kept(feed, rules).collect()} == want


def test_pruned_directories_are_not_entered(spark, tmp_path, monkeypatch):
    make(tmp_path, ["a.ts", "src/b.ts", "src/c/d/e/f.py", "node_modules/m/i.js", "skip/x.ts", "src/node_modules/y.ts"])
    os.symlink(tmp_path, tmp_path / "src" / "circle")
    entered = []
    opened = tree._opened

    class Watched:
        type_name = "local"

        def __init__(self, system):
            self.system = system

        def get_file_info(self, selector):
            entered.append(selector.base_dir)
            return self.system.get_file_info(selector)

    monkeypatch.setattr(tree, "_opened", lambda base: (Watched(opened(base)[0]), opened(base)[1]))
    out = pd.concat(tree._descended(str(tmp_path), tree.ignore_rules("skip/"), 3)(iter([pd.DataFrame({"path": [""]})])))
    assert {os.path.relpath(e, tmp_path) for e in entered} == {".", "src", "src/c"}
    assert set(out[out["size"].isna()]["path"]) == {"src/c/d"}  # handed on
    monkeypatch.undo()
    monkeypatch.setattr(tree, "DESCENT", 1)
    rows = tree.scan(spark, f"file://{tmp_path}", tree.ignore_rules("skip/")).collect()
    assert {r.path for r in rows} == {"a.ts", "src/b.ts", "src/c/d/e/f.py"}
    assert all(r.content == f"x = 1\n{r.path}" and r.size == len(r.content) for r in rows)


def test_scan_edges(spark, tmp_path):
    (tmp_path / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (tmp_path / "none.py").write_bytes(b"")
    (tmp_path / "odd [1] {2} %20*.py").write_bytes("é".encode())
    rows = {r.path: r for r in tree.scan(spark, str(tmp_path)).collect()}
    assert rows["none.py"].content == "" and rows["odd [1] {2} %20*.py"].content == "é" and "�" in rows["bad.py"].content
    assert all(len(r.hash) == 64 and r.mtime > 10**12 for r in rows.values())
    listed = tree.listing(spark, str(tmp_path))
    assert tree.contents(spark, str(tmp_path), listed.where(F.lit(False))).count() == 0
    os.unlink(tmp_path / "bad.py")
    assert tree.contents(spark, str(tmp_path), listed).count() == 2  # gone meanwhile
    with pytest.raises(Exception, match="nowhere"):
        tree.listing(spark, f"{tmp_path}/nowhere").count()
