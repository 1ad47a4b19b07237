"""Git logs as text: one record per commit."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.history import parse_log

FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%s"


def export_log(repo: str, to: str, commits: int = 2000, only: list[str] | None = None) -> bool:
    """Writes the log of a repository, or only of these commits, to a file; False if there is none to write."""
    which = ["-n", str(commits)] if only is None else ["--no-walk=unsorted", "--stdin"]
    given = None if only is None else "\n".join(only).encode()
    with open(to, "wb") as f:
        done = subprocess.run(["git", "-C", repo, "log", "--no-merges", "--numstat", f"--pretty=format:{FORMAT}", *which], input=given, stdout=f, stderr=subprocess.DEVNULL, check=False)
    return done.returncode == 0


def window(repo: str, commits: int = 2000) -> list[str] | None:
    """The commits that a log of so many holds; None if there is no log."""
    done = subprocess.run(["git", "-C", repo, "rev-list", "--no-merges", "-n", str(commits), "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.split() if done.returncode == 0 else None


def head(repo: str) -> str | None:
    done = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.strip() if done.returncode == 0 else None


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.option("lineSep", "\x1e").text(path).where("value <> ''"))
