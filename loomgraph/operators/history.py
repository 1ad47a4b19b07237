"""Git history: log records, commits, co-changes and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text

MAX_FILES, MIN_SUPPORT, MIN_CONFIDENCE, MAX_PAIRS = 30, 3, 0.4, 5000


def parse_log(records: DataFrame) -> DataFrame:
    """(sha, author, email, ts, subject, files array<struct<path, insertions, deletions>>) of log records (value).

    A record is a header of fields cut by unit separators, then numstat lines. Counts that are no
    numbers are 0; records without sha, time or subject go.
    """
    lines = F.split(F.regexp_replace("value", "^\\x1e", ""), "\n")
    head = F.split(F.element_at(lines, 1), "\\x1f")
    cells = F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.size(F.split(x, "\t")) >= 3), lambda x: F.split(x, "\t", 3))
    count = lambda c: F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("int")), F.lit(0))
    files = F.transform(cells, lambda c: F.struct(text.renamed_path(c[2]).alias("path"), count(c[0]).alias("insertions"), count(c[1]).alias("deletions")))
    part = lambda i: F.get(head, i)
    rows = records.select(part(0).alias("sha"), part(1).alias("author"), part(2).alias("email"), part(3).try_cast("long").alias("ts"), part(4).alias("subject"), files.alias("files"))
    return rows.where("sha <> '' and ts is not null and subject <> ''")


def commit_totals(commits: DataFrame) -> DataFrame:
    """(sha, short_sha, insertions, deletions)."""
    total = lambda f: F.aggregate("files", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return commits.select("sha", F.substring("sha", 1, 7).alias("short_sha"), total("insertions").alias("insertions"), total("deletions").alias("deletions"))


def touched_by(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, sha, insertions, deletions): the first entry of each known path of each commit."""
    each = commits.select("sha", F.posexplode("files").alias("at", "f")).groupBy("sha", F.col("f.path").alias("path")).agg(F.min_by("f", "at").alias("f"))
    return each.join(files.select(F.col("id").alias("file_id"), F.col("file_path").alias("path")), "path").select("file_id", "sha", "f.insertions", "f.deletions")


def changed_files(commits: DataFrame) -> DataFrame:
    """(commit, file) of parsed commits."""
    return commits.select(F.col("sha").alias("commit"), F.explode("files").alias("f")).select("commit", F.col("f.path").alias("file"))


def change_counts(changes: DataFrame, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(file_a, file_b, support) and (file, times): how many commits change both files, and each, from changes (commit, file).

    Commits with more files than max_files count for nothing. max_files bounds the pairs of a commit, so the self-join
    stays linear in commits.
    """
    rows = changes.select("commit", "file").distinct()
    narrow = rows.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= max_files).select("commit")
    rows = rows.join(narrow, "commit")
    a, b = rows.select("commit", F.col("file").alias("file_a")), rows.select("commit", F.col("file").alias("file_b"))
    pairs = a.join(b, "commit").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("support"))
    return pairs, rows.groupBy("file").agg(F.count("*").alias("times"))


def adjusted_counts(old: tuple[DataFrame, DataFrame], come: DataFrame, gone: DataFrame, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """change_counts after commits came and went, from those before and the changes (commit, file) of these commits alone."""
    out = []
    for before, plus, minus in zip(old, change_counts(come, max_files), change_counts(gone, max_files)):
        *keys, value = before.columns
        less = minus.select(*keys, (-F.col(value)).alias(value))
        rows = before.unionByName(plus).unionByName(less).groupBy(*keys).agg(F.sum(value).alias(value))
        out.append(rows.where(F.col(value) > 0))
    return out[0], out[1]


def together(counts: tuple[DataFrame, DataFrame], min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_pairs: int | None = MAX_PAIRS) -> DataFrame:
    """(file_a, file_b, support, confidence) of change_counts. Confidence is support by the rarer file's commits."""
    pairs, times = counts
    pairs = pairs.where(F.col("support") >= min_support)
    both = pairs.join(times.withColumnsRenamed({"file": "file_a", "times": "ta"}), "file_a").join(times.withColumnsRenamed({"file": "file_b", "times": "tb"}), "file_b")
    out = both.withColumn("confidence", F.col("support") / F.least("ta", "tb")).where(F.col("confidence") >= min_confidence).select("file_a", "file_b", "support", "confidence")
    return out if max_pairs is None else out.orderBy(F.desc("support"), F.desc("confidence"), "file_a", "file_b").limit(max_pairs)


def mine_cochanges(changes: DataFrame, max_files: int = MAX_FILES, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_pairs: int | None = MAX_PAIRS) -> DataFrame:
    """(file_a, file_b, support, confidence) of files that change together, from changes (commit, file)."""
    return together(change_counts(changes, max_files), min_support, min_confidence, max_pairs)


def apply_cochanges(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind, weight, meta): an edge from the lower to the higher id; pairs with unknown files go."""
    own = files.select(F.col("id").alias("ia"), F.col("file_path").alias("file_a"))
    other = files.select(F.col("id").alias("ib"), F.col("file_path").alias("file_b"))
    rows = pairs.join(own, "file_a").join(other, "file_b")
    return rows.select(F.least("ia", "ib").alias("src"), F.greatest("ia", "ib").alias("dst"), F.lit("co_change").alias("kind"), F.col("confidence").alias("weight"), F.to_json(F.struct("support")).alias("meta"))


def features(commits: DataFrame, touches: DataFrame, min_commits: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features by commit scope, from commits (sha, subject, ord) and touches (file_id, sha).

    Gives features (scope, commits, types, doc), their commits (scope, sha), and their files (scope,
    file_id, weight: touches, at least min_commits of them).
    """
    scoped = commits.select("sha", "ord", "subject", text.commit_type("subject").alias("type"), text.commit_scope("subject").alias("scope")).where("scope <> ''")
    first = Window.partitionBy("scope").orderBy("ord", "sha")
    numbered = scoped.withColumn("n", F.row_number().over(first))
    subjects = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "subject")))), lambda x: x["subject"])
    found = numbered.groupBy("scope").agg(F.count("*").alias("commits"), F.array_sort(F.collect_set("type")).alias("types"), F.array_join(subjects, "; ").alias("doc")).where(F.col("commits") >= min_commits)
    members = scoped.join(found.select("scope"), "scope", "left_semi").select("scope", "sha")
    files = members.join(touches.select("file_id", "sha").distinct(), "sha").groupBy("scope", "file_id").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_commits)
    return found, members, files
