import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline
    from loomgraph.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs.count())
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100
    kept = list(texts["near_copies"].values())
    assert len(kept) == len(set(kept))  # no exact copies
    strings = set()
    for _, t in sorted(texts["repeats"].items()):
        b = t.encode()
        own = {b[i : i + 100] for i in range(len(b) - 99)}
        assert len(own & strings) <= 300  # only what taking text out has joined anew
        strings |= own
    assert not any("token = \"" + "0" in t and "[SECRET]" not in t for t in texts["secrets"].values())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert rows.select("doc_id").distinct().count() == seen[-1]


def test_stages_keep_rows_of_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline
    from loomgraph.llm.common import written

    r = random.Random(6)
    texts = [" ".join(f"word{r.randrange(500)}" for _ in range(120)) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = written(docs, "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept = sorted((r.doc_id or 0, r.text) for r in docs.collect())
        assert kept == sorted((i or 0, t) for i, t in (rows if name == "quality" else set(rows))), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.doc_id is None) > 0 and sum(r.start == 0 for r in pieces) == 4


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline
    from loomgraph.llm.common import written

    names = ["had", "new_text", "score", "row", "own", "candidate", "kinds", "spans", "label", "quality"]
    text = "a token = abcdefgh1 b " + " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text, "en", "s", 9, *names), (2, None, "en", "s", 0, *names), (3, "", "en", "s", 0, *names)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = written(docs, "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns and all(r[n] == n for r in docs.collect() for n in names), name
    assert {r.doc_id: (r.text or "").startswith("a [SECRET] b ") for r in docs.collect()} == {1: True, 2: False}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 2


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline
    from loomgraph.llm.common import written

    docs = written(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
