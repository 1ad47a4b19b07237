"""Nulls, repeated keys and odd files at the edges of the operators."""

import random
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import common, embeddings, media, packing, quality, secrets
from loomgraph.llm.common import written


def test_secrets_of_null_and_repeated_ids(spark):
    key = "AKIA" + "A" * 12
    rows = [(None, key), (None, "none"), (None, f"x {key}"), (5, key), (5, "none"), (6, None)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kinds string, row int").repartition(3)
    got = sorted(str((r.doc_id, r.n_access, r.spans)) for r in secrets.digest(docs).collect())
    assert got == sorted(map(str, [(None, 1, "access:0:16"), (None, 0, ""), (None, 1, "access:2:18"), (5, 1, "access:0:16"), (5, 0, ""), (6, 0, "")]))


def test_packing_spreads_null_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    docs = spark.createDataFrame([(None, "same text here")] * 60 + [(3, "other")] * 5, "doc_id long, text string").repartition(4)
    got = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), 64).collect()
    assert len(got) == 65 and sum(r.doc_id is None for r in got) == 60
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len({p[:2] for p in places}) == 65
    for a, b in zip(places, places[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_vectors_without_ids(spark):
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(None, v, 1), (None, v, 1), (4, v, 1), (4, v, 1), (2, v, 1), (9, w, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = sorted(str(tuple(r)) for r in embeddings.near_vectors(table).collect())
    assert got == sorted(map(str, [(None, 0, None, True)] * 2 + [(4, 2, 2, False)] * 2 + [(2, 2, 2, True), (9, 0, 9, True)]))


def track(samples, keys=None):
    """A trak box whose one chunk begins at byte 0."""
    full = lambda kind, *n: media.box(kind, struct.pack(f">{len(n) + 1}I", 0, *n))
    stbl = media.box(b"stsd", struct.pack(">II", 0, 1) + media.box(b"raw ", bytes(8)))
    stbl += full(b"stts", 1, samples, 1) + full(b"stsc", 1, 1, samples, 1) + full(b"stsz", 1, samples) + full(b"stco", 1, 0)
    stbl += full(b"stss", len(keys), *keys) if keys else b""
    return media.box(b"trak", media.box(b"mdia", full(b"mdhd", 0, 0, 1000, samples, 0) + media.box(b"minf", media.box(b"stbl", stbl))))


def test_tracks_are_read_apart():
    data = media.box(b"moov", track(10) + track(5, [1, 4]))
    assert len(media.described(data)["keyframes"]) == 10
    assert media.described(data, 1)["keyframes"] == [(0, 1), (3, 1)]
    with pytest.raises(IndexError):
        media.described(data, 2)


def test_nested_boxes_end_no_job(spark):
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    files = spark.createDataFrame([(1, bytearray(deep)), (2, bytearray(media.box(b"moov", track(3)))), (3, None)], "id int, content binary")
    assert {r.id: r.samples for r in media.media_columns(files).collect()} == {1: None, 2: 3, 3: None}


def test_quality_of_long_classes_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "TEXT_BYTES", 500)
    good, bad = "a calm and clear sentence about rivers. " * 4, "BUY $$$ now!!! click http://x " * 40
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    rows = [(i, (good if k % 2 else bad) + str(i)) for k, i in enumerate(train)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(train)] + [(None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + [(None, good), (None, bad), (train[0], bad), (999, None), (998, "")]], "doc_id long, text string, score double")
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(rows) + 5
    of = {r.doc_id: r for r in got}
    assert all(of[i].predicted == k % 2 for k, i in enumerate(train))
    assert of[999].score == of[998].score and sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]
    assert quality.judged(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_quality_learns_with_only_its_dictionaries_on_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    r = random.Random(8)
    words = [[f"{kind}{i}" for i in range(400)] for kind in ("good", "bad")]
    rows = [(i, " ".join(r.choices(words[i % 2] if i % 7 else words[0] + words[1], k=120)), 1 - i % 2) for i in range(600)]
    docs = written(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), "docs")
    labels = written(spark.createDataFrame([x[::2] for x in rows], "doc_id long, quality int"), "labels")
    monkeypatch.setattr(quality, "DICTIONARY", 4096)
    got = []

    def collect(self, real=DataFrame.collect):
        got.append(real(self))
        return got[-1]

    monkeypatch.setattr(DataFrame, "collect", collect)
    model = quality.learned(docs, labels)
    assert sum(len(x["text"]) for part in got for x in part if "text" in x) <= 2 * (4096 + 2000)

    hashes = {x.doc_id: x.h for x in docs.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    half = [[], []]
    for q in (0, 1):
        own = [(t.encode(), q) for _, _, t in sorted((hashes[i], i, t) for i, t, label in rows if label == q)]
        half[0] += own[::2]
        half[1] += own[1::2]
    bad, good = (b"\n".join(t for t, q in half[0] if q == c)[:4096] for c in (0, 1))
    x = quality.differences([t for t, _ in half[1]], quality._compressors(quality.Model(good, bad)))
    w = quality._logistic(np.c_[np.ones(len(x)), x / (x.std() + 1e-9)], np.array([q for _, q in half[1]], float))
    assert model == quality.Model(good, bad, (float(w[0]), float(w[1] / (x.std() + 1e-9))))


def test_a_round_of_components_runs_few_tasks(spark):
    """What the driver holds of a run grows with its tasks."""
    r = random.Random(9)
    pairs = [(r.randrange(600), r.randrange(600)) for _ in range(500)] + [(1000, i) for i in range(1001, 1300)]
    edges = written(spark.createDataFrame(pairs, "a long, b long"), "links")
    root = {x: x for pair in pairs for x in pair if pair[0] != pair[1]}
    for _ in range(len(root)):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    rounds, real = [], common.write
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        common.write = lambda df, name: (rounds.append(name), real(df, name))[1]
        spark.sparkContext.setJobGroup("components", "")
        found = common.connected_components(edges)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numTasks for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks)
    finally:
        common.write = real
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {x.node: x.component for x in found.collect()} == root
    assert tasks <= 100 * len(rounds)


#: Runs tasks over 12 MB of text each, as a Python worker does one after another, and prints how many MB each leaves behind.
LEFT = """
import random, re, pyarrow as pa
from loomgraph.llm import quality, simhash, suffixes

def held():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

draw = random.Random(5)
words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(20000)]
text = lambda: " ".join(draw.choices(words, k=500))
model = quality.Model(*("\\n".join(text() for _ in range(400)).encode()[: 1 << 20] for _ in range(2)), (0.0, 1.0))
ids, texts = pa.array(range(4000)), pa.array([text() for _ in range(4000)])
own = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([ids, texts], ["doc_id", "text"])], ["own"])
rows = pa.RecordBatch.from_arrays([ids, ids, texts], ["row", "doc_id", "text"])
both = pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])
small = quality.Model(b"a", b"b", (0.0, 1.0))
for task in (lambda m, k: quality._scored(iter([own[:k]]), m), lambda m, k: simhash._sketched(iter([rows[:k]]), 5), lambda m, k: suffixes._suffixes(iter([both[:k]]))):
    list(task(small, 9))  # what is loaded once
    before = held()
    for _ in task(model, 4000):
        pass
    print(round(held() - before))
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_tasks_leave_no_memory_behind():
    told = subprocess.run([sys.executable, "-c", LEFT], cwd=Path(common.__file__).parents[2], capture_output=True, text=True, check=True).stdout
    left = [int(x) for x in told.split()]
    assert len(left) == 3
    assert max(left) <= 12, left
