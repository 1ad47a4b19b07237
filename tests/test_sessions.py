"""Sessions over a stream against the same rows taken at once, with a restart and expiry."""

import random
from datetime import datetime, timedelta

from loomgraph.streaming import sessions

FEED = "session_id long, path string, seq long, ts timestamp"
START = datetime(2024, 1, 1)


def test_sessions_equal_a_batch_after_a_restart_and_close_when_idle(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(6), r.choice(["a.ts", "b.ts", "c.ts", None]), i, START + timedelta(minutes=i)) for i in range(120)]
    rows += [(None, "a.ts", 500, START), (7, "x.ts", None, START), (7, None, 501, None)]
    parts = [rows[:60], rows[60:], [(99, "late.ts", 1, START + timedelta(days=30))], [(0, "a.ts", 1000, START + timedelta(days=30))]]
    told = []
    for k, part in enumerate(parts):  # each part comes to a query of its own, which goes on from the checkpoint
        r.shuffle(part)
        spark.createDataFrame(part, FEED).coalesce(1).write.parquet(str(tmp_path / "feed" / f"part={k}"))
        feed = spark.readStream.schema(FEED + ", part int").parquet(str(tmp_path / "feed"))
        sessions.keep(feed, str(tmp_path / "rows"), str(tmp_path / "cp")).awaitTermination(120)
        told.append({(x.session_id, x.path): (x.seq, x.writes, x.iteration, x.closed) for x in sessions.told(spark, str(tmp_path / "rows")).collect()})
    turns = {s: sum(x[0] == s and x[1] is None for x in rows) for s in range(8)}
    want = {}
    for s, path, seq, _ in rows:
        if s is not None and path is not None:
            old = want.get((s, path), (None, 0))
            want[s, path] = (max((q for q in (seq, old[0]) if q is not None), default=None), old[1] + 1)
    flat = lambda closed: {k: (*v, turns[k[0]], closed) for k, v in want.items()}
    assert told[1] == flat(False)
    assert {k: v for k, v in told[2].items() if k[0] != 99} == flat(True) and told[2][99, "late.ts"] == (1, 1, 0, False)
    assert told[3][0, "a.ts"] == (1000, 1, 0, False)  # begins anew
    assert told[3][1, "b.ts"] == told[2][1, "b.ts"]
