"""Resampling, main texts and conversation repair against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import pytest

from loomgraph.llm import conversations, extraction, queries, resampling

SMALL = "/root/testdata/sf0.001"


def gains_by_hand(docs, target, low, high, buckets):
    def feats(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)], len(w)

    count = lambda ts: [sum(x) for x in zip([0] * buckets, *([f.count(b) for b in range(buckets)] for f, _ in map(feats, ts)))]
    s, t = count(docs), count(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    return feats, gain


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 2)])
def test_resampling_against_brute_force(spark, monkeypatch, low, high):
    monkeypatch.setattr(resampling, "JOINED", 60)
    monkeypatch.setattr(resampling, "TAKEN", 7)  # parts end within texts
    r = random.Random(5)
    word = lambda: r.choice(["Zug", "über", "A1", "b-c", "\x00x", "naïve", "Z", "end\n"])
    texts = [None, "", " \n", "one", "a b", *(" ".join(word() for _ in range(r.randint(1, 40))) for _ in range(60))]
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    target = [None, "", "über A1 zug", "b c A1"]
    rows = [(i, t, 1, "x") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, row string").repartition(3)
    got = resampling.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), low, high, buckets=50, least=8).collect()
    feats, gain = gains_by_hand(texts, target, low, high, 50)
    want = []
    for i, t in zip(ids, texts):
        f, words = feats(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-s, i is None, i) for i, _, w, _, s in want if w >= 8)
    drawn = {i: k for k, (_, _, i) in enumerate(able[: len(able) * 10 // 100], 1)}
    assert sorted(map(str, ((x.doc_id, x.n_features, x.n_words, x.weight, x.score, x.rank) for x in got))) == sorted(str((*w, drawn.get(w[0]) if w[2] >= 8 else None)) for w in want)


def test_resampling_of_ties_and_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none.select("text")).count() == 0
    same = spark.createDataFrame([(7, "w " * 30)] * 40 + [(None, "w " * 30)] * 3, "doc_id long, text string")
    ranks = sorted(x.rank for x in resampling.resampled(same, none.select("text")).collect() if x.rank)
    assert ranks == [1, 2, 3, 4]


def test_resampling_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rel = db.sql(f"select doc_id, n_features, weight, score, rank from ({queries.SQL['op11_resampling']})").fetchall()
    got = queries.op11_resampling(spark, SMALL).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, rel)) == sorted(str(tuple(r)) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li>Home<li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="adTop" class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One<br>two&nbsp; three.<p>Fo<i>u</i>r <div class="AdBox">buy</div>
<ul><li>x<li>y</ul><form>name <input></form><!-- no --></article><aside>Side</aside><section class="comments"><article>me too</article></section>
<footer>&copy; us</footer>"""


def test_main_text_of_an_article():
    assert extraction.main_text(extraction.Page(PAGE), set()) == "Head & tail One two three. Four x y"
    assert extraction.main_text(extraction.Page(PAGE[: PAGE.index("</article><aside>")]), set()) == "Head & tail One two three. Four x y"


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("a<b", "a<b"),
        ("<p>a</b><b>b<p>c</p>d", "ab c d"),
        ("<div>a<!-- <p>x</p> b", "a"),
        ("<table><tr><td>1<td>2<tr><td>3</table>z", "1 2 3 z"),
        ("<p title='a>b'>x &lt;y&gt; &#x41;&eacute;&bogus;", "x <y> Aé&bogus;"),
        ("<main>in<nav>menu</nav></main>out", "in"),
        ("<script>while (a<b) {}", ""),
        ("<div>" * 3000 + "deep", "deep"),
        ("<" * 5000 + "a" * 5000 + ">end", "<" * 4999 + "end"),
    ],
)
def test_main_text_of_odd_sources(source, text):
    assert extraction.main_text(extraction.Page(source), set()) == text


def test_templates_of_a_site(spark):
    story = lambda i: "".join(f"<p>Story {i} part {k} goes on.</p>" for k in range(4))
    frame = "<div><span>Our site</span><b>About</b></div>{}<div class=x1>All rights reserved <i>{}</i></div>"
    rows = [(i, f"https://Blog.example.com/{i}", frame.format(f"<div>{story(i)}</div>", ""), 0) for i in range(30)]
    rows += [(100 + i, f"http://two.example.com/{i}", frame.format(f"<div>{story(0)}</div>", ""), 0) for i in range(9)]  # copies
    rows += [(200, "http://three.example.com/", frame.format(story(3), ""), 0), (201, None, None, 0), (None, "no host", "<p>x", 0), (None, "no host", "<p>x", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, subtrees int").repartition(3)
    got = {(r.page_id, r.url): r for r in extraction.main_texts(pages).collect()}
    said = lambda i: " ".join(f"Story {i} part {k} goes on." for k in range(4))
    for i in range(30):
        assert got[i, f"https://Blog.example.com/{i}"].text == said(i)
    for i in range(9):
        assert got[100 + i, f"http://two.example.com/{i}"].text == said(0)
    assert got[200, "http://three.example.com/"].text == "Our siteAbout " + said(3) + " All rights reserved"  # one page makes no template
    assert got[201, None].text == "" and got[None, "no host"].n_chars == 1
    assert extraction.main_texts(pages).count() == len(rows)
    assert extraction.main_texts(pages.limit(0)).count() == 0


def test_main_texts_of_given_pages(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<b>|</b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", inner)]
        want[r.page_id] = " ".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in queries.op12_extraction(spark, SMALL).collect()} == want


def dijkstra(codes):
    """The cheapest and then least string of edits, by a search that knows no bound."""
    heap, best = [(0, "", 0, 0)], {}
    while heap:
        cost, letters, i, q = heapq.heappop(heap)
        if i == len(codes) and q in (0, 3):
            return cost, letters
        if best.get((i, q), (math.inf,)) <= (cost, letters):
            continue
        best[i, q] = cost, letters
        due = {0: "u", 1: "u", 2: "a", 3: "u"}[q]
        state = {"s": 1, "u": 2, "a": 3}
        heapq.heappush(heap, (cost + 2, letters + "I", i, state[due]))
        if i < len(codes):
            c, more = codes[i].lower(), codes[i] in "SUAX"
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q))
            if codes[i] != "D":
                heapq.heappush(heap, (cost + 2 + more, letters + "R", i + 1, state[due]))
                if c == due or c == "s" and q == 0:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, state[c]))
    return None


def test_cheapest_repairs_against_dijkstra():
    r = random.Random(3)
    for _ in range(1500):
        codes = "".join(r.choice("suaxSUAXDuaua") for _ in range(r.randint(0, 9)))
        cost, letters, _ = conversations.cheapest(codes)
        assert (cost, letters + conversations.ENDING[conversations.cheapest(codes)[2]]) == dijkstra(codes), codes


def repaired_by_hand(rows):
    """The contract, read aloud: rows (conv_id, turn, role, text) of one conversation."""
    said = lambda x: " " if x is None else str(x)
    out = []
    for c, t, role, text in rows:
        kind, role, text = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20, said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    codes, faults = "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for k, (_, role, text) in enumerate(out):
        end = re.sub("[\x20\x09-\x0d]+$", "", text)
        fault = "blank" if not end else "duplicate" if (role, text) in [x[1:] for x in out[:k]] else "truncated" if end[-1] not in ".!?" else ""
        if fault:
            faults[fault] += 1
        low = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "D" if fault in ("blank", "duplicate") else low.upper() if fault == "truncated" else low
    cost, audit = dijkstra(codes)
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    lines, k, last = [], 0, ""
    for e in audit:
        due = "assistant" if last == "user" else "user"
        if e != "I":
            _, role, text = out[k]
            k += 1
        if e == "D":
            continue
        last = role if e == "K" else due
        last = {"s": "system", "u": "user", "a": "assistant"}[last[0]]
        lines.append(f"{role if e == 'K' else due}:{'' if e == 'I' else text}")
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def odd_conversations():
    r = random.Random(11)
    rows = []
    for c in [None, *range(60)]:
        for k in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"])
            rows.append((c, r.choice([k, k, k, None, k + 3, k - 5]), role, r.choice(["Yes.", "No!", "well", "", " \t", None, "What? ", f"Line {k}.", "a\n"])))
    return rows + [rows[4]] * 3


def check_all(rows, got):
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = repaired_by_hand([r for r in rows if r[0] == c])
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)


def test_repairs_against_brute_force(spark):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, times int").repartition(3)
    check_all(rows, conversations.repairs(table).collect())
    assert conversations.repairs(table.limit(0)).count() == 0


def test_repairs_by_blocks_equal_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 4)
    r = random.Random(2)
    long = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", "no", f"Say {t}.", ""])) for t in range(90)]
    rows = odd_conversations() + long
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    key = lambda r: str(tuple(r))
    whole = conversations.repairs(table).collect()
    assert sorted(conversations.repairs(table, rows=20).collect(), key=key) == sorted(whole, key=key)
    assert sorted(conversations.repairs(table, rows=0).collect(), key=key) == sorted(whole, key=key)
