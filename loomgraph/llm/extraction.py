"""Main text of web pages: site templates go by hashed element subtrees that recur on a host, the rest of a page's frame by rules."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.scratch import written

#: A subtree is template if it is on so many pages of its host, and on this share of them.
LEAST_PAGES, SHARE = 5, 0.02
#: Counts that a task holds before it hands them on.
HELD = 100_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]{0,8192}"|'[^']{0,8192}'|[^>])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title iframe noframes noembed xmp".split()}
#: An open element of these ends where one of the others begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
KEEPS = frozenset("ul ol dl table select article main body html".split())
#: Elements that are no part of a page's text, or frame it.
FRAME = frozenset("head script style noscript template iframe object svg canvas audio video nav header footer aside form button select textarea dialog menu noframes noembed".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name a frame's parts.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager sidebar aside header masthead topbar footer share sharing social related recommended toolbar widget login".split()
)
READERS = frozenset("comment comments commentlist disqus replies respond".split())
#: Elements that may be template: those that hold others. Paragraphs and headings recur in copies of a text.
CONTAINERS = frozenset("div section nav header footer aside form ul ol dl table menu center details dialog fieldset figure td".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd td th tr".split())
#: Elements that begin and end a block of text; all others stand within one.
BLOCKS = PARAGRAPH_ENDS | frozenset("html head body title caption thead tbody tfoot legend optgroup option select summary noscript template script style textarea iframe".split())


class Page:
    """The elements of a page in document order, parents before children, and what stands in them.

    tags, parents, named (class, id and role as written) and hashes go by element; said lists (element, text),
    with None for a text where a block begins or ends.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.named, self.hashes = ["html"], [-1], [""], [0]
        self.said: list[tuple[int, str | None]] = []
        self._open, self._parts = [0], [[]]
        end = source.rfind(">") + 1
        at = 0
        while at < end and (m := TOKEN.search(source, at, end)):
            self._text(source[at : m.start()])
            at = m.end() if m[0][:4] != "<!--" or m[0].endswith("-->") else len(source)  # an open comment goes on to the end
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag)
            elif tag == "br":
                self.said.append((self._open[-1], " "))
            elif tag not in VOID:
                self._begin(tag, m[3])
                if tag in RAW:
                    close = RAW[tag].search(source, at)
                    at = close.start() if close else len(source)
                elif m[3].endswith("/") and tag == "svg":
                    self._pop()
        self._text(source[at:])
        while self._open:
            self._pop()

    def _text(self, text: str) -> None:
        if text:
            self.said.append((self._open[-1], html.unescape(text)))
            if text := " ".join(text.split()):
                self._parts[-1].append(text)

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in PARAGRAPH_ENDS:
            self._end_open({"p"}, KEEPS)
        for old, news in ENDS.items():
            if tag in news:
                self._end_open({old}, KEEPS)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.named.append(" ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else "")
        self.hashes.append(0)
        self._open.append(len(self.tags) - 1)
        self._parts.append([])
        if tag in BLOCKS:
            self.said.append((self._open[-1], None))

    def _end_open(self, tags: set[str], keeps: frozenset[str]) -> None:
        """Ends the innermost open element of tags, if none of keeps is within it."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in tags:
                while len(self._open) > k:
                    self._pop()
                return
            if tag in keeps or tag in CONTAINERS and tag != "td":
                return

    def _close(self, tag: str) -> None:
        for k in range(len(self._open) - 1, 0, -1):
            own = self.tags[self._open[k]]
            if own == tag:
                while len(self._open) > k:
                    self._pop()
                return
            if tag not in BLOCKS and own in BLOCKS:
                return  # a tag that crosses a block's border is of no consequence

    def _pop(self) -> None:
        node, parts = self._open.pop(), self._parts.pop()
        tag = self.tags[node]
        if parts:
            h = hashlib.blake2b("\0".join([tag, *parts]).encode("utf-8", "replace"), digest_size=8).digest()
            self.hashes[node] = int.from_bytes(h, "little", signed=True)
            if self._parts:
                self._parts[-1].append(f"\1{h.hex()}")
        if tag in BLOCKS:
            self.said.append((node, None))


def _names(named: str) -> set[str]:
    return {w.lower() for w in WORD.findall(named)} - {"class", "id"}


def _is_frame(tag: str, named: str, holds_main: bool) -> bool:
    if tag in FRAME:
        return True
    if not named or tag in ("html", "body"):
        return False
    words = _names(named)
    if words & READERS and not words & {"no", "has", "with"}:
        return True
    if holds_main or tag in ("article", "main") or words & {"no", "has", "with"}:
        return False
    role = re.search(r"role=(\w+)", named)
    return bool(words & NAMES) or bool(role and role[1].lower() in ROLES)


def _main(page: Page) -> tuple[list[bool], list[bool]]:
    """Per element: whether it is, or is in, an article or main; whether it holds one."""
    n = len(page.tags)
    own = [t in ("article", "main") or "role=main" in a for t, a in zip(page.tags, page.named)]
    within, holds = own[:], [False] * n
    for i in range(1, n):
        within[i] = own[i] or within[page.parents[i]]
    for i in range(n - 1, 0, -1):
        holds[page.parents[i]] |= own[i] or holds[i]
    return within, holds


def candidates(page: Page) -> list[int]:
    """Elements that may be template, and have text: containers outside the article that hold none."""
    within, holds = _main(page)
    return [i for i in range(1, len(page.tags)) if page.hashes[i] and page.tags[i] in CONTAINERS and not within[i] and not holds[i]]


def _said(page: Page, keep: list[bool]) -> str:
    blocks, run = [], []
    for node, text in [*page.said, (0, None)]:
        if text is None:
            if run and (block := " ".join("".join(run).split())):
                blocks.append(block)
            run = []
        elif keep[node]:
            run.append(text)
    return " ".join(blocks)


def main_text(page: Page, template: frozenset[int] | set[int]) -> str:
    """The page's text without elements whose hash is in template, without its frame, and without what is beside its article.

    Without an article or main, all that is left counts; the element that holds over half of it is no
    template, nor are all elements together: copies of one text recur on a host too.
    """
    n = len(page.tags)
    within, holds = _main(page)
    gone = [_is_frame(page.tags[i], page.named[i], holds[i]) for i in range(n)]
    for i in range(1, n):
        gone[i] = gone[i] or gone[page.parents[i]]
    articles = [page.tags[i] == "article" and not gone[i] for i in range(n)]
    for root in (articles, [within[i] and not gone[i] for i in range(n)]):
        inside = root[:]
        for i in range(1, n):
            inside[i] = (root[i] or inside[page.parents[i]]) and not gone[i]
        if any(root) and (text := _said(page, inside)):
            return text
    sizes = [0] * n
    for node, text in page.said:
        sizes[node] += len(text.strip()) if text and not gone[node] else 0
    for i in range(n - 1, 0, -1):
        sizes[page.parents[i]] += sizes[i]
    deleted = [False] * n
    for i in candidates(page):
        deleted[i] = page.hashes[i] in template and 2 * sizes[i] <= sizes[0]
    for i in range(1, n):
        deleted[i] = deleted[i] or deleted[page.parents[i]]
    return _said(page, [not g and not d for g, d in zip(gone, deleted)]) or _said(page, [not g for g in gone])


def _parsed(value: bytes | None) -> Page:
    return Page((value or b"").decode("utf-8", "replace"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(found)
        b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())], ["host", "subtree", "n"])
        found.clear()
        return b

    for b in batches:
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            page = _parsed(source)
            found[host, None] += 1
            found.update({(host, page.hashes[i]) for i in candidates(page)})
            if len(found) > HELD:
                yield out()
    yield out()


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next slash, question mark or hash, A-Z in lower case; null if there is none."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.nullif(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, subtrees): hashes of the subtrees that are on at least so many pages and this share of the pages of a host, of pages (url, html).

    Each task counts what it reads, once per page; one sum per host and subtree is shuffled. A host keeps at
    most 1/share subtrees for each that a page has on average.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("binary").alias("html")).where("host is not null")
    sums = written(rows.mapInArrow(_counted, "host string, subtree long, n long").groupBy("host", "subtree").agg(F.sum("n").alias("n")), "subtrees")
    of_host = sums.where("subtree is null").select("host", F.col("n").alias("pages"))
    many = sums.where(f"subtree is not null and n >= {least}").join(of_host, "host").where(F.col("n") >= F.col("pages") * share)
    return many.groupBy("host").agg(F.collect_list("subtree").alias("subtrees"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, frozenset] = {}
    for b in batches:
        texts = []
        for source, subtrees in zip(b.column("html").to_pylist(), b.column("subtrees")):
            own = tuple(subtrees.as_py() or ())
            if own not in known:
                known.clear() if len(known) > 64 else None
                known[own] = frozenset(own)
            texts.append(main_text(_parsed(source), known[own]))
        out = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    A null or empty html has the empty text. A url without a host belongs to no site, so no template is taken from its
    page. Null and repeated page_ids are rows of their own; repeated pages count each. Other columns are
    ignored; no rows: no rows. Pages meet their host's templates by an equality join, which Spark broadcasts while the templates are
    small and else splits where a host is hot.
    """
    found = written(templates(pages, least, share), "templates")
    rows = pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), F.col("html").cast("binary").alias("html"))
    return rows.join(found, "host", "left").select("page_id", "url", "html", "subtrees").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
