"""Main text of web pages: blocks by structure, and repeated substrings of a host for what structure leaves open.

A page is read into blocks of text in page order, with a stack of open elements
that closes what HTML lets authors leave open.  Structure decides most: what
stands in scripts, styles, forms, menus, page headers and footers, sidebars,
notices, adverts or reader comments is dropped, what stands in an article (or
else in main) is kept, since an article's words stay even where other pages have
them too.  Blocks of pages that have neither are open.  For these the token
streams of a host's pages are grouped by the first DEPTH tokens of each suffix.
These groups are the runs of a suffix array whose neighbours have common prefixes
of DEPTH tokens at least, so the words covered by the groups with distinct pages
are those that all longer common prefixes cover, too; the order inside a run
decides nothing and is not made.  The groups are found by hash, so a host of any
size is spread over all tasks and its equal suffixes meet as partial counts.
Covered words are boilerplate, unless nothing else is left of the page; unique
runs stay.  Pages of equal open blocks count as one page.

Contract.  Null and empty html have empty text.  Character references are
decoded, white space in a block becomes one space, blocks are trimmed, empty
ones left out, the rest joined by two line feeds.  Nothing is capped.  Pages are
told apart by hashes of page_id, url and html, so equal rows have equal text and
don't count as repeats of each other.  Extra columns are not read.  An empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import matched, written
from ._text import P1, Words, slices, span_hash

DEPTH = 8

#: Elements by what they mean for the main text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav footer aside form noscript template head button select svg object canvas audio video dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link base style script noscript template".split())
RAW = "script|style|textarea|iframe|title|xmp"
#: What a start tag closes, as long as none of the elements after it is open further in.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Names of classes, ids or roles that mark what is not the article, alone or with others of them and numbers.
MARKS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Parts of such names that mean nothing by themselves, and marks that an article's own parts may have.
NEUTRAL = frozenset("site main top bottom left right global bar box slot list area wrapper container block section links buttons posts form".split())
OF_ARTICLES = frozenset("header masthead banner".split())

_ATTRIBUTES = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")(?=[\s/>])" + _ATTRIBUTES + r".*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>" + _ATTRIBUTES + ")",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks_of(rest: str) -> list[set[str]]:
    """For each class, id and role of a tag the marks it consists of; empty for those that are something else."""
    out = []
    for m in _NAMED.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {p.lower() for p in _PARTS.findall(name)}
            out.append(parts & MARKS if parts <= MARKS | NEUTRAL else set())
    return out


def _is_marked(rest: str, in_article: bool) -> bool:
    """Whether a tag's names mark what is no article: outside one of them does, inside all must."""
    marks = _marks_of(rest) if "=" in rest else []
    return bool(marks) and (all(x - OF_ARTICLES for x in marks) if in_article else any(marks))


class _Reader:
    """Blocks of a page and the stack of its open elements that matter: (name, dropped)."""

    def __init__(self, page: str):
        self.page, self.stack, self.parts = page, [], []
        self.found: dict[str, list[str]] = {"article": [], "main": [], "": []}
        self.open = {"article": 0, "main": 0, "dropped": 0}

    def push(self, name: str, dropped: bool) -> None:
        self.stack.append((name, dropped))
        self.open["dropped"] += dropped
        if name in ("article", "main"):
            self.open[name] += 1

    def cut(self, k: int) -> None:
        """Close the k-th open element and all in it."""
        while len(self.stack) > k:
            name, dropped = self.stack.pop()
            self.open["dropped"] -= dropped
            if name in ("article", "main"):
                self.open[name] -= 1

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                self.found["article" if self.open["article"] else "main" if self.open["main"] else ""].append(text)

    def last(self, names: set[str], beyond: set[str]) -> int:
        """Where the last open element of these names is, unless one of the others is open further in; else -1."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                return k
            if self.stack[k][0] in beyond:
                return -1
        return -1

    def closes(self, name: str) -> None:
        # What is open outside an article is not closed from inside it.
        k = self.last({name}, set() if name in ("article", "main", "body", "html") else {"article", "main"})
        if name in BLOCKS:
            self.end_block()
        if k >= 0:
            self.cut(k)

    def opens(self, name: str, rest: str, past: int) -> None:
        if name in BLOCKS or name in DROPPED:
            self.end_block()
            if (k := self.last({"p"}, BLOCKS - {"p"})) >= 0:
                self.cut(k)
        if name in CLOSES:
            names, beyond = CLOSES[name]
            while (k := self.last(names, beyond)) >= 0:
                self.cut(k)
        if self.stack and self.stack[-1][0] == "head" and name not in IN_HEAD:
            self.cut(len(self.stack) - 1)
        if name == "body":
            self.cut(0)
        if name in VOID or rest.rstrip(">").endswith("/"):
            return
        marked = name not in ("body", "html", "main") and name not in HEADINGS and _is_marked(rest, self.open["article"] > 0)
        if name in ("article", "main") and not marked and self.open["dropped"]:
            # An article in what was never closed, or in a form around the whole page, is one all the same.
            k = next(k for k, x in enumerate(self.stack) if x[1])
            root = self.stack[k][0]
            if root == "form" or (root in DROPPED and f"</{root}" not in self.page[past:].lower()):
                self.cut(k)
        drops = marked or name in DROPPED or (name == "header" and not self.open["article"])
        if drops or name in BLOCKS or any(x[0] == name for x in self.stack):
            self.push(name, drops)


def blocks_of(page: str) -> tuple[list[str], list[str], list[str]]:
    """(blocks of articles, blocks of main, open blocks) of a page, each in page order."""
    reader, at = _Reader(page), 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not reader.open["dropped"]:
            reader.parts.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if name == "br" and not reader.open["dropped"]:
            reader.parts.append(" ")
        elif name:
            reader.closes(name) if m["close"] else reader.opens(name, m["rest"], at)
    rest = page[at:]
    if not reader.open["dropped"] and not re.match(r"\s*</?[a-zA-Z!]", rest):
        reader.parts.append(rest)
    reader.end_block()
    return reader.found["article"], reader.found["main"], reader.found[""]


def _parsed(pages: DataFrame) -> DataFrame:
    """pages with text where structure decides, and blocks where it does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(4)):
                part = batch.slice(a, b - a)
                text, open_blocks = [], []
                for page in part.column(4).to_pylist():
                    article, main, rest = blocks_of(page or "")
                    settled = article or main or not rest
                    text.append("\n\n".join(article or main) if settled else None)
                    open_blocks.append(None if settled else rest)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(text, pa.string()), pa.array(open_blocks, pa.list_(pa.string()))], names=["page_id", "url", "key", "host", "text", "blocks"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, key long, host long, text string, blocks array<string>"
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.xxhash64("page_id", "url", "html").alias("key"), F.xxhash64(host).alias("host"), "html").mapInArrow(run, schema)


def _suffixes(blocks: pa.ListArray) -> tuple[Words, np.ndarray]:
    """The words of each page's stream, and the places of suffixes of DEPTH words at least."""
    w = Words(pa.array(["\n".join(x or ()) for x in blocks.to_pylist()], pa.string()))
    n = len(w)
    past = np.repeat(w.first[1:], w.counts())
    return w, np.flatnonzero(np.arange(n) + DEPTH <= past)


def without_boilerplate(open_pages: DataFrame) -> DataFrame:
    """(key, text) of pages (key, host, blocks) without words that other pages of the host repeat."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, rows in ((x, slice_) for x in batches for slice_ in slices(pc.binary_join(x.column(2), "\n"))):
            batch = whole.slice(rows[0], rows[1] - rows[0])
            w, at = _suffixes(batch.column(2))
            doc = pa.array(np.searchsorted(w.first, at, "right") - 1)
            head = span_hash(w.hashes(P1), at, at + DEPTH)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(doc), pa.array(head.view(np.int64)), batch.column(0).take(doc), batch.column(3).take(doc), pa.array((at - w.first[doc.to_numpy()]).astype(np.int32))], names=["host", "head", "key", "stream", "place"])

    own = open_pages.dropDuplicates(["key"]).select("key", "host", "blocks", F.xxhash64("blocks").alias("stream"))
    found = written(own.mapInArrow(suffixes, "host long, head long, key long, stream long, place int"))
    many = found.groupBy("host", "head").agg(F.min("stream").alias("least"), F.max("stream").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    many = written(many.select("host", "head", "n"))
    places = matched(found, many, ["host", "head"], "n").groupBy("key").agg(F.collect_set("place").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = [x.split() for x in blocks]
                n = sum(map(len, words))
                edge = np.zeros(n + DEPTH + 1, np.int64)
                for p in places or ():
                    edge[p] += 1
                    edge[p + DEPTH] -= 1
                keep = np.cumsum(edge)[:n] == 0
                if not keep.any():
                    keep[:] = True
                left, at = [], 0
                for x in words:
                    left.append(" ".join(y for y, k in zip(x, keep[at : at + len(x)], strict=True) if k))
                    at += len(x)
                out.append("\n\n".join(x for x in left if x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "open_text"])

    return own.join(places, "key", "left").select("key", "blocks", "places").mapInArrow(cut, "key long, open_text string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parsed = written(_parsed(pages))
    open_pages = parsed.where("blocks IS NOT NULL")
    text = F.col("text")
    if not open_pages.isEmpty():
        parsed = parsed.join(without_boilerplate(open_pages), "key", "left")
        text = F.coalesce("text", "open_text")
    text = F.coalesce(text, F.lit(""))
    return parsed.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
