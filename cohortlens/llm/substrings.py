"""Substring de-duplication by recompression.

The words of all documents are compressed in rounds: a round first names maximal
runs of one symbol, then pairs whose left symbol is of one half of the alphabet
and whose right symbol is of the other.  A name is a hash of the names that it
stands for, so equal substrings have the same name in every task without a
dictionary, and the naming rounds need no exchange; what must meet is which
names are shared.  A symbol depends on a known stretch of words around it; where
the same words stand, the same symbol stands.  So every window of WIDTH words
has symbols that depend on nothing outside it, equal windows have the same ones,
and of those of the highest level the longest (then the least by name) is the window's anchor.
Consecutive windows share anchors: about one word in ten begins one.

1. A Spark round names the anchors of all documents, each name with the context
   that it depends on, and counts them.  Names of one place can't repeat.
2. A second round brings the places of shared names together.  Places whose whole
   stretch of windows is equal repeat as a whole.
3. What is left, the edges of repeats, is verified in a last round window by window
   with 128-bit hashes of their words.

Windows without such a symbol (inside long runs) are their own anchors, so the
result is exact but for collisions of 128 bits: names of two hash families tell
stretches apart, and a name that stands for two things only costs a verification.
Names that many places share are broadcast and their places stay where they are (matched()).

Contract.  Null and empty texts have no words and stay as they are; texts of
fewer than WIDTH words have no windows.  A repeated row is an occurrence like
any other, so both of its copies lose what they share.  Documents are told
apart by two hashes of doc_id and text.  Extra columns pass through, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, matched, written
from ._text import P1, P2, Words, mix, slices, span_hash

WIDTH, ROUNDS = 35, 3
_NEVER = np.int64(1) << 40


def _symbols(names: np.ndarray, doc_first: np.ndarray, n_docs_words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each round's symbols their names, where they begin, and the stretch [low, high) of words that each depends on (outside all if it sees an end)."""
    n = len(names)
    low, high = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    begin = low
    first = np.zeros(n, bool)  # the symbol begins a document
    first[doc_first[n_docs_words > 0]] = True
    out = []
    for r in range(ROUNDS):
        low, high = _with_neighbours(low, high, first)
        # Runs: what begins one differs from the symbol before.
        begins = np.ones(len(names), bool)
        begins[1:] = (names[1:] != names[:-1]) | first[1:]
        names, begin, low, high, first = _merge(names, begin, low, high, first, begins, 2 * r)
        # Pairs: a left symbol and the right symbol after it.
        right = (mix(names ^ np.uint64(0x51 + r)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(names), bool)
        joins[1:] = right[1:] & ~right[:-1] & ~first[1:]
        low_n, high_n = _with_neighbours(low, high, first)
        # A left symbol looks at the next one, a right symbol at the one before.
        low, high = np.where(right, low_n, low), np.where(right, high, high_n)
        names, begin, low, high, first = _merge(names, begin, low, high, first, ~joins, 2 * r + 1)
        out.append((names, begin, low, high))
    return out


def _with_neighbours(low: np.ndarray, high: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.full(len(low), -_NEVER), np.full(len(high), _NEVER)
    before[1:] = np.where(first[1:], -_NEVER, low[:-1])
    after[:-1] = np.where(first[1:], _NEVER, high[1:])
    return np.minimum(low, before), np.maximum(high, after)


def _merge(names, begin, low, high, first, begins, salt: int):
    at = np.flatnonzero(begins)
    if len(at) == len(names):
        return names, begin, low, high, first
    ends = np.append(at[1:], len(names))
    new = span_hash(names, at, ends)
    single = ends - at == 1
    new[single] = names[at[single]]
    new[~single] ^= np.uint64(salt + 1)
    return new, begin[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), first[at]


def _least_in(low: np.ndarray, high: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """For each window start, the least rank of the stretches that lie in the window; the largest number if none."""
    none = np.iinfo(np.uint64).max
    a, b = high - WIDTH, low
    size = b - a + 1
    levels = np.floor(np.log2(size)).astype(np.int64)
    table = None
    for k in range(int(np.log2(WIDTH)) + 1, -1, -1):
        here = np.full(n, none, np.uint64)
        if table is not None:  # a block of 2**(k+1) windows is two blocks of 2**k
            here = table.copy()
            half = 1 << k
            here[half:] = np.minimum(here[half:], table[:-half] if half < n else table[:0])
        own = levels == k
        for place in (a[own], b[own] - (1 << k) + 1):
            np.minimum.at(here, place, rank[own])
        table = here
    return table


class Anchors:
    """Anchors of a slice of texts: maximal ranges of windows that share one.

    key is the anchor's name at its level with its context, whole a second hash of all words of the windows.
    """

    def __init__(self, texts: pa.Array, width: int = WIDTH):
        w = self.words = Words(texts)
        n = len(w)
        counts = w.counts()
        h1 = w.hashes(P1)
        self.h1, self.h2 = h1, None
        empty = np.zeros(0, np.int64)
        self.doc = self.first = self.size = empty
        self.key = self.whole = empty.astype(np.uint64)
        doc_of = np.repeat(np.arange(len(counts)), counts)
        past = w.first[1:][doc_of] if n else empty
        valid = np.arange(n) + width <= past
        if not valid.any():
            return
        none = np.iinfo(np.uint64).max
        anchor_key = np.zeros(n, np.uint64)
        anchor_at = np.full(n, -1, np.int64)  # where the anchor's symbol begins
        missing = valid.copy()
        levels = _symbols(h1, w.first[:-1], counts)
        for level in range(ROUNDS - 1, ROUNDS - 3, -1):
            names, begin, low, high = levels[level]
            end = np.append(begin[1:], n)
            fits = (low >= 0) & (high <= n) & (high - low <= width)
            names, begin, end, low, high = names[fits], begin[fits], end[fits], low[fits], high[fits]
            # Not all of a stretch's windows lie in its document.
            own = np.searchsorted(w.first, low, "right") - 1
            a, b = np.maximum(high - width, w.first[own]), np.minimum(low, w.first[own + 1] - width)
            fits = a <= b
            names, begin, end, low, high, a, b = (x[fits] for x in (names, begin, end, low, high, a, b))
            if not len(names):
                continue
            # A name by its level and in its context: the words of the stretch that it depends on.
            key = mix(names + np.uint64(level + 1)) ^ span_hash(h1, low, high)
            # Symbols of more words come first: fewer places share their names.  Then the name decides.
            bits = int(len(key)).bit_length()
            rank = np.uint64(63) - np.minimum(end - begin, 63).astype(np.uint64) << np.uint64(58)
            rank |= (key >> np.uint64(6 + bits)) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64)
            found = _least_in(b, a + width, rank, n)
            take = missing & (found != none)
            which = (found[take] & np.uint64((1 << bits) - 1)).astype(np.int64)
            anchor_key[take], anchor_at[take] = key[which], begin[which]
            missing &= ~take
        alone = np.flatnonzero(missing)
        anchor_key[alone], anchor_at[alone] = span_hash(h1, alone, alone + width), alone
        at = np.flatnonzero(valid)
        new = np.ones(len(at), bool)
        new[1:] = (anchor_at[at[1:]] != anchor_at[at[:-1]]) | (at[1:] != at[:-1] + 1) | (anchor_key[at[1:]] != anchor_key[at[:-1]])
        begin = np.flatnonzero(new)
        starts, self.size = at[begin], np.diff(np.append(begin, len(at)))
        self.key, self.doc = anchor_key[starts], doc_of[starts]
        self.first = starts - w.first[self.doc]
        self.h2 = w.hashes(P2)
        whole = span_hash(self.h2, starts, starts + self.size + width - 1, P2)
        self.whole = mix(whole + (anchor_at[starts] - starts).astype(np.uint64))


_ID = ["id_a", "id_b"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two hashes that stand for doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"id_a": F.xxhash64("doc_id", text), "id_b": F.xxhash64(text, F.lit(7), "doc_id")})


def _each(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(texts, id_a, id_b) -> RecordBatch over slices of docs (text, id_a, id_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                yield make(batch.slice(a, b - a))

    return docs.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id_a, id_b, text, spans): documents with windows that repeat, and their windows as [first, size] in words.

    docs has text, id_a and id_b.
    """
    if width != WIDTH:
        raise ValueError(f"windows have {WIDTH} words; ROUNDS is chosen for that")
    docs = docs.select("text", *_ID)

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Anchors(batch.column(0))
        rows = pa.array(x.doc)
        return pa.RecordBatch.from_arrays([*(pa.array(v.view(np.int64)) for v in (x.key, x.whole)), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(x.first.astype(np.int32)), pa.array(x.size.astype(np.int32))], names=["key", "whole", *_ID, "first", "size"])

    places = written(_each(docs, named, "key long, whole long, id_a long, id_b long, first int, size int"))
    names = written(places.groupBy("key").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1"))
    found = written(matched(places, names, ["key"], "shared"))
    # Of each stretch one occurrence stands for all where others of its anchor differ.
    stretch = found.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.max("shared").alias("all"), F.min(F.struct("id_a", "id_b", "first")).alias("one"))
    stretch = written(stretch.select("key", "whole", "n", (F.col("n") < F.col("all")).alias("mixed"), "one"))
    is_one = (F.col("one.id_a") == F.col("id_a")) & (F.col("one.id_b") == F.col("id_b")) & (F.col("one.first") == F.col("first"))
    marked = matched(found, stretch, ["key", "whole"], "n").select(*_ID, "first", "size", (F.col("n") > 1).alias("repeats"), (F.col("mixed") & is_one).alias("verify")).where("repeats OR verify")
    lists = marked.groupBy(*_ID).agg(F.collect_set(F.struct("first", "size", "repeats", "verify")).alias("stretches"))
    own = written(docs.join(lists, _ID).select("text", *_ID, "stretches"))
    discard(places, names, found, stretch)

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Windows to verify: (hash, hash, document, place)."""
        w = Words(batch.column(0))
        stretches = batch.column(3)
        at, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = np.diff(np.asarray(stretches.offsets))
        flat = stretches.flatten()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        use = np.asarray(flat.field("verify").to_numpy(zero_copy_only=False), bool)
        for d, f, s in zip(owner[use], flat.field("first").to_numpy()[use], flat.field("size").to_numpy()[use], strict=True):
            at.append(np.arange(f, f + s) + w.first[d]), doc.append(np.full(s, d))
        at, doc = np.concatenate(at), np.concatenate(doc)
        a, b = (span_hash(w.hashes(p), at, at + WIDTH, p) for p in (P1, P2))
        rows = pa.array(doc)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(1).take(rows), batch.column(2).take(rows), pa.array((at - w.first[doc]).astype(np.int32))], names=["a", "b", *_ID, "first"])

    windows = written(_each(own.where(F.exists("stretches", lambda x: x["verify"])), edges, "a long, b long, id_a long, id_b long, first int"))
    again = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    verified = windows.join(again, ["a", "b"], "left_semi").groupBy(*_ID).agg(F.collect_set(F.struct("first", F.lit(1).alias("size"))).alias("verified"))
    sure = F.transform(F.filter("stretches", lambda x: x["repeats"]), lambda x: F.struct(x["first"].alias("first"), x["size"].alias("size")))
    spans = F.concat(sure, F.coalesce(F.col("verified"), F.array().cast("array<struct<first:int,size:int>>")))
    return own.join(verified, _ID, "left").select(*_ID, "text", spans.alias("spans")).where(F.size("spans") > 0)


def kept_words(w: Words, spans: pa.ListArray) -> np.ndarray:
    """Words of a slice in no window of its spans."""
    sizes = np.diff(np.asarray(spans.offsets))
    flat = spans.flatten()
    edge = np.zeros(len(w) + 1, np.int64)
    if len(flat):
        first = flat.field("first").to_numpy() + np.repeat(w.first[:-1], sizes)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + flat.field("size").to_numpy() + WIDTH - 1, -1)
    return np.cumsum(edge)[:-1] == 0


def substring_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    keyed = _keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                w = Words(part.column(3))
                keep = np.ones(len(w), bool)
                sha = [hashlib.sha256(w.joined(k, keep)).hexdigest() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(w.counts(), pa.int64()), pa.array(sha)], names=["doc_id", *_ID, "n_words", "sha"])

    def rest(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(0))
        keep = kept_words(w, batch.column(3))
        sha = [hashlib.sha256(w.joined(k, keep)).hexdigest() for k in range(len(batch))]
        left = np.concatenate([[0], np.cumsum(keep)])[w.first]
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(w.counts() - np.diff(left), pa.int64()), pa.array(sha)], names=[*_ID, "removed", "left_sha"])

    everything = keyed.select("doc_id", *_ID, "text").mapInArrow(whole, "doc_id long, id_a long, id_b long, n_words long, sha string")
    changed = _each(spans.select("text", *_ID, "spans"), rest, "id_a long, id_b long, removed long, left_sha string").dropDuplicates(_ID)
    out = everything.join(changed, _ID, "left")
    return out.select("doc_id", "n_words", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("left_sha", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs whose repeated windows are cut out of the text: kept words joined by one space; other texts unchanged.

    Texts of which nothing is left are empty; null and empty texts stay so.
    """
    columns = docs.columns
    keyed = _keyed(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "doc_id", "text"))
    spans = repeated_spans(keyed)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(0))
        keep = kept_words(w, batch.column(3))
        new = [w.joined(k, keep).decode("utf-8", "replace") for k in range(len(batch))]
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(new, pa.string())], names=[*_ID, "new_text"])

    changed = _each(spans.select("text", *_ID, "spans"), cut, "id_a long, id_b long, new_text string").dropDuplicates(_ID)
    out = keyed.join(changed, _ID, "left")
    return out.select(*(F.coalesce("new_text", F.col("row")[c]).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns))
