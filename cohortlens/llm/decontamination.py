"""Benchmark decontamination with a generalised suffix automaton of the items.

The automaton of the normalised items is built once and sent to every task.
Each document streams through it word by word; the length of the longest match
that ends at a word tells which words lie in an occurrence of a window of an
item.  Stretches in which some pair of neighbours is in no item can't match and
are skipped by array operations.

Contract.  Null texts have no words and no hits; items without words are
ignored; equal items count once each by item_id (a null item_id reads "null").
Equal documents each get their row.  Extra columns stay as they are, whatever
their names.  An empty table of documents or of items gives no hits.  Items of more than MAX_WORDS words together are
taken in blocks, one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import own_name, written
from ._text import ALNUM, Words, slices

#: Item words of one automaton (a few hundred bytes each on the driver and in every worker).
MAX_WORDS = 1_000_000
FOUND = "n_words long, spans array<struct<first:int,past:int>>, items array<string>"


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.n, self.vocab = n, {}
        self.length, self.link, self.next = [0], [-1], [{}]
        sequences = []
        for name, text in items:
            w = Words(pa.array([text]), ALNUM, lower=True)
            words = [w.body[s:e].tobytes() for s, e in zip(w.starts, w.ends, strict=True)]
            if words:
                sequences.append((name, [self.vocab.setdefault(x, len(self.vocab)) for x in words]))
        pairs = set()
        for _, seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            pairs.update(zip(seq[:-1], seq[1:], strict=True))
        #: At the state of a window of n words, or of a shorter whole item: its length and items.
        self.windows: dict[int, dict[int, set[str]]] = {}
        self.least = n
        for name, seq in sequences:
            k = min(n, len(seq))
            self.least = min(self.least, k)
            state, size = 0, 0
            for c in seq:
                state, size = self._step(state, size, c)
                if size >= k:
                    at = state
                    while self.length[self.link[at]] >= k:
                        at = self.link[at]
                    self.windows.setdefault(at, {}).setdefault(k, set()).add(name)
        names = list(self.vocab)
        flat = Words(pa.array([b" ".join(names).decode("utf-8")]), ALNUM)
        hashes = flat.hashes()
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.pairs = np.array(sorted(a * len(names) + b for a, b in pairs), np.int64)
        self.ends: dict[int, list] = {}

    def _extend(self, last: int, c: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = self._state(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, length: int) -> int:
        self.length.append(length), self.link.append(0), self.next.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _step(self, state: int, size: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], size + 1
        return 0, 0

    def _ending(self, state: int) -> list:
        """(length, items) of the windows that are suffixes of the state's strings."""
        if (found := self.ends.get(state)) is None:
            found, at = [], state
            while at > 0:
                found += self.windows.get(at, {}).items()
                at = self.link[at]
            self.ends[state] = found
        return found

    def matches(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words in windows, merged, and the items they are from."""
        spans, items, state, size = [], set(), 0, 0
        for k, c in enumerate(seq):
            state, size = self._step(state, size, c)
            if size < self.least:
                continue
            most = 0
            for length, names in self._ending(state):
                if length <= size:
                    most = max(most, length)
                    items |= names
            if most:
                first = k + 1 - most
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, k + 1))
        return spans, items

    def scan(self, w: Words) -> tuple[dict[int, list], dict[int, set]]:
        """Spans and items by text, for texts that have any."""
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        if not len(w) or not len(self.hashes):
            return spans, items
        h = w.hashes()
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        number = np.where(self.hashes[place] == h, self.order[place], -1)
        good = np.zeros(len(number), bool)  # this word and the next stand so in an item
        both = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
        key = number[both] * len(self.hashes) + number[both + 1]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            good[both] = self.pairs[at] == key
        good[w.first[1:-1][w.first[1:-1] > 0] - 1] = False
        if self.least == 1:
            firsts = np.flatnonzero((number >= 0) & ~np.concatenate([[False], good[:-1]]))
            pasts = np.flatnonzero((number >= 0) & ~good) + 1
        else:
            edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
            firsts, pasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        long = pasts - firsts >= self.least
        for a, b in zip(firsts[long], pasts[long], strict=True):
            found, names = self.matches(number[a:b].tolist())
            if found:
                doc = int(np.searchsorted(w.first, a, "right")) - 1
                own = int(w.first[doc])
                spans.setdefault(doc, []).extend((int(a) - own + x, int(a) - own + y) for x, y in found)
                items.setdefault(doc, set()).update(names)
        return spans, items


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, max_words: int, finish, schema) -> DataFrame:
    """finish(batch, words, spans, items) -> RecordBatch of schema for slices of docs (text first)."""
    spark = docs.sparkSession
    words = F.size(F.split("text", "[^0-9A-Za-z\u0080-\U0010ffff]+"))
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    total = rows.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-int(total) // max_words))
    spans_name, items_name = (own_name(x, docs.columns) for x in ("spans", "items"))
    held = docs.withColumns({spans_name: F.lit(None).cast("array<struct<first:int,past:int>>"), items_name: F.lit(None).cast("array<string>")})
    carried = held.schema
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        # Bounded: a block has about max_words words.
        automaton = spark.sparkContext.broadcast(Automaton([(r[0], r[1]) for r in own.collect()], n))
        last = block == blocks - 1

        def scan(batches: Iterator[pa.RecordBatch], automaton=automaton, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(0)):
                    part = batch.slice(a, b - a)
                    w = Words(part.column(0), ALNUM, lower=True)
                    spans, items = automaton.value.scan(w)
                    for d, old in enumerate(part.column(part.num_columns - 2).to_pylist() if blocks > 1 else ()):
                        if old:
                            spans.setdefault(d, []).extend((x["first"], x["past"]) for x in old)
                            items.setdefault(d, set()).update(part.column(part.num_columns - 1)[d].as_py())
                    spans = {d: _merged(x) for d, x in spans.items()}
                    if last:
                        yield finish(part, w, spans, items)
                    else:
                        lists = [[{"first": x, "past": y} for x, y in spans.get(d, ())] for d in range(b - a)]
                        names = [sorted(items.get(d, ())) for d in range(b - a)]
                        columns = [*part.columns[:-2], pa.array(lists, _SPAN_TYPE), pa.array(names, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        held = held.mapInArrow(scan, schema) if last else written(held.mapInArrow(scan, carried))
    return held


_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id with n_words, spans of words in windows of n words of an item, and the items."""

    def finish(batch: pa.RecordBatch, w: Words, spans: dict, items: dict) -> pa.RecordBatch:
        rows = range(len(batch))
        lists = [[{"first": x, "past": y} for x, y in spans.get(d, ())] for d in rows]
        names = [sorted(items.get(d, ())) for d in rows]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(w.counts(), pa.int64()), pa.array(lists, _SPAN_TYPE), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scanned(docs.select("text", "doc_id"), benchmark, n, max_words, finish, f"doc_id {kind}, {FOUND}")


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs.select("doc_id", "text"), benchmark, n)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["past"] - x["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without the hit spans; documents of which more than max_coverage of the words are hit go.

    A span goes with the bytes up to the next kept word.  Clean texts are unchanged, byte for byte.
    """
    columns, schema = docs.columns, docs.schema

    def finish(batch: pa.RecordBatch, w: Words, spans: dict, items: dict) -> pa.RecordBatch:
        keep, new = np.ones(len(batch), bool), {}
        for d, own in spans.items():
            n_hit, n_words = sum(y - x for x, y in own), int(w.first[d + 1] - w.first[d])
            keep[d] = n_hit <= max_coverage * n_words
            body, end, first, left = batch.column(0)[d].as_py().encode(), int(w.at[d + 1] - w.at[d]), int(w.first[d]), []
            at = 0
            for x, y in own:
                left.append(body[at : int(w.starts[first + x] - w.at[d])])
                at = int(w.starts[first + y] - w.at[d]) if y < n_words else end
            new[d] = (b"".join(left) + body[at:]).decode("utf-8", "replace")
        text = batch.column(0)
        if new:
            text = pa.array([new.get(d, x) for d, x in enumerate(text.to_pylist())], text.type)
        by_name = dict(zip(("text", *rest), (text, *batch.columns[1:]), strict=False))
        return pa.RecordBatch.from_arrays([by_name[c] for c in columns], names=columns).filter(pa.array(keep))

    rest = [c for c in columns if c != "text"]
    return _scanned(docs.select("text", *rest), benchmark, n, max_words, finish, schema)


__all__ = ["Automaton", "contamination", "contamination_report", "decontaminate"]
