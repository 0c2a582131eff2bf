"""Token counts of the sections of a document from one encoding of the whole.

A document is encoded once.  The character span of each token is joined with the
spans of the sections: both are sorted, so the join is a merge.  A token that
crosses a boundary goes to one section by a stated rule: "start" (where its
first byte lies), "end" (where its last byte lies) or "most" (the section that
holds most of its bytes, the earlier one on a tie).

Contract.  Null texts are empty, have one empty section and no tokens.  Sections
cover the text without gaps, so counts of a document's sections add up to its
tokens.  Equal rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import raw, slices
from ._tokens import byte_lengths, encoder

SECTIONS = "doc_id long, section int, start_byte long, n_bytes long, n_tokens long, n_crossing long"
RULES = ("start", "end", "most")


def line_starts(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where sections begin: at each text and after each line feed that is not a text's last byte."""
    after = np.flatnonzero(body == 0x0A) + 1
    return np.union1d(at[:-1], np.setdiff1d(after, at))


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """The section (by its begin in sorted sections) of each token span start <= bytes < end."""
    first = np.searchsorted(sections, starts, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(sections, np.maximum(ends, starts + 1) - 1, "right") - 1
    if rule == "end":
        return last
    best, most = first.copy(), np.zeros(len(starts), np.int64)
    limits = np.append(sections, np.iinfo(np.int64).max)
    for step in range(int((last - first).max(initial=0)) + 1):
        which = np.minimum(first + step, last)
        share = np.minimum(ends, limits[which + 1]) - np.maximum(starts, limits[which])
        better = (share > most) & (first + step <= last)
        best[better], most[better] = which[better], share[better]
    return best


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "start", sections: Callable = line_starts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per section of each document; tokenizer is a byte-level vocabulary without normaliser."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = byte_lengths(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(1), 10 << 20):
                texts = batch.column(1)[a:b]
                body, at = raw(texts)
                ids, begin = encoder(tokenizer).encode(texts)
                ends = np.cumsum(size[ids])
                starts = ends - size[ids]
                if (np.append(starts, len(body))[begin] != at).any():
                    raise ValueError("token spans do not cover the texts")
                lengths = np.diff(at)
                own = sections(body, at[np.append(lengths > 0, True)])  # of texts that are not empty
                place = attribute(starts, ends, own, rule)
                n_tokens = np.bincount(place, minlength=len(own))
                crosses = np.searchsorted(own, ends - 1, "right") - 1 != np.searchsorted(own, starts, "right") - 1
                n_crossing = np.bincount(place[crosses], minlength=len(own))
                doc = np.searchsorted(at[:-1], own, "right") - 1
                empty = np.flatnonzero(lengths == 0)
                doc, own = np.concatenate([doc, empty]), np.concatenate([own, at[empty]])
                n_tokens, n_crossing = (np.concatenate([x, np.zeros(len(empty), np.int64)]) for x in (n_tokens, n_crossing))
                order = np.argsort(doc, kind="stable")
                doc, own, n_tokens, n_crossing = doc[order], own[order], n_tokens[order], n_crossing[order]
                section = np.arange(len(doc)) - np.searchsorted(doc, doc)
                last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
                past = np.where(last, at[doc + 1], np.append(own[1:], 0)) if len(doc) else own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc)), pa.array(section, pa.int32()), pa.array(own - at[doc]), pa.array(past - own), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64())], names=["doc_id", "section", "start_byte", "n_bytes", "n_tokens", "n_crossing"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, SECTIONS)
