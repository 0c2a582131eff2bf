"""Encoding whole texts with a public tokenizer, each distinct piece of a batch once.

Both vocabularies split a text before their merges, and the splits never cross
the places where this module cuts, so the ids of a text are the ids of its
pieces in a row.  Texts in which a cut might not be safe (spaces beside other
white space, white space beyond ASCII, a special token's string) are encoded whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a cut at single spaces could change the ids; MARK is the character put between pieces.
MARK = "\x01"
_UNSAFE = (
    r"[ ][ \t-\r]|[\t-\r][ ]|^[ ]|[ ]$|<\||[\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
#: Pieces remembered by a worker (about 80 MB), and pieces encoded in one call.
REMEMBERED, TOGETHER = 250_000, 64


def token_path(name: str) -> str:
    """Where a public vocabulary lies; any path to a file of the same kind does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """ids of a slice of texts as one array and the place where each text's ids begin."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        mark = [i for t, i in self.tokenizer.get_vocab().items() if "\u0101" in t]
        self.mark = self.tokenizer.encode(" " + MARK, add_special_tokens=False).ids[-1]
        # Words stand apart in the word vocabulary; in the other a mark follows at once, which no merge takes up.
        self.glue = f" {MARK} " if len(mark) == 2 else MARK
        self.joins = len(mark) <= 2

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        at = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=at[1:])
        return np.concatenate([np.asarray(x, np.uint32) for x in found] or [np.zeros(0, np.uint32)]), at

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _raw, for pieces that hold no mark."""
        if not self.joins:
            return self._raw(pieces)
        glue = self.glue
        flat, _ = self._raw([glue.join(pieces[k : k + TOGETHER]) + glue for k in range(0, len(pieces), TOGETHER)])
        marks = np.flatnonzero(flat == self.mark)
        if len(marks) != len(pieces):  # a vocabulary that merges the mark
            self.joins = False
            return self._raw(pieces)
        at = np.zeros(len(pieces) + 1, np.int64)
        at[1:] = marks - np.arange(len(marks))
        return flat[flat != self.mark], at

    def _of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _raw, remembering pieces up to a bound."""
        get = self.known.get
        code = np.fromiter((get(x, -1) for x in pieces), np.int64, len(pieces))
        new = np.flatnonzero(code < 0)
        flat, at = self._joined([pieces[i] for i in new])
        old = len(self.begin) - 1
        code[new] = old + np.arange(len(new))
        all_ids = np.concatenate([self.ids, flat])
        begin = np.concatenate([self.begin, self.begin[-1] + at[1:]])
        room = min(len(new), REMEMBERED - old)
        if room > 0:
            self.known.update((pieces[i], old + k) for k, i in enumerate(new[:room]))
            self.begin = begin[: old + room + 1].copy()
            self.ids = all_ids[: self.begin[-1]].copy()
        sizes = np.diff(begin)[code]
        out = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(sizes, out=out[1:])
        return all_ids[_ranges(begin[code], sizes)], out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        safe = ~unsafe
        parts = []  # (text number, ids, starts)
        lengths = np.zeros(len(texts), np.int64)
        if unsafe.any():
            where = np.flatnonzero(unsafe)
            flat_u, at_u = self._raw(texts.take(pa.array(where)).to_pylist())
            lengths[where] = np.diff(at_u)
            parts.append((where, flat_u, at_u))
        if safe.any():
            where = np.flatnonzero(safe)
            flat_s, at_s = self._pieces(texts.take(pa.array(where)) if unsafe.any() else texts)
            lengths[where] = np.diff(at_s)
            parts.append((where, flat_s, at_s))
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        if len(parts) == 1:
            return parts[0][1], at
        out = np.zeros(int(at[-1]), np.uint32)
        for where, flat, begin in parts:
            out[_ranges(at[where], np.diff(begin))] = flat
        return out, at

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        offsets = np.asarray(pieces.offsets).astype(np.int64)
        offsets -= offsets[0]
        code = pc.dictionary_encode(pieces.flatten())
        del pieces
        index = code.indices.to_numpy(zero_copy_only=False).copy()
        words = code.dictionary.to_pylist()
        del code
        firsts = np.unique(index[offsets[:-1]])
        # A text's first piece has no space before it, all others have one.
        flat_f, at_f = self._raw([words[i] for i in firsts])
        index[offsets[:-1]] = np.searchsorted(firsts, index[offsets[:-1]]) + len(words)
        flat, at = self._of([" " + w for w in words])
        del words
        flat, at = np.concatenate([flat, flat_f]), np.concatenate([at, at[-1] + at_f[1:]])
        sizes = np.diff(at).astype(np.int32)[index]
        begin = np.zeros(len(index) + 1, np.int64)
        np.cumsum(sizes, out=begin[1:])
        return flat[_ranges(at[index], sizes)], begin[offsets]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start..start+size-1 of each pair, in a row."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


@functools.cache
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary (a character of a token stands for one byte)."""
    vocab = load(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token.encode()) if token.startswith("<|") else len(token)
    return out


__all__ = ["Encoder", "byte_lengths", "encoder", "load", "token_path"]
