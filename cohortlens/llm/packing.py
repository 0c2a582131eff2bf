"""Sum-of-squares packing of token pieces into sequences of a fixed length.

For every residual gap the packer knows how many open bins have it.  A piece
goes where the sum of the squares of these counts becomes smallest, by the
largest pieces first, ties to the smallest gap.  A new bin is opened only if no
open bin has room, since the aim is few sequences.  Full pieces are sequences of
their own.  The others are dealt by hash to shards of about PER_SHARD pieces,
each packed by itself: a shard loses about its last bin.

Contract.  Null texts are empty; an empty document is its end id alone.  Every
document, equal rows included, is packed; documents with more tokens than a
sequence holds are cut into full pieces and a rest.  Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._text import slices
from ._tokens import encoder

#: Pieces of a shard.
PER_SHARD = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of at most size ids of each document with its end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, 12 << 20):
                ids, at = encoder(tokenizer).encode(texts[a:b])
                row, piece, start, length, crc = [], [], [], [], []
                for k in range(b - a):
                    own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                    for p in range(0, len(own), size):
                        part = own[p : p + size]
                        row.append(a + k), piece.append(p // size), start.append(p), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                number = batch.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([number, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, 1 to size, placed largest first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)  # open bins by residual gap
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    opened = 0
    for k in np.argsort(-lengths, kind="stable"):
        s = int(lengths[k])
        here = count[s:size]  # gaps s, s + 1, ..., size - 1
        gap = size
        if s < size and here.any():
            # Half the change of the sum when a gap g becomes g - s; a gap that closes leaves the sum.
            change = count[: size - s] - here + 1.0
            change[0] = 0.5 - here[0]
            change[here == 0] = np.inf
            gap = s + int(np.argmin(change))
        if gap == size:
            which, opened = opened, opened + 1
        else:
            which = open_bins[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = which, size - gap
        if gap > s:
            open_bins[gap - s].append(which)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, size: int, shards: int) -> DataFrame:
    """A table of pieces with sequence_id and offset; sequences of full pieces have numbers below zero."""

    def of_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), size)
        return rows.drop(columns="shard").assign(sequence_id=bins + (int(key[0]) << 40), offset=offsets)

    place = F.monotonically_increasing_id()
    # Equal rows are spread, too: pieces is a table, so that a row's place stays.
    dealt = pieces.where(F.col("length") < size).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", place), F.lit(shards)))
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": -1 - place, "offset": F.lit(0).cast("long")})
    return dealt.groupBy("shard").applyInPandas(of_shard, PACKED).unionByName(full)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, per_shard: int = PER_SHARD) -> DataFrame:
    """Documents as pieces with their places in sequences."""
    pieces = written(token_pieces(docs, tokenizer, end_id, size))
    shards = max(1, -(-pieces.where(F.col("length") < size).count() // per_shard))
    return pack(pieces, size, shards)
