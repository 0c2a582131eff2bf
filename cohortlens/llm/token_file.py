"""Token files with directly addressable codes.

An id is cut into chunks of CHUNK bits, least significant first.  Level k of a
file holds chunk k of every id that has one; a bitmap beside it says which ids
go on to level k + 1, and a rank directory over that bitmap says where.  Any id
is read with one look per level, without decoding a block.

Contract.  Null texts are empty; an empty text is its end id alone.  Documents
are in ascending (doc_id, hash of the text) order, nulls first; equal rows are
kept, each with its own tokens.  Other columns are not read.  An empty table
gives no files and no rows.  Memory of a task follows one shard, of which there
are as many as keep a shard's texts at about SHARD_BYTES, but no fewer than
spark.sql.shuffle.partitions, unless n_shards says otherwise.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import filesystem, shared_dir
from ._text import slices
from ._tokens import encoder

MAGIC, CHUNK, BLOCK = b"DACT", 8, 512
#: Bytes of text of a shard.
SHARD_BYTES = 64 << 20
_HEAD = struct.Struct("<4sIQQ")
SHARDS = "shard int, path string, n_docs long, n_tokens long"


def pack(ids: np.ndarray) -> list[bytes]:
    """The levels of ids: for each its length, chunks, bitmap and rank directory."""
    out, left = [], ids.astype(np.uint32)
    while len(left):
        more = left >> np.uint32(CHUNK)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        sums = np.add.reduceat(goes_on.astype(np.int64), np.arange(0, len(left), BLOCK))
        rank = np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u8")
        chunks = (left & np.uint32((1 << CHUNK) - 1)).astype(np.uint8)
        out.append(struct.pack("<Q", len(left)) + chunks.tobytes() + bits.tobytes() + rank.tobytes())
        left = more[goes_on]
    return out


def encode_file(doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids))
    return b"".join([head, known.tobytes(), numbers.tobytes(), starts.astype("<u8").tobytes(), *levels])


class TokenFile:
    """A token file in memory: documents and random access to ids."""

    def __init__(self, blob: bytes):
        magic, levels, self.n_docs, self.n_tokens = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.known, self.doc_ids, self.starts = take("u1", self.n_docs), take("<i8", self.n_docs), take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u8", -(-n // BLOCK))))

    def get(self, where: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        out, place, rows = np.zeros(len(where), np.uint32), np.asarray(where, np.int64), np.arange(len(where))
        for k, (chunks, bits, rank) in enumerate(self.levels):
            out[rows] |= chunks[place].astype(np.uint32) << np.uint32(CHUNK * k)
            goes_on = (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            rows, place = rows[goes_on], place[goes_on]
            if not len(rows):
                break
            place = rank[place // BLOCK].astype(np.int64) + _ones_before(bits, place)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.get(np.arange(self.starts[k], self.starts[k + 1]))


_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def _ones_before(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Set bits of a place's block before it."""
    first, last = (place // BLOCK) * (BLOCK // 8), place >> 3
    # Counting from the first byte that is asked for, in one sweep over the bytes between.
    low, high = int(first.min()), int(last.max())
    sums = np.concatenate([[0], np.cumsum(_ONES[bits[low : high + 1]])])
    part = _ONES[bits[last] & ((1 << (place & 7)) - 1).astype(np.uint8)]
    return sums[last - low] - sums[first - low] + part


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Write docs as one token file per shard; returns a row (SHARDS) for each, in document order.

    What the driver gets is one small row per shard.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n = n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, doc_ids, parts, sizes = encoder(tokenizer).encode, [], [], []
        for batch in batches:
            texts = batch.column(1)
            doc_ids += batch.column(0).to_pylist()
            for a, b in slices(texts, 12 << 20):
                ids, at = encode(texts[a:b])
                ends = at[1:] + np.arange(1, b - a + 1)
                own = np.full(int(ends[-1]), end_id, np.uint32)
                inside = np.ones(len(own), bool)
                inside[ends - 1] = False
                own[inside] = ids
                parts.append(own.astype(np.uint16) if own.max() < 1 << 16 else own)
                sizes.append(np.diff(np.concatenate([[0], ends])))
        if not doc_ids:
            return
        shard = TaskContext.get().partitionId()
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        path = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex[:8]}.dact"
        system, name = filesystem(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as out:
            out.write(encode_file(doc_ids, starts, np.concatenate(parts)))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": len(doc_ids), "n_tokens": int(starts[-1])}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return sorted(rows.mapInArrow(write, SHARDS).collect(), key=lambda r: r["shard"])


def read_token_files(spark: SparkSession, shards: list) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], out)
    base, rows = 0, []
    for r in shards:
        rows.append((r["path"], base))
        base += r["n_tokens"]
    files = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = filesystem(path)
                with system.open_input_file(name) as f:
                    file = TokenFile(f.read())
                crc = np.zeros(file.n_docs, np.int64)
                first = 0
                while first < file.n_docs:  # about a million ids at a time
                    past = max(first + 1, int(np.searchsorted(file.starts, file.starts[first] + (1 << 20), "right")) - 1)
                    past = min(past, file.n_docs)
                    a = file.starts[first]
                    blob = memoryview(file.get(np.arange(a, file.starts[past])).astype("<u4").tobytes())
                    at = (file.starts[first : past + 1] - a) * 4
                    crc[first:past] = [zlib.crc32(blob[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                    first = past
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, mask=file.known == 0), pa.array(file.starts[:-1] + base), pa.array(np.diff(file.starts)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, out)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, n_shards: int | None = None) -> DataFrame:
    """Write docs as token files and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer, end_id, folder or shared_dir(spark), n_shards))
