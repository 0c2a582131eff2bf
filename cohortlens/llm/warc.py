"""WARC archives: writing pages as segmented, chunked records and reading them back.

A page is an HTTP response with chunked transfer framing.  Blocks longer than
SEGMENT bytes are cut into a first record and continuation records.  A page with
the same payload as another becomes a revisit record without a payload.  Files
are written by Spark's text writer: CR LF CR LF between lines is just what ends
a record, and gzip is applied by file.  The reader takes whole files, walks
their records by Content-Length, groups segments by origin identifier, orders
them by number, verifies the total length and undoes the chunked framing.

Contract.  Null html is empty, a null url is urn:page:<page_id>.  Of equal
payloads of at least LEAST bytes every row with the smallest page_id is a
response (so repeated rows are all responses if theirs is smallest), others are
revisits of it; null page_ids are never referred to unless all are null.  Rows
are kept as they are, repeated or not; extra columns are not read.  Files hold
PER_FILE records at most, about 250 MB, and are read one at a time in a task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import matched, shared_dir, written

#: Bytes of a segment's block, of a chunk, and of a payload that a revisit may stand for.
SEGMENT, CHUNK, LEAST = 32 << 10, 8 << 10, 100
#: Records of an archive: of SEGMENT bytes at most and little more, so that a file stays well below a row's limit.
PER_FILE = 8_000
END = "\r\n"
RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, origin string, number int, total long, block binary"


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes that do not break a UTF-8 character."""
    out, at = [], 0
    while len(data) - at > size:
        past = at + size
        while past > at + 1 and data[past] & 0xC0 == 0x80:
            past -= 1
        out.append(data[at:past])
        at = past
    return [*out, data[at:]]


def chunked(payload: bytes) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for x in _cut(payload, CHUNK) if x]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return END.join(head) + block.decode("utf-8")


def records_of(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> list[str]:
    """The records of one page, each without the four bytes that end it."""
    name = _name(page_id)
    origin = f"<urn:page:{name}:{uuid.uuid4().hex}>"
    target = "".join(c if "!" <= c <= "~" else f"%{ord(c):02X}" for c in url or "") or f"urn:page:{name}"
    common = [("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: {len(payload)}\r\n\r\n".encode()
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{_name(refers_to)}>")]
        return [_record(fields, head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = _cut(block, SEGMENT)
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}:{k}>"), common[0], ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k)]
        if k == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(fields, part))
    return out


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write pages (page_id, url, html) as .gz archives in folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.col("page_id").alias("order_id"))
    ids = pages.select("page_id", html.alias("html")).where(F.octet_length("html") >= LEAST).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    # Counts before the shuffle, so that equal payloads meet as one row per task.
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = matched(base, written(first), ["digest"], "copies", "left").select("page_id", "url", "html", "digest", F.when(F.col("order_id") != F.col("first_id"), F.col("first_id").cast("string")).when(F.col("order_id").isNull(), F.col("first_id").cast("string")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")])], names=["value"])
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                out: list[str] = []
                for page_id, url, text, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out += records_of(page_id, url, text.encode(), digest, refers_to)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(write, "value string").write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(folder)


def parse(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive."""
    if blob[:2] == b"\x1f\x8b":
        out = []
        while blob:
            d = zlib.decompressobj(31)
            out.append(d.decompress(blob) + d.flush())
            blob = d.unused_data
        blob = b"".join(out)
    at = 0
    while at < len(blob):
        end = blob.index(b"\r\n\r\n", at)
        lines = blob[at:end].decode("utf-8").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        past = end + 4 + int(fields["content-length"])
        if blob[past : past + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's block does not end at byte {past}")
        yield fields, blob[end + 4 : past]
        at = past + 4


def _name(page_id: object) -> str:
    """A page_id as part of a URN; null is told apart from any text."""
    return "null" if page_id is None else "id-" + quote(str(page_id), safe="")


def _page(origin: str) -> str | None:
    name = origin.strip("<>").split(":")[2]
    return None if name == "null" else unquote(name[3:])


def _finished(origin: str, fields: dict, block: bytes) -> tuple:
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        length = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"x-payload-length:"))
        return (_page(origin), length, digest, "revisit", _page(fields["warc-refers-to"]), origin, None, None, None)
    payload = payload_of(block)
    if (own := hashlib.sha256(payload).hexdigest()) != digest:
        raise ValueError(f"payload digest of {origin} is wrong")
    return (_page(origin), len(payload), own, "response", None, origin, None, None, None)


_SCHEMA = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page of the archives in folder: page_id (text), payload_bytes, payload_digest, record_type, refers_to."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                rows: list[tuple] = []
                for fields, block in parse(batch.column(0)[k].as_py()):
                    kind, own = fields["warc-type"], fields["warc-record-id"]
                    if kind == "continuation":
                        rows.append((None, None, None, kind, None, fields["warc-segment-origin-id"], int(fields["warc-segment-number"]), int(fields.get("warc-segment-total-length", -1)), block))
                    elif "warc-segment-number" in fields:
                        rows.append((None, None, fields["warc-payload-digest"], kind, None, own, 1, -1, block))
                    elif kind in ("response", "revisit"):
                        rows.append(_finished(own, fields, block))
                    if len(rows) >= 1000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    records = files.mapInArrow(split, RECORDS)
    # A segmented record has few segments, and every other origin is a single row.
    one = [F.max(c).alias(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
    parts = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "total", "block")))
    grouped = records.groupBy("origin").agg(*one, F.array_sort(parts).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            for a in range(0, len(batch), 2000):
                rows = []
                for r in batch.slice(a, 2000).to_pylist():
                    if not r["parts"]:
                        rows.append(tuple(r.get(f.name) if f.name in at else None for f in _SCHEMA))
                        continue
                    numbers, block = [x["number"] for x in r["parts"]], b"".join(x["block"] for x in r["parts"])
                    if numbers != list(range(1, len(numbers) + 1)) or r["parts"][-1]["total"] != len(block):
                        raise ValueError(f"segments of {r['origin']} are missing")
                    rows.append(_finished(r["origin"], {"warc-type": "response", "warc-payload-digest": r["payload_digest"]}, block))
                yield _batch(rows)

    return grouped.mapInArrow(join, RECORDS).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives and read them back; page_id and refers_to as in pages."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/archives"
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, folder).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
