"""WARC archives with an index written first, and coalesced range reads of selected records.

Writing: each task appends records, a gzip member each, to archives of its own in the shared
folder and returns an index row for each: file, offset, length, URL and payload digest. The index is a
written table before anything is read, and names only archives of tasks that ended well; what a lost
task left behind is never referred to. Of equal payloads of at least REVISIT_BYTES, the one with the
largest page_id is a response and the others are revisits of it; smaller payloads are always responses.

Reading: index rows are selected with DataFrame operations, sorted by file and offset, and each
task joins neighbouring ranges (gaps of GAP bytes at most, RUN bytes at most) into one read. Records are inflated one by
one, and rows go on whenever HELD bytes of payloads have come together, or without payloads if none are asked for.

Null html is empty. A null url leaves out the target URI. A null page_id never is the largest; where
all are null, all are responses. Rows that repeat a page_id with the same payload are responses
alike if it is the largest. An empty table writes nothing. Other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.storage import fresh_path, materialize, partitions

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
GAP, RUN, HELD = 64 << 10, 8 << 20, 16 << 20
DATE = "2026-01-01T00:00:00Z"
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _filesystem(uri: str):
    """pyarrow's file system of a folder, and the folder's path in it; Hadoop writes file:/ with one slash."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, compressed to a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if revisit else http + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~-._"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """The fields of a record; for a revisit the payload is None and its length comes from the HTTP header."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page to archives in `folder` and return the index, a written table."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    d = d.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # One row per payload that repeats, after partial aggregation; a written table, so that the join can be split where a payload is very common.
    same = d.where(F.octet_length("html") >= REVISIT_BYTES).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.where("n > 1").select("of", "first_id"), "warc-copies")
    d = d.join(same, (F.col("digest") == F.col("of")) & (F.octet_length("html") >= REVISIT_BYTES), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    d = d.select("page_id", "url", "html", "digest", "first_id", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            columns = [b.column(0), b.column(1), b.column(2).cast(pa.binary()), b.column(3), b.column(4), b.column(5)]
            for page_id, url, body, digest, first, again in zip(*(c.to_pylist() for c in columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                raw = record(page_id, url, body, digest, first, again)
                out.write(raw)
                rows.append((page_id, name, at, len(raw), url, digest, "revisit" if again else "response"))
                at += len(raw)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _INDEX.split(", ")])
        if out:
            out.close()

    index = materialize(d.mapInArrow(run, _INDEX), "warc-index")
    index._varloom_warc = folder
    return index


def read(selected: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the selected index rows, by sorted and coalesced byte ranges; payload: whether to return it (it is checked anyway)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        name, stream = None, None

        def load(held: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal name, stream
            if held[0][0] != name:
                if stream:
                    stream.close()
                name, stream = held[0][0], files.open_input_file(f"{root}/{held[0][0]}")
            first, last = held[0][1], max(o + n for _, o, n in held)
            raw = memoryview(stream.read_at(last - first, first))
            rows, size = [], 0
            for _, o, n in held:
                row = parse(raw[o - first : o - first + n])
                if not payload:
                    row["payload"] = None
                rows.append(row)
                size += len(row["payload"] or b"")
                if size >= HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

        held: list[tuple[str, int, int]] = []
        for b in batches:
            for place in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (place[0] != held[0][0] or place[1] - held[-1][1] - held[-1][2] > GAP or place[1] + place[2] - held[0][1] > RUN):
                    yield from load(held)
                    held = []
                held.append(place)
        if held:
            yield from load(held)

    places = selected.select("file", "offset", "length").repartition(partitions(selected.sparkSession, selected), "file").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, _RECORD)
