"""Lines and multi-line records of text files in splits, compressed files included, as a Python data source.

What a file is follows from its first bytes, not its name: plain text, blocked gzip (BGZF), gzip, bzip2 or compress (.Z). Plain
and blocked files are cut into byte ranges of `split_bytes`, blocked ones at the block that follows; the others are a split of
their own and are inflated as a stream. A range has the lines that begin after its start and at its end at the latest (the first
one also that at 0), so a line that crosses a boundary is read by the split in which it begins.

Each line has a place `pos` that orders the lines of a file: its byte offset in a plain file, its virtual offset in a
blocked one (block offset << 16 | offset in the block), its offset in the inflated text of other ones.

Records are runs of lines. A split has the records that begin after a line at which reading may start anew (an end line, or a start
line where the format has no end lines), so a record that crosses a boundary is read whole by the split where it
begins. Memory holds a chunk of the file and one record.

Files are listed by Hadoop, as Spark's own readers do, and opened by pyarrow's file systems (local, S3, GCS, HDFS). Bytes that
aren't UTF-8 become replacement characters; \\r before \\n is dropped.
"""

from __future__ import annotations

import bz2
import contextlib
import json
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 128 << 20
CHUNK, CUT = 1 << 20, 64 << 10
#: Bytes and rows of one batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 10_000
#: A blocked gzip member's header up to its extra fields.
_MAGIC = b"\x1f\x8b\x08\x04"
SEGMENT = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("name", pa.string()), *((c, pa.int64()) for c in ("offset", "bases", "rows", "longest", "inner", "final", "at"))])
TAIL = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("name", pa.string()), ("bases", pa.int64()), ("after", pa.int64())])


def opened(uri: str):
    """A file to read; Hadoop writes file:/ with one slash."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return files.open_input_file(path)


def kind_of(head: bytes) -> str:
    """plain, bgzf, gzip, bzip2 or compress, by a file's first bytes."""
    if head[:4] == _MAGIC and _block_size(head, 0):
        return "bgzf"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:3] == b"BZh":
        return "bzip2"
    return "compress" if head[:2] == b"\x1f\x9d" else "plain"


def _block_size(data: bytes, at: int) -> int:
    """Bytes of the blocked gzip member that begins at data[at], 0 if none does."""
    if data[at : at + 4] != _MAGIC or at + 18 > len(data):
        return 0
    extra = int.from_bytes(data[at + 10 : at + 12], "little")
    i, end = at + 12, at + 12 + extra
    while i + 4 <= min(end, len(data)):
        size = int.from_bytes(data[i + 2 : i + 4], "little")
        if data[i : i + 2] == b"BC" and size == 2:
            return int.from_bytes(data[i + 4 : i + 6], "little") + 1
        i += 4 + size
    return 0


def next_block(f, at: int, size: int) -> int:
    """Offset of the first block at `at` or later: a header whose block ends at the next one's, or at the file's end. `size` if none."""
    f.seek(at)
    data = f.read(3 << 16)
    found = data.find(_MAGIC)
    while found >= 0:
        length = _block_size(data, found)
        after = found + length
        if length and (at + after == size or _block_size(data, after)):
            return at + found
        found = data.find(_MAGIC, found + 1)
    return size


def _plain(f, at: int) -> Iterator[tuple[int, bytes]]:
    f.seek(at)
    while data := f.read(CHUNK):
        yield at, data
        at += len(data)


def _blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, text) of each block from the one at `at` on."""
    f.seek(at)
    data = f.read(CHUNK)
    i = 0
    while True:
        if len(data) - i < 1 << 16:
            data = data[i:] + f.read(CHUNK)
            at, i = at + i, 0
        if i >= len(data):
            return
        length = _block_size(data, i)
        if not length or i + length > len(data):
            raise ValueError(f"no whole block at offset {at + i}")
        head = 12 + int.from_bytes(data[i + 10 : i + 12], "little")
        text = zlib.decompress(data[i + head : i + length - 8], -15)
        if zlib.crc32(text) != int.from_bytes(data[i + length - 8 : i + length - 4], "little"):
            raise ValueError(f"damaged block at offset {at + i}")
        if text:
            yield (at + i) << 16, text
        i += length


def _stream(f, make) -> Iterator[tuple[int, bytes]]:
    """Inflated chunks of concatenated members."""
    at, inflate, raw = 0, make(), b""
    while raw := raw or f.read(CHUNK):
        text = inflate.decompress(raw)
        raw = b""
        if inflate.eof:
            raw, inflate = inflate.unused_data, make()
        if text:
            yield at, text
            at += len(text)


def uncompressed(data: Iterator[bytes]) -> Iterator[bytes]:
    """Text of a .Z file: LZW with codes of 9 bits up to the header's maximum, packed in groups of eight codes of one width."""
    raw = bytearray()
    for part in data:  # header
        raw += part
        if len(raw) >= 3:
            break
    widest, resets = raw[2] & 31, bool(raw[2] & 128)
    del raw[:3]
    table = [bytes([i]) for i in range(256)] + ([b""] if resets else [])
    first, width, former, out = len(table), 9, b"", bytearray()
    group: list[int] = []
    ended = False
    while True:
        if not group:
            while len(raw) < width and not ended:
                more = next(data, None)
                ended = more is None
                raw += more or b""
            bits, take = int.from_bytes(raw[:width], "little"), min(width, len(raw))
            group = [bits >> (width * k) & ((1 << width) - 1) for k in range(take * 8 // width)][::-1]
            del raw[:take]
            if not group:
                break
        code = group.pop()
        if resets and code == 256:
            del table[first:]
            width, former, group = 9, b"", []  # the rest of the group is padding
            continue
        entry = table[code] if code < len(table) else former + former[:1]
        out += entry
        if former and len(table) < 1 << widest:
            table.append(former + entry[:1])
            if len(table) == 1 << width and width < widest:
                width, group = width + 1, []
        former = entry
        if len(out) >= CHUNK:
            yield bytes(out)
            out.clear()
    if out:
        yield bytes(out)


def _compress(f) -> Iterator[tuple[int, bytes]]:
    at = 0
    for text in uncompressed(iter(lambda: f.read(CHUNK) or None, None)):
        yield at, text
        at += len(text)


def lines_of(chunks: Iterator[tuple[int, bytes]], skip: bool, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(pos, line) of chunks; skip: leave out what is before the first line end. Lines that begin after `end` stay out."""
    start, parts = None, []
    for base, data in chunks:
        at = 0
        if skip:
            at = data.find(b"\n") + 1
            if not at:
                continue
            skip = False
        while at < len(data):
            if start is None:
                start = base + at
                if end is not None and start > end:
                    return
            stop = data.find(b"\n", at)
            if stop < 0:
                parts.append(data[at:])
                break
            line = b"".join([*parts, data[at:stop]]) if parts else data[at:stop]
            yield start, line[:-1] if line.endswith(b"\r") else line
            start, parts, at = None, [], stop + 1
    if start is not None:
        line = b"".join(parts)
        yield start, line[:-1] if line.endswith(b"\r") else line


def named(header: bytes) -> str:
    """The name in a FASTA header: its first word."""
    words = header[1:].split()
    return words[0].decode("utf-8", "replace") if words else ""


def tail_of(lines: Iterator[tuple[int, bytes]], last: int | None) -> dict:
    """What a split of a FASTA file leaves to the next one: its bases, the name in its last header (None: it has no header) and the bases after that."""
    out = {"name": None, "bases": 0, "after": 0}
    for pos, line in lines:
        if last is not None and pos > last:
            break
        if line.startswith(b">"):
            out["name"], out["after"] = named(line), 0
        else:
            out["bases"] += len(line)
            out["after"] += len(line)
    return out


def chunks_of(lines: Iterator[tuple[int, bytes]], last: int | None, name: str | None, at: int, size: int) -> Iterator[tuple[str, int, bytes]]:
    """(name, number, bases) of the chunks of sequences that begin in a split; name, at: the sequence that comes in from earlier splits and its bases by then.

    The chunk that goes over the split's end is read to its own end, so a task holds one chunk, a line and CUT bytes.
    """
    number, skip, held = -(-at // size), -at % size, bytearray()

    def cut(rest: bool) -> Iterator[tuple[str, int, bytes]]:
        """The whole chunks of what is held, and the rest of it where the sequence ends."""
        nonlocal number
        end = len(held) if rest else len(held) - len(held) % size
        for i in range(0, end, size):
            yield name, number, bytes(held[i : min(i + size, end)])
            number += 1
        del held[:end]

    for pos, line in lines:
        past = last is not None and pos > last
        if past:
            yield from cut(False)
            if not held:
                return
        if line.startswith(b">"):
            yield from cut(True)
            if past:
                return
            name, number, skip = named(line), 0, 0
        elif name is not None:  # no lines before any header
            line, skip = line[skip:], max(0, skip - len(line))
            held += line[: size - len(held)] if past else line
            if len(held) >= max(size, CUT):
                yield from cut(False)
    yield from cut(True)


def segments_of(lines: Iterator[tuple[int, bytes]], last: int | None) -> Iterator[dict]:
    """What a split has of each sequence of a FASTA file: its name (None: it began in an earlier split) and the shape of its lines."""
    one: dict | None = None
    for pos, line in lines:
        if last is not None and pos > last:
            break
        if line.startswith(b">"):
            if one:
                yield one
            one = {"pos": pos, "name": named(line), "offset": None, "bases": 0, "rows": 0, "longest": 0, "inner": None, "final": None, "at": None}
            continue
        one = one or {"pos": pos, "name": None, "offset": None, "bases": 0, "rows": 0, "longest": 0, "inner": None, "final": None, "at": None}
        n = len(line)
        if one["rows"]:
            one["inner"] = one["final"] if one["inner"] is None else min(one["inner"], one["final"])
        else:
            one["offset"] = pos
        one["bases"] += n
        one["rows"] += 1
        one["longest"], one["final"], one["at"] = max(one["longest"], n), n, pos
    if one:
        yield one


@dataclass
class Split(InputPartition):
    """Bytes [start, end) of a file; end is None for the whole of it."""

    file: str
    start: int = 0
    end: int | None = None


def split_lines(split: Split) -> tuple[Iterator[tuple[int, bytes]], int | None]:
    """Lines from the split's first on, without an end, and the pos after which they belong to other splits."""
    f = opened(split.file)
    kind, size = kind_of(f.read(64)), f.size()
    f.seek(0)
    if kind == "plain":
        return lines_of(_plain(f, split.start), split.start > 0), split.end
    if kind == "bgzf":
        first = next_block(f, split.start, size) if split.start else 0
        last = next_block(f, split.end, size) if split.end is not None else None
        return (lines_of(_blocks(f, first), split.start > 0) if first < size else iter(())), None if last is None else last << 16
    stream = {"gzip": lambda: _stream(f, lambda: zlib.decompressobj(31)), "bzip2": lambda: _stream(f, bz2.BZ2Decompressor), "compress": lambda: _compress(f)}[kind]()
    return lines_of(stream, False), None


def records_of(lines: Iterator[tuple[int, bytes]], first: bool, last: int | None, start: str | None, end: str | None, size: int | None) -> Iterator[tuple[int, list[bytes]]]:
    """(pos, lines) of the records that a split has: see the module. size: lines of a record, for formats without marks in their lines."""
    if size:
        yield from _fixed(lines, first, last, start, size)
        return
    opens = re.compile(start.encode()).search if start else None
    closes = re.compile(end.encode()).search if end else None
    at, held, synced = 0, [], first
    for pos, line in lines:
        closing = closes is not None and closes(line) is not None
        opening = not closing if opens is None else opens(line) is not None
        if not closes:
            if opening:
                if held:
                    yield at, held
                    held = []
                if last is not None and pos > last:
                    return
                at, held = pos, [line]
            elif held:
                held.append(line)
            continue
        if held and opening and opens and not closing:  # the former one has no end
            yield at, held
            at, held = pos, [line]
        elif held:
            held.append(line)
        elif synced and opening:
            at, held = pos, [line]
        if closing:
            if held:
                yield at, held
                held = []
            if last is not None and pos > last:
                return
            synced = True
    if held:
        yield at, held


def _fixed(lines: Iterator[tuple[int, bytes]], first: bool, last: int | None, start: str, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Four-line records: after a boundary reading starts at the first line that `start` matches two lines before one with +."""
    opens = re.compile(start.encode()).match
    held: list[tuple[int, bytes]] = []
    synced = first
    for entry in lines:
        held.append(entry)
        if not synced and len(held) == 3:
            if opens(held[0][1]) and held[2][1].startswith(b"+"):
                synced = True
            else:
                held.pop(0)
        if synced and held and last is not None and held[0][0] > last:
            return
        if synced and len(held) == size:
            yield held[0][0], [x for _, x in held]
            held = []


def _strings(values: list[bytes]) -> pa.Array:
    raw = pa.array(values, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [(u, int(n)) for u, n in json.loads(options["files"])]
        self.size = int(options["splitbytes"])
        self.format = json.loads(options["format"]) if options.get("format") else None
        self.segments, self.tails = bool(options.get("segments")), bool(options.get("tails"))

    def partitions(self) -> list[Split]:
        out = []
        for uri, size in self.files:
            if size > self.size:
                with opened(uri) as f:
                    whole = kind_of(f.read(64)) not in ("plain", "bgzf")
                if not whole:
                    starts = range(0, size, self.size)
                    out += [Split(uri, s, s + self.size if s + self.size < size else None) for s in starts]
                    continue
            if size:
                out.append(Split(uri))
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        lines, last = split_lines(split)
        if self.tails:
            yield pa.RecordBatch.from_pylist([{"file": split.file, "start": split.start, "stop": split.end, **tail_of(lines, last)}], TAIL)
            return
        if self.segments:
            found = segments_of(lines, last)
            while some := [{"file": split.file, **s} for s in islice(found, BATCH_ROWS)]:
                yield pa.RecordBatch.from_pylist(some, SEGMENT)
            return
        rows: list[tuple[int, object]] = []
        held = 0
        found = records_of(lines, not split.start, last, *self.format) if self.format else lines
        for pos, value in found:
            if not self.format and last is not None and pos > last:
                break
            rows.append((pos, value))
            held += len(value) if not self.format else sum(map(len, value)) + 8
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self._batch(split.file, rows)
                rows, held = [], 0
        if rows:
            yield self._batch(split.file, rows)

    def _batch(self, file: str, rows: list) -> pa.RecordBatch:
        pos, names = pa.array([p for p, _ in rows], pa.int64()), pa.array([file] * len(rows), pa.string())
        if not self.format:
            return pa.RecordBatch.from_arrays([names, pos, _strings([v for _, v in rows])], names=["file", "pos", "value"])
        ends = [0]
        for _, v in rows:
            ends.append(ends[-1] + len(v))
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _strings([x for _, v in rows for x in v]))
        return pa.RecordBatch.from_arrays([names, pos, values], names=["file", "pos", "lines"])


class TextSplits(DataSource):
    """The data source behind lines() and records()."""

    @classmethod
    def name(cls) -> str:
        return "varloom_text"

    def schema(self) -> str:
        if self.options.get("tails"):
            return "file string, start long, stop long, name string, bases long, after long"
        if self.options.get("segments"):
            return "file string, pos long, name string, offset long, bases long, rows long, longest long, inner long, final long, at long"
        return "file string, pos long, lines array<string>" if self.options.get("format") else "file string, pos long, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def listed_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(uri, size) of the files that a path, folder or pattern names; hidden ones are left out."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    out: list[tuple[str, int]] = []

    def walk(entries) -> None:
        for e in entries or []:
            p = e.getPath()
            if p.getName()[:1] in ("_", "."):
                continue
            if e.isDirectory():
                walk(files.listStatus(p))
            else:
                out.append((p.toString(), e.getLen()))

    walk(files.globStatus(place))
    if not out and not files.exists(place):
        raise FileNotFoundError(path)
    return sorted(out)


def kinds(files: list[tuple[str, int]]) -> set[str]:
    def one(entry: tuple[str, int]) -> str:
        with opened(entry[0]) as f:
            return kind_of(f.read(64))

    if not files:
        return set()
    with ThreadPool(min(32, len(files))) as pool:
        return set(pool.map(one, files))


@contextlib.contextmanager
def travelling(module):
    """Functions and classes of a module travel with the plan, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def _loaded(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int, **mode: str) -> DataFrame:
    with travelling(sys.modules[__name__]):
        spark.dataSource.register(TextSplits)
    reader = spark.read.format(TextSplits.name()).option("files", json.dumps(files)).option("splitBytes", str(split_bytes))
    return reader.options(**mode).load()


def lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, pos, value), a row for each line."""
    return _loaded(spark, listed_files(spark, path), split_bytes)


def records(spark: SparkSession, path: str, start: str | None, end: str | None = None, size: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, pos, lines) of multi-line records: a line that matches `start` (any, if None) opens one, `end` (or the next start) closes it; or `size` lines each."""
    return _loaded(spark, listed_files(spark, path), split_bytes, format=json.dumps((start, end, size)))


def segments(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of segments_of() of FASTA files."""
    return _loaded(spark, listed_files(spark, path), split_bytes, segments="1")


def tails(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each split of FASTA files, with what tail_of() tells of it."""
    return _loaded(spark, listed_files(spark, path), split_bytes, tails="1")


#: Text of one block at most: its size has to fit 16 bits, compressed or not.
BLOCK_TEXT = 65_280
_LAST = _MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0\x1b\0\x03\0\0\0\0\0\0\0\0\0"


def block(text: bytes, level: int = 6) -> bytes:
    """A blocked gzip member of up to BLOCK_TEXT bytes."""
    for attempt in (level, 0):  # what can't be compressed is stored
        z = zlib.compressobj(attempt, zlib.DEFLATED, -15)
        body = z.compress(text) + z.flush()
        if len(body) + 26 <= 1 << 16:
            break
    size = (len(body) + 25).to_bytes(2, "little")
    return _MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + size + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def write_blocked(d: DataFrame, path: str, value: str = "value", block_text: int = BLOCK_TEXT, suffix: str = ".gz") -> DataFrame:
    """Write lines as blocked gzip files, one for each partition, in the partition's order; (file, lines) of what was written, a written table.

    A task that runs again writes another file, and the files of rows that come back are moved to `path` in the end: what lost tasks left is never read.
    """
    from varloom.storage import materialize

    target = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", target))
        out, name, n, text = None, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{suffix}", 0, bytearray()
        for b in batches:
            for v in b.column(0).cast(pa.binary()).to_pylist():
                text += (v or b"") + b"\n"
                n += 1
            if out is None and n:
                files.create_dir(f"{root}/_tmp", recursive=True)
                out = files.open_output_stream(f"{root}/_tmp/{name}", compression=None)
            while len(text) >= block_text:
                out.write(block(bytes(text[:block_text])))
                del text[:block_text]
        if out:
            out.write((block(bytes(text)) if text else b"") + _LAST)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "lines"])

    with travelling(sys.modules[__name__]):
        done = materialize(d.select(value).mapInArrow(write, "file string, lines long"), "blocked-files")
    jvm, conf = d.sparkSession._jvm, d.sparkSession.sparkContext._jsc.hadoopConfiguration()
    place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
    files = place("_tmp").getFileSystem(conf)
    for r in done.select("file").collect():
        files.rename(place(f"_tmp/{r['file']}"), place(r["file"]))
    files.delete(place("_tmp"), True)
    return done


def head(spark: SparkSession, path: str, mark: str = "#") -> list[str]:
    """The lines that begin with `mark` at the head of the first file that has some."""
    for uri, size in listed_files(spark, path):
        out = []
        for _, line in split_lines(Split(uri))[0] if size else ():
            text = line.decode("utf-8", "replace")
            if not text.startswith(mark):
                break
            out.append(text)
        if out:
            return out
    return []
