"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often each pair does so in the corpus.

A text, with a space before it, is encoded by a byte-level BPE (A) and by a SentencePiece BPE (B, which adds the space
itself). Offsets where tokens of both end cut them into groups. A stretch between two neighbouring ends of either kind lies in
one A and one B token: it is one link, and each overlapping pair has exactly one.

Texts are cut into units where neither vocabulary's tokens can reach across: before a single space or line end between
two characters that aren't white space. All that is asked of a text is a sum over its units, or, for the digest, their
strings one after the other; so each block of texts encodes its distinct units only, and a worker keeps what it has met.

Pairs are packed into int64 keys (A << 32 | B):

1. Encoding writes blocks: per document its numbers and its units, and the links of the block's distinct units with their keys and counts.
2. Each partition of blocks sums its keys (np.unique) into partial counts, so that a pair that holds a third of all links comes
   as one row from each partition. These are range-partitioned and sorted by key; each partition sums runs of equal
   keys and writes them as a sorted shard to the shared folder.
3. Blocks look their keys up: shards are memory-mapped (or read, where the shared folder is no local one) and searched by
   np.searchsorted; sums over a document's units follow.

What comes to the driver is bounded by the vocabularies: the highest count of each B id, and a row for each shard.

Null and empty texts, and those whose tokens' bytes differ from the space and the text, have no tokens: zeros and an empty digest.
Repeated rows count as documents of their own, a null doc_id stays, an empty table gives an empty result, other columns
are never looked at. Memory holds one block (BLOCK_BYTES of text or one longer text); a text without a place to cut is one unit.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.text import id_and_text
from varloom.llm.warc import _filesystem
from varloom.storage import discard, fresh_path, materialize, partitions

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 4_000_000
#: Units that a worker keeps between blocks (twice as many at most) and their longest, characters that are encoded as one text, and keys that a partition holds before they are summed.
KEPT_UNITS, KEPT_CHARS, TOGETHER, HELD_KEYS = 100_000, 100, 4096, 4_000_000
#: Keys in one batch of a shard, and partial counts for each shard.
SHARD_BATCH, SHARD_ROWS = 65_536, 2_000_000

_CUT_SPACE, _CUT_BOTH = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"(?<=\S)(?=[ \n]\S)")
_BLOCK = "ids binary, has_ids binary, numbers binary, digests binary, n_units binary, units binary, ends binary, links binary, keys binary, counts binary"


class Vocabularies:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        with open(a_file, encoding="utf-8") as f:
            own = json.load(f)
        entries = own["model"]["vocab"] | {x["content"]: x["id"] for x in own["added_tokens"]}
        # Byte-level entries write bytes that aren't printable Latin-1 as the characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(printable))}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # A unit may begin at a space if no piece has one after something else, at a line end if no piece but its byte has one.
        self.space = next(i for i, p in enumerate(pieces) if p == "▁")
        across = any(re.search("[^▁]▁", p) for p in pieces)
        lines = any("\n" in p for p in pieces)
        self.cut = None if across else _CUT_SPACE if lines else _CUT_BOTH
        self.a_digits, self.b_digits = _digits(len(self.a_bytes)), _digits(len(self.b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in entries], np.int64) for entries in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and B of texts that begin with a space or a line end."""
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        # B puts a space before everything: it stands for a unit's own, and before a line end it goes again.
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return a, [y if t[0] == " " else y[1:] if y[:1] == [self.space] else [] for t, y in zip(texts, b, strict=True)]

    def split(self, text: str) -> list:
        """A non-empty text's units, each without its leading space; one that begins with a line end has none. A first unit that has both is a tuple."""
        if self.cut is _CUT_BOTH and text.split() == text.replace("\n", " ").split(" "):
            return text.replace("\n", " \n").split(" ")
        parts = self.cut.split(" " + text) if self.cut else [" " + text]
        first = (parts[0],) if parts[0][1:2] == "\n" else parts[0][1:]
        return [first, *(p[1:] if p[0] == " " else p for p in parts[1:])]


def _whole(unit: str | tuple) -> str:
    return unit[0] if isinstance(unit, tuple) else unit if unit[:1] == "\n" else " " + unit


def _digits(n: int) -> np.ndarray:
    """By id its decimal digits, zero bytes after them."""
    return np.array([b"%d" % i for i in range(n)], "S7").view(np.uint8).reshape(n, 7)


@functools.lru_cache(maxsize=2)
def vocabularies(a_file: str, b_file: str) -> Vocabularies:
    return Vocabularies(a_file, b_file)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _exact(v: Vocabularies, text: str, a: list[int], b: list[int]) -> bool:
    raw = text.encode()
    return b"".join(map(v.a_bytes.__getitem__, a)) == raw == b"".join(map(v.b_bytes.__getitem__, b))


def align(v: Vocabularies, units: list[str]) -> list[tuple[int, int, int, bytes, bytes] | None]:
    """For each unit n_a, n_b, n_groups, its links as packed int64 and its groups as text; None if its tokens' bytes differ from it.

    Units may follow one another as in a text, so many of them are encoded as one.
    """
    texts, members, size = [], [], 0
    alone = True
    for i, u in enumerate(units):
        joins = v.cut is not None and len(u) > 1 and not u[1].isspace() and not u[-1].isspace() and (u[0] == " " or v.cut is _CUT_BOTH)
        if alone or not joins or size > TOGETHER:
            texts.append([])
            members.append([])
            size = 0
        texts[-1].append(u)
        members[-1].append(i)
        size += len(u)
        alone = not joins
    whole = ["".join(t) for t in texts]
    ids_a, ids_b = v.encode(whole)
    good = [_exact(v, t, x, y) for t, x, y in zip(whole, ids_a, ids_b, strict=True)]
    out: list = [None] * len(units)
    at = [i for m, g in zip(members, good, strict=True) if g for i in m]
    if at:
        flat = [np.fromiter(itertools.chain.from_iterable(x for x, g in zip(ids, good, strict=True) if g), np.int64) for ids in (ids_a, ids_b)]
        _fill(v, out, at, np.array([len(units[i].encode()) for i in at]), *flat)
    for m, g in zip(members, good, strict=True):
        if not g and len(m) > 1:  # some of them differ: each by itself
            for i in m:
                out[i] = align(v, [units[i]])[0]
    return out


def _fill(v: Vocabularies, out: list, at: list[int], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put units' results in their places: `sizes` bytes each, one after the other, covered by tokens a and by tokens b."""
    flags = np.zeros(int(sizes.sum()) + 1, np.uint8)
    flags[np.cumsum(v.a_sizes[a])] |= 1
    flags[np.cumsum(v.b_sizes[b])] |= 2
    ends = np.flatnonzero(flags)
    kind = flags[ends].astype(np.int64)
    # The token that holds the stretch before an end is the one with as many ends of its kind before it.
    own_a, own_b = np.cumsum(kind & 1) - (kind & 1), np.cumsum(kind >> 1) - (kind >> 1)
    links = ((a[own_a] << 32) | b[own_b]).astype("<i8")
    both = kind == 3
    last = np.searchsorted(ends, np.cumsum(sizes), "right")  # a unit's links end where its bytes do
    first = np.r_[0, last[:-1]]
    groups = np.diff(np.cumsum(both)[last - 1], prepend=0)
    tokens_a, tokens_b = own_a[last - 1] + 1, own_b[last - 1] + 1
    # Groups as text: A's tokens, then B's; a token's place is its own number and the tokens of the other kind before it.
    ends_a, ends_b = own_a[both] + 1, own_b[both] + 1
    in_a, in_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    place_a = np.arange(len(a)) + np.repeat(_starts(in_b), in_a)
    place_b = np.arange(len(b)) + np.repeat(ends_a, in_b)
    shown = np.zeros((len(a) + len(b), 8), np.uint8)
    shown[place_a, :7], shown[place_b, :7] = v.a_digits[a], v.b_digits[b]
    shown[:, 7] = ord(",")
    shown[place_a[ends_a - 1], 7] = ord("|")
    shown[place_b[ends_b - 1], 7] = ord(";")
    told = shown[shown > 0].tobytes()
    text_end = np.cumsum((shown > 0).sum(axis=1))[tokens_a + tokens_b - 1]
    packed = links.tobytes()
    n_a, n_b = np.diff(tokens_a, prepend=0), np.diff(tokens_b, prepend=0)
    each = zip(at, n_a.tolist(), n_b.tolist(), groups.tolist(), (8 * first).tolist(), (8 * last).tolist(), np.r_[0, text_end[:-1]].tolist(), (text_end - 1).tolist(), strict=True)
    for i, na, nb, ng, s, e, ts, te in each:
        out[i] = na, nb, ng, packed[s:e], told[ts:te]  # without the last group's semicolon


def _squeezed(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: high planes are mostly zeros."""
    planes = x.astype(f"<u{x.itemsize}").view(np.uint8).reshape(-1, x.itemsize).T
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _loose(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


class Known:
    """Units that a worker has met, those of longest ago forgotten first."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def of(self, v: Vocabularies, units: list) -> list:
        new = [u for u in units if u not in self.young and u not in self.old]
        fresh = dict(zip(new, align(v, [_whole(u) for u in new]), strict=True))
        out = [fresh[u] if u in fresh else self.young[u] if u in self.young else self.old[u] for u in units]
        self.young.update((u, f) for u, f in zip(units, out, strict=True) if len(u) <= KEPT_CHARS)
        if len(self.young) > KEPT_UNITS:
            self.old, self.young = self.young, {}
        return out


def _block(v: Vocabularies, known: Known, ids: list, texts: list[str]) -> dict:
    """One block's row."""
    local: defaultdict = defaultdict()
    local.default_factory = local.__len__
    units = [list(map(local.__getitem__, v.split(t))) if t else [] for t in texts]
    found = known.of(v, list(local))
    bad = {i for i, f in enumerate(found) if f is None}
    none = (0, 0, 0, b"", b"")
    n_a, n_b, n_groups, links, strings = zip(*(found if not bad else [f or none for f in found]), strict=True) if found else ((), (), (), (), ())
    per_unit = np.array([n_a, n_b, n_groups], np.int64).T.reshape(-1, 3)
    if bad:
        units = [[] if bad.intersection(x) else x for x in units]
    n_units = np.array([len(x) for x in units], np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(units), np.int64)
    numbers = _sums(per_unit[flat], n_units)
    digests = b"".join(hashlib.sha256(b";".join(map(strings.__getitem__, x))).digest() if x else bytes(32) for x in units)
    sizes = np.array([len(x) // 8 for x in links], np.int64)
    keys, which = np.unique(np.frombuffer(b"".join(links), "<i8"), return_inverse=True)
    times = np.bincount(flat, minlength=len(found)) if len(flat) else np.zeros(len(found), np.int64)
    counts = np.bincount(which, weights=np.repeat(times, sizes), minlength=len(keys)).astype(np.int64)
    # Frequent units get small numbers, whose planes are nearly empty.
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by = np.repeat(rank, sizes).argsort(kind="stable")
    return {
        "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
        "has_ids": np.array([i is not None for i in ids], np.bool_).tobytes(),
        "numbers": _squeezed(numbers.ravel()),
        "digests": digests,
        "n_units": _squeezed(n_units),
        "units": _squeezed(rank[flat].astype(np.int32)),
        "ends": _squeezed(np.cumsum(sizes[order])),
        "links": _squeezed(which[by].astype(np.int32)),
        "keys": _squeezed(keys),
        "counts": _squeezed(counts),
    }


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, `sizes` at a time."""
    total = np.r_[np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def blocks(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encoded blocks of documents, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabularies(a_file, b_file), Known()
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            found = _block(v, known, ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found.values()], names=list(found))

        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= block_bytes:
                        yield row()
                        ids, texts, size = [], [], 0
        if ids:
            yield row()

    return materialize(id_and_text(docs).mapInArrow(run, _BLOCK), "aligned-blocks")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' keys and counts to one row for each key of the partition."""
    keys, counts, held = [], [], 0
    for b in batches:
        for i in range(len(b)):
            keys.append(_loose(b.column(0)[i].as_py()).astype(np.int64))
            counts.append(_loose(b.column(1)[i].as_py()).astype(np.int64))
            held += len(keys[-1])
            if held > HELD_KEYS:
                k, n = _summed(keys, counts)
                keys, counts, held = [k], [n], 0
    if keys:
        k, n = _summed(keys, counts)
        for s in range(0, len(k), SHARD_BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(k[s : s + SHARD_BATCH]), pa.array(n[s : s + SHARD_BATCH])], names=["key", "n"])


_SHARD = "path string, first long, last long, b binary, highest binary"
_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def shards(encoded: DataFrame) -> DataFrame:
    """Sorted count shards in the shared folder, and a row for each, a written table: path, first and last key, and by B id the highest count in it."""
    spark = encoded.sparkSession
    partial = materialize(encoded.select("keys", "counts").mapInArrow(_partial, "key long, n long"), "pair-counts")
    many = max(partitions(spark, partial), -(-partial.count() // SHARD_ROWS))
    folder = fresh_path(spark, "pair-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        out = sink = None
        # A task that runs again writes another file; only files of rows that were written count.
        name = f"{uuid.uuid4().hex}.arrow"
        first = last = None
        carry_key, carry = np.empty(0, np.int64), np.empty(0, np.int64)
        highest: dict = {}

        def put(k: np.ndarray, n: np.ndarray) -> None:
            nonlocal out, sink, first, last
            if out is None:
                files.create_dir(root, recursive=True)
                sink = files.open_output_stream(f"{root}/{name}", compression=None)
                out = pa.ipc.new_file(sink, _COUNTS)
                first = int(k[0])
            last = int(k[-1])
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], schema=_COUNTS))
            order = np.lexsort((n, k & 0xFFFFFFFF))
            b, top = (k & 0xFFFFFFFF)[order], n[order]
            ends = np.flatnonzero(np.r_[b[1:] != b[:-1], True])
            for x, y in zip(b[ends].tolist(), top[ends].tolist(), strict=True):
                highest[x] = max(highest.get(x, 0), y)

        for b in batches:
            if not len(b):
                continue
            k, n = np.r_[carry_key, b.column(0).to_numpy()], np.r_[carry, b.column(1).to_numpy()]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            k, n = k[at], np.add.reduceat(n, at)
            # The last run may go on in the next batch.
            carry_key, carry = k[-1:], n[-1:]
            if len(k) > 1:
                put(k[:-1], n[:-1])
        if len(carry):
            put(carry_key, carry)
            out.close()
            sink.close()
            ids = np.array(sorted(highest), np.int64)
            row = [[f"{folder}/{name}"], [first], [last], [ids.tobytes()], [np.array([highest[i] for i in ids.tolist()], np.int64).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["path", "first", "last", "b", "highest"])

    dealt = partial.repartitionByRange(many, "key").sortWithinPartitions("key")
    out = materialize(dealt.mapInArrow(write, _SHARD), "pair-shard-list")
    discard(partial)
    return out


def _highest(listed: DataFrame) -> dict[int, int]:
    """By B id its highest count; as many rows as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], names=["b", "n"])

    return {r["b"]: r["n"] for r in listed.select("b", "highest").mapInArrow(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).collect()}


class Counts:
    """Counts of pairs, looked up in sorted shards."""

    def __init__(self, listed: list[tuple[str, int, int]]):
        listed = sorted(listed, key=lambda x: x[1])
        self.paths, self.first = [x[0] for x in listed], np.array([x[1] for x in listed], np.int64)
        self.open: dict = {}

    def _shard(self, i: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        if i not in self.open:
            files, path = _filesystem(self.paths[i])
            local = type(files).__name__ == "LocalFileSystem"
            if not local:
                self.open.clear()  # read ones take memory, mapped ones don't
            reader = pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
            parts = [reader.get_batch(j) for j in range(reader.num_record_batches)]
            pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in parts]
            self.open[i] = np.array([k[0] for k, _ in pairs], np.int64), pairs
        return self.open[i]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of them in the corpus."""
        out = np.empty(len(keys), np.int64)
        shard = np.searchsorted(self.first, keys, "right") - 1
        for s, e, i in _runs(shard):
            starts, pairs = self._shard(i)
            part = np.searchsorted(starts, keys[s:e], "right") - 1
            for ps, pe, j in _runs(part):
                k, n = pairs[j]
                out[s + ps : s + pe] = n[np.searchsorted(k, keys[s + ps : s + pe])]
        return out


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and value of each run of equal values."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return zip(at.tolist(), [*at[1:].tolist(), len(x)], x[at].tolist(), strict=True) if len(at) else iter(())


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its B id's most frequent), count_sum and groups_sha256."""
    encoded = blocks(docs, a_file, b_file, block_bytes)
    listed = shards(encoded)
    found = [(r["path"], r["first"], r["last"]) for r in listed.select("path", "first", "last").collect()]
    top = _highest(listed)
    best = np.zeros(max(top, default=0) + 1, np.int64)
    best[list(top)] = list(top.values())

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(found)
        for b in batches:
            for i in range(len(b)):
                yield _told({n: b.column(n)[i].as_py() for n in b.schema.names}, counts, best)

    return encoded.select("ids", "has_ids", "numbers", "digests", "n_units", "units", "ends", "links", "keys").mapInArrow(look_up, _RESULT)


def _told(row: dict, counts: Counts, best: np.ndarray) -> pa.RecordBatch:
    keys = _loose(row["keys"]).astype(np.int64)
    n = counts.of(keys)
    links, ends = _loose(row["links"]).astype(np.int64), _loose(row["ends"]).astype(np.int64)
    values = np.c_[n == best[keys & 0xFFFFFFFF], n].astype(np.int64).reshape(-1, 2)
    per_unit = _sums(values[links], np.diff(ends, prepend=0))
    n_units = _loose(row["n_units"]).astype(np.int64)
    sums = _sums(per_unit[_loose(row["units"]).astype(np.int64)], n_units)
    numbers = _loose(row["numbers"]).astype(np.int64).reshape(-1, 3)
    ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["has_ids"], np.bool_))
    digests = [row["digests"][s : s + 32].hex() if u else "" for s, u in zip(range(0, len(row["digests"]), 32), n_units.tolist(), strict=True)]
    n_links = numbers[:, 0] + numbers[:, 1] - numbers[:, 2]  # each end of either kind ends one
    columns = [ids, *(pa.array(x) for x in (numbers[:, 0], numbers[:, 1], numbers[:, 2], n_links, sums[:, 0], sums[:, 1])), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _RESULT.split(", ")])
