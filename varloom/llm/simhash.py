"""Near-dedup by SimHash with pivot distance tables.

A fingerprint is a text's SimHash over its word shingles, 64 bits for each of `width` words; two
fingerprints link when they differ in `radius` bits or fewer, and documents joined by a chain of
links form a component.

Distinct fingerprints are dealt into cells. One word wide, cells are exact: cut into radius + m
bit blocks, two that link agree on m whole blocks at least, so they share the cell of those
blocks. Wider fingerprints serve radii that no pigeonhole reaches (a similarity of 0.8 changes
15 % of the bits): cells are then bands of random bits, as many as find BAND_RECALL of the pairs at
that rate. Either way bits are added with the number of fingerprints, so that cells stay small.
Inside a cell every fingerprint has a row in a pivot distance table: its Hamming distances to
PIVOTS reference fingerprints. By the triangle inequality a pair whose rows differ by more than
`radius` in any coordinate can't link, so pairs are discarded by their maximum coordinate
difference and only survivors are verified bit by bit. Cells yield spanning links, never all pairs
of a group; components come from contracting the links over written tables.

near_copies() uses wide fingerprints (of shingle sets, so that repeats don't count) as candidate search alone:
bands decide which pairs are looked at, and in cells of over SMALL members pivots taken from the cell itself
discard pairs before their bits are compared (pivots drawn at random are all half the bits away and
discard nothing at such a radius). Its links only gather texts into groups; inside of a group the shingle sets
themselves are compared, BLOCK texts against BLOCK texts in one task, and what reaches the Jaccard
similarity links. Neither step writes a row for a pair: both give links that span.

Null text is empty text; a text without words has fingerprint zero and links like any other. A
null doc_id counts as larger than all (a component of null ids alone has a null id). Repeated
rows each get their row. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.text import id_and_text, quoted
from varloom.storage import PARTITION_BYTES, discard, materialize, partitions

PIVOTS = 16
BAND_RECALL = 0.97
#: Fingerprints that a cell holds on average, at most.
OCCUPANCY = 128
#: Cells of up to so many members are compared offset by offset, larger ones by growing components.
SMALL = 256
#: Texts of a group that one task compares with as many others, and their shingles.
BLOCK, BLOCK_SHINGLES = 96, 4_000_000
#: Distinct shingles that a comparison looks at together.
COLUMNS = 8192


def _mixed(seed: int, n: int) -> np.ndarray:
    """n numbers of the splitmix64 sequence."""
    out, x, mask = [], seed, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)
_SPREAD = np.uint64(0xFF51AFD7ED558CCD)


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes: count bytes by value and place, then turn a place's 256 counts into those of its 8 bits."""
    counts = np.zeros(2048, dtype=np.int64)
    for part in np.array_split(h, max(1, len(h) // 65536)):
        counts += np.bincount((part.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
    bits = (counts.reshape(8, 256) @ _BITS).ravel() * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _shingles(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of a text's word shingles, none without words."""
    from xxhash import xxh64_intdigest as xxh

    w = text.lower().split()
    if len(w) < words:
        return np.array([xxh(b" ".join(w), seed)] if w else [], dtype="<u8")
    shingles = map(b" ".join, zip(*(itertools.islice(w, i, None) for i in range(words)), strict=False))
    return np.fromiter((xxh(s, seed) for s in shingles), dtype="<u8", count=len(w) - words + 1)


def _fingerprint(h: np.ndarray, seed: int, width: int) -> bytes:
    if not len(h):
        return bytes(8 * width)
    out = [_majority(h)]
    for salt in _mixed(seed, width - 1):
        x = (h ^ salt) * _SPREAD
        out.append(_majority((x ^ (x >> np.uint64(29))) * _SPREAD ^ x))
    return b"".join(x.to_bytes(8, "big") for x in out)


def simhash(text: bytes, words: int = 4, seed: int = 42, width: int = 1) -> bytes:
    """Fingerprint of a UTF-8 text, big-endian; bytes.lower and bytes.split know ASCII letters and white space only.

    The first word is the SimHash of the shingles' XXH64; each further word is that of the hashes mixed once more.
    """
    return _fingerprint(_shingles(text, words, seed), seed, width)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, width: int = 1) -> DataFrame:
    """(doc_id, fp): fp is the big-endian fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(t, words, seed, width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp binary")


def _cells(n: int, radius: int, width: int) -> list[np.ndarray]:
    """The bit places of each cell key, for n fingerprints."""
    if width == 1:
        for extra in range(1, 33):
            blocks = np.array_split(np.arange(64), radius + extra)
            least = sum(sorted(len(b) for b in blocks)[:extra])
            if n <= OCCUPANCY << least or least >= 40:
                break
        return [np.concatenate(c) for c in itertools.combinations(blocks, extra)]
    bits = max(12, math.ceil(math.log2(max(1, n) / OCCUPANCY)))
    agree = (1 - radius / (64 * width)) ** bits
    bands = math.ceil(math.log(1 - BAND_RECALL) / math.log(1 - agree))
    rng = np.random.default_rng(7)
    return [np.sort(rng.choice(64 * width, bits, replace=False)) for _ in range(bands)]


def _array(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, width)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _link_cell(fp: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one cell. Pairs already joined aren't compared again, so a cell full of near copies costs little."""
    out, todo = [], np.arange(len(fp))
    while len(todo) > 1:
        # Grow one component from the first of todo: its frontier is compared with what lies outside of the component.
        front, todo = [int(todo[0])], todo[1:]
        root = front[0]
        while front and len(todo):
            i = front.pop()
            near = np.abs(table[todo] - table[i]).max(axis=1) <= radius
            near[near] = _apart(fp[todo[near]], fp[i]) <= radius
            found = todo[near].tolist()
            out += [(root, j) for j in found]
            front += found
            todo = todo[~near]
    return out


def _link_sorted(cell: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Spanning links of consecutive whole cells."""
    starts = np.flatnonzero(np.r_[True, np.any(cell[1:] != cell[:-1], axis=1)])
    sizes = np.diff(np.r_[starts, len(fp)])
    wide = fp.shape[1] > 1
    table = np.empty((len(fp), 0), np.int16) if wide else np.stack([_apart(fp, p) for p in pivots], axis=1).astype(np.int16)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out, raw = [], fp.astype(">u8")

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if (x := find(i)) != (y := find(j)):
                parent[x] = y
                out.append((raw[i].tobytes(), raw[j].tobytes()))

    # Small cells: the pairs at each offset, of all cells at once.
    small = np.repeat(sizes <= SMALL, sizes)
    at, end = np.flatnonzero(small), np.repeat(starts + sizes, sizes)[small]
    for off in range(1, SMALL):
        keep = at + off < end
        at, end = at[keep], end[keep]
        if not len(at):
            break
        x = at
        for k in range(table.shape[1]):  # the pivots one by one: most pairs are gone after a few
            x = x[np.abs(table[x, k] - table[x + off, k]) <= radius]
        for y in np.array_split(x, len(x) // 65536 + 1):
            y = y[_apart(fp[y], fp[y + off]) <= radius]
            join(y, y + off)
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = fp[s : s + n]
        rows = np.stack([_apart(own, p) for p in own[:: -(-n // PIVOTS)]], axis=1).astype(np.int16) if wide else table[s : s + n]
        found = np.array(_link_cell(own, rows, radius), np.int64).reshape(-1, 2) + s
        join(found[:, 0], found[:, 1])
    return out


def links(distinct: DataFrame, n: int, radius: int = 4, width: int = 1) -> DataFrame:
    """(u, v): links that span each component of the n fingerprints in `distinct` (fp)."""
    keys, pivots = _cells(n, radius, width), _mixed(0x5EED, PIVOTS * width).reshape(PIVOTS, width)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0)
            bits = np.unpackbits(np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).reshape(-1, 8 * width), axis=1).astype(np.int64)
            for c, places in enumerate(keys):
                key = bits[:, places] @ (np.int64(1) << np.arange(len(places), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int64)), pa.array(key), raw], names=["c", "k", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty((0, 2), np.int64), np.empty((0, width), np.uint64)
        for b in itertools.chain(batches, [None]):
            cut = len(cell)
            if b is not None:
                cell = np.concatenate([cell, np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)])
                fp = np.concatenate([fp, _array(b.column(2), width)])
                # The last cell may go on in the next batch.
                cut = int(np.flatnonzero(np.r_[True, np.any(cell[1:] != cell[:-1], axis=1)])[-1]) if len(cell) else 0
            if cut:
                found = _link_sorted(cell[:cut], fp[:cut], radius, pivots)
                cell, fp = cell[cut:], fp[cut:]
                u, v = [min(x) for x in found], [max(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    # A cell row takes as many bytes as a fingerprint and its key, and each fingerprint has one for each cell.
    p = max(partitions(distinct.sparkSession), n * len(keys) * (8 * width + 16) // PARTITION_BYTES)
    cells = distinct.select("fp").mapInArrow(deal, "c long, k long, fp binary")
    return cells.repartition(p, "c", "k").sortWithinPartitions("c", "k").mapInArrow(run, "u binary, v binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that the links (u, v) reach from each node.

    Each round every node points to its least neighbour, pointers are doubled twice, and the graph is contracted to what is
    pointed at. Links inside of a contracted node drop out, so later rounds see few of them.
    """
    low = lambda a, b: F.least(F.col(a), F.col(b))
    e, roots = materialize(edges.select(low("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "links"), None
    while not e.isEmpty():
        ends = e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select("u", F.col("u")))
        to = materialize(ends.groupBy("node").agg(F.min("root").alias("root")), "pointers")
        for _ in range(2):
            further = to.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
            jumped = materialize(to.join(further, F.col("root") == F.col("_at")).select("node", F.col("_to").alias("root")), "pointers")
            discard(to)
            to = jumped
        at = lambda c: to.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_r{c}"))
        moved = e.join(at("u"), F.col("u") == F.col("_u")).join(at("v"), F.col("v") == F.col("_v")).where("_ru <> _rv")
        rest = materialize(moved.select(low("_ru", "_rv").alias("u"), F.greatest("_ru", "_rv").alias("v")).distinct(), "links")
        if roots is None:
            roots = to
        else:
            onward = to.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
            joined = roots.join(onward, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_to", "root").alias("root"))
            joined = materialize(joined, "roots")
            discard(roots)
            discard(to)
            roots = joined
        discard(e)
        e = rest
    return roots


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, width: int = 1) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that a chain of links reaches)."""
    rows = materialize(fingerprints(docs, words, seed, width), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = materialize(links(distinct, distinct.count(), radius, width), "edges")
    if edges.isEmpty():
        of = distinct.select("fp", F.col("first_id").alias("component_id"))
    else:
        linked = materialize(distinct.join(components(edges), F.col("fp") == F.col("node")).select("fp", "first_id", "root"), "linked")
        least = materialize(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
        found = linked.join(least, "root").select(F.col("fp").alias("of"), "component_id")
        of = distinct.join(found, F.col("fp") == F.col("of"), "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(materialize(of, "components"), "fp").select("doc_id", "fp", "component_id")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share."""
    n, size = len(sets), [len(x) for x in sets]
    doc, (_, at) = np.repeat(np.arange(n), size), np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at, minlength=1) > 1
    keep = often[at]
    doc, at = doc[keep], (np.cumsum(often) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    doc, at, out = doc[order], at[order], np.zeros((n, n), np.float32)
    for s in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(at, [s, s + COLUMNS])
        x = np.zeros((n, int(at[j - 1]) - s + 1), np.float32)
        x[doc[i:j], at[i:j] - s] = 1
        out += x @ x.T
    return out


def _link_block(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning links of the pairs whose sets are similar; with two sides those across them."""
    size, both = np.array([len(x) for x in sets], np.float64), _shared(sets).astype(np.float64)
    near = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    out, left = [], np.ones(len(sets), bool)
    while left.any():
        front = [int(left.argmax())]
        left[front] = False
        while front:
            i = front.pop()
            found = np.flatnonzero(near[i] & left)
            left[found] = False
            out += [(i, j) for j in found.tolist()]
            front += found.tolist()
    return out


def similar(members: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that span the similar sets of each group of members (root, blocks, block, node, set).

    Each two blocks of a group meet in one task, which holds their sets and no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            found = _link_block([np.frombuffer(x, np.uint64) for _, _, x in held], np.array([b for b, _, _ in held]), similarity) if len(held) > 1 else []
            return [(held[i][1], held[j][1]) for i, j in found]

        parts = (b.slice(s, 256) for b in batches for s in range(0, len(b), 256))
        for b in itertools.chain(parts, [None]):
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True) if b is not None else [(None,) * 6]:
                if row[:3] != key:
                    out += links()
                    key, held = row[:3], []
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

    meet = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "set")
    p = partitions(members.sparkSession, members)
    return meet.repartition(p, "root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(run, "u long, v long")


def _classes(docs: DataFrame, words: int, similarity: float, radius: int, width: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, own) per document and (own, stays) per shingle set: stays is the (none, doc_id, hash) that its component's least row has."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            h = [np.unique(_shingles(t, words, seed)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fp, own = [_fingerprint(x, seed, width) for x in h], [xxh3_128_digest(x.tobytes()) for x in h]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.binary()), pa.array(own, pa.binary()), pa.array([len(x) for x in h], pa.int64())], names=["doc_id", "hash", "fp", "own", "n"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.slice(s, 256)
                found = [np.unique(_shingles(t, words, seed)).tobytes() for t in part.column(4).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.binary())], names=["root", "blocks", "block", "node", "set"])

    text = id_and_text(docs).withColumn("hash", F.md5(F.col("text").cast("binary")))
    rows = materialize(text.mapInArrow(sets, "doc_id long, hash string, fp binary, own binary, n long"), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    nodes = rows.groupBy("own").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), first).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    alone = nodes.select("own", F.col("first").alias("stays"))
    distinct = materialize(nodes.select("fp").distinct(), "distinct")
    loose = materialize(links(distinct, distinct.count(), radius, width), "loose")
    twins = nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    groups = components(loose).select(F.col("node").alias("fp"), "root") if not loose.isEmpty() else twins.select("fp", F.col("fp").alias("root"))
    if not loose.isEmpty():
        groups = groups.union(twins.join(groups.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root")))
    members = materialize(nodes.join(groups, "fp").select("root", "node", "n", "first"), "members")
    if members.isEmpty():
        return rows, alone
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    # Written first: both sides of the join are tables then, and a hot group's rows can be split.
    large = materialize(members.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    members = members.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.select("root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", F.col("first.doc_id").alias("of_id"), F.col("first.hash").alias("of_hash"))
    whose = F.col("of_id").eqNullSafe(F.col("doc_id")) & (F.col("of_hash") == F.col("hash"))
    asked = members.join(text, whose).dropDuplicates(["node"]).select("root", "blocks", "block", "node", "text")
    members = materialize(asked.mapInArrow(shingled, "root binary, blocks int, block int, node long, set binary"), "shingles")
    edges = materialize(similar(members, similarity), "edges")
    discard(members)
    if edges.isEmpty():
        return rows, alone
    linked = materialize(nodes.join(components(edges), "node").select("own", "first", "root"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("stays")), "roots")
    found = linked.join(least, "root").select(F.col("own").alias("of"), F.col("stays").alias("joined"))
    of = nodes.join(found, F.col("own") == F.col("of"), "left").select("own", F.coalesce("joined", "first").alias("stays"))
    return rows, materialize(of, "components")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 108, width: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) per document: the smallest doc_id that a chain of texts reaches whose shingle sets have the similarity."""
    rows, of = _classes(docs, words, similarity, radius, width, seed)
    return rows.join(of, "own").select("doc_id", F.col("stays.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 108, width: int = 8, seed: int = 42) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest doc_id, null ids last; of several texts under one id the least by MD5.

    Shingle sets with a Jaccard similarity of 0.8 differ in 78 of 512 bits on average, give or take 8: `radius` leaves room for nearly all.
    """
    _, of = _classes(docs, words, similarity, radius, width, seed)
    stay = of.select(F.col("stays.doc_id").alias("__near_id"), F.col("stays.hash").alias("__near_of")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("*", F.col("doc_id").cast("long").alias("__near_doc"), F.md5(text.cast("binary")).alias("__near_text"))
    d = d.join(stay, F.col("__near_doc").eqNullSafe(F.col("__near_id")) & (F.col("__near_text") == F.col("__near_of")), "left_semi")
    # Rows that repeat in full are one document; the join's partitioning by document and text serves this window too.
    once = Window.partitionBy("__near_doc", "__near_text").orderBy("__near_doc")
    return d.withColumn("__near_n", F.row_number().over(once)).where("__near_n = 1").select(*quoted(docs.columns))
