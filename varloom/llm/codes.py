"""Vector code compression: product quantization by Lloyd's rounds in integers, with Hamerly's bounds.

Components become floor(256 x); vectors are cut into PARTS equal consecutive parts, and each part position has a
codebook of ENTRIES, at first the parts of the vectors with the smallest ids. A round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by its parts' componentwise floor(sum / count); an unused
entry stays. After ROUNDS rounds parts are assigned once more.

Hamerly's bounds spare most of the distances: with each vector's codes one upper bound (of the distance to its own entry) and
one lower bound (of that to the second-nearest) for each part are written to the shared folder and read in the next round. Entries that
moved raise the upper bound by their own way and lower the lower one by the longest way of any other entry. Where the
upper bound is below the lower one, strictly, or below half the way to the entry's nearest neighbour, the code stays; else the upper bound is
made exact and tried again; else all entries are scanned in integers. Bounds are distances in steps of 1 / 256, rounded outwards, so a tie is
never decided by a bound and the result is that of scanning everything.

Vectors go through tasks where they are read; a task gives one row for each part and entry (sums and counts), so what is
shuffled and what comes to the driver is bounded by the codebooks (PARTS x ENTRIES rows), however large the table.

Vectors that are null or hold null or non-finite components take no part, nor do those of another length than most, or of a length
that PARTS does not divide. Components beyond `limit` (2^27 for 64 of them) are held at it, as squares would overflow.
Repeated ids are rows of their own; of the smallest ids, nulls last, ties go by the vector, then the label. Fewer vectors than
ENTRIES give fewer entries, an empty table an empty result; other columns are never looked at. Null labels are one label.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.storage import discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Bounds are stored in steps of 1 / STEP; beyond FAR an upper bound says nothing, and a lower bound is held at it.
STEP, FAR = 256, np.uint32(0xFFFFFFFE)
#: Vectors that are worked on at a time.
ROWS = 1024
#: Integers under this are multiplied exactly in double precision.
EXACT = 1 << 22


def limit(dims: int) -> int:
    """The largest component whose squared differences can be summed over a vector in 64 bits."""
    return math.isqrt((1 << 61) // max(dims, 1))


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, vec array<double>, label) of the vectors that take part."""
    d = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    inf = F.lit(float("inf"))
    d = d.where(F.col("vec").isNotNull()).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    d = d.where((F.size("vec") > 0) & (F.size("vec") % parts == 0))
    lengths = d.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.where(F.size("vec") == (lengths["n"] if lengths else 0))


def integers(vec: np.ndarray) -> np.ndarray:
    top = limit(vec.shape[-1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vec * SCALE), -top, top).astype(np.int64)


def _upper(d2: np.ndarray) -> np.ndarray:
    """At least the distance, in steps."""
    return np.minimum(np.floor(np.sqrt(d2.astype(np.float64)) * STEP) + 2, float(FAR) + 1).astype(np.int64)


def _lower(d2: np.ndarray) -> np.ndarray:
    """At most the distance, in steps."""
    return np.clip(np.floor(np.sqrt(d2.astype(np.float64)) * STEP) - 2, 0, float(FAR)).astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries), exact integers."""
    if not len(x):
        return np.zeros((0, len(book)), np.int64)
    if max(int(np.abs(x).max()), int(np.abs(book).max())) < EXACT:
        cross = (x.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(axis=1)[:, None] - 2 * cross + (book * book).sum(axis=1)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper and lower bound of each row, from all distances."""
    d2 = distances(x, book)
    code = d2.argmin(axis=1)  # the lower index of equals
    nearest = d2[np.arange(len(x)), code]
    if len(book) == 1:
        return code, _upper(nearest), np.full(len(x), int(FAR))
    return code, _upper(nearest), _lower(np.partition(d2, 1, axis=1)[:, 1])


class Moved:
    """How far the entries of a part's codebook went, and how far each is from its nearest neighbour."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.way = _upper(((old - new) ** 2).sum(axis=1))
        self.way[(old == new).all(axis=1)] = 0
        order = np.argsort(self.way)
        others = np.full(len(new), self.way[order[-1]])
        others[order[-1]] = self.way[order[-2]] if len(new) > 1 else 0
        self.others = others
        self.half = np.full(len(new), int(FAR))
        if len(new) > 1:
            between = distances(new, new)
            np.fill_diagonal(between, np.iinfo(np.int64).max)
            self.half = _lower(between.min(axis=1)) // 2


def reassign(x: np.ndarray, book: np.ndarray, moved: Moved, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Codes and bounds of one part brought up to date in place; the number of rows whose entries were all scanned."""
    upper[:] = np.minimum(upper + moved.way[code], int(FAR) + 1)
    lower[:] = np.maximum(lower - moved.others[code], 0)
    safe = np.maximum(lower, moved.half[code])
    open_ = np.flatnonzero(~(upper < safe))
    own = ((x[open_] - book[code[open_]]) ** 2).sum(axis=1)
    upper[open_] = _upper(own)
    open_ = open_[~(upper[open_] < safe[open_])]
    code[open_], upper[open_], lower[open_] = _scan(x[open_], book)
    return len(open_)


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x).astype(kind)], pa.binary())


def _rows(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(s, ROWS) for b in batches for s in range(0, len(b), ROWS))


_NAMES = ["vec_id", "label", "q", "codes", "upper", "lower"]


def _first(vectors: DataFrame, books: np.ndarray, state: str) -> DataFrame:
    """Assign by scanning everything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            vec = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            q = integers(vec)
            x = q.reshape(len(b), len(books), -1)
            found = [_scan(x[:, p], book) for p, book in enumerate(books)]
            codes, upper, lower = (np.stack(f, axis=1) for f in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _bytes(q, "<i4"), _bytes(codes, "u1"), _bytes(upper, "<u4"), _bytes(lower, "<u4")], names=_NAMES)

    return vectors.select("vec_id", "vec", "label").mapInArrow(run, state)


def _next(b: pa.RecordBatch, books: np.ndarray, moved: list[Moved]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts, codes, upper and lower bounds of a batch of the state, brought up to date."""
    n = len(b)
    x = _rows(b.column(2), "<i4", n).astype(np.int64).reshape(n, len(books), -1)
    codes, upper, lower = (_rows(b.column(i), kind, n).astype(np.int64) for i, kind in ((3, "u1"), (4, "<u4"), (5, "<u4")))
    for p, book in enumerate(books):
        reassign(x[:, p], book, moved[p], codes[:, p], upper[:, p], lower[:, p])
    return x, codes, upper, lower


def _updated(state: DataFrame, books: np.ndarray, moved: list[Moved], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            _, codes, upper, lower = _next(b, books, moved)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _bytes(codes, "u1"), _bytes(upper, "<u4"), _bytes(lower, "<u4")], names=_NAMES)

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floor(sum / count) of each entry's parts; one row for each part and entry comes to the driver."""
    parts, entries, dims = books.shape
    names = [f"s{i}" for i in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, dims + 1), np.int64)
        place = np.arange(parts)
        for b in _slices(batches):
            x = _rows(b.column(0), "<i4", len(b)).astype(np.int64).reshape(len(b), parts, dims)
            codes = _rows(b.column(1), "u1", len(b))
            np.add.at(total, (place[None, :], codes), np.concatenate([x, np.ones((len(b), parts, 1), np.int64)], axis=2))
        p, e = np.nonzero(total[:, :, -1])
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), *(pa.array(total[p, e, i]) for i in range(dims + 1))], names=["part", "entry", *names, "n"])

    schema = ", ".join(f"{n} long" for n in ["part", "entry", *names, "n"])
    new = books.copy()
    for r in state.select("q", "codes").mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in [*names, "n"]]).collect():
        new[r["part"], r["entry"]] = [r[n] // r["n"] for n in names]
    return new


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes binary, error) of each vector that takes part, a written table, and the codebooks (parts, entries, components)."""
    if entries > 256:
        raise ValueError("a code is one byte")
    vectors = usable(table, parts=parts)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vec", F.asc_nulls_last("label")).select("vec").limit(entries).collect()
    if not first:
        return materialize(vectors.selectExpr("vec_id", "label", "binary('') AS codes", "0L AS error"), "codes"), np.zeros((parts, 0, 0), np.int64)
    books = integers(np.array([r["vec"] for r in first], np.float64)).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, q binary, codes binary, upper binary, lower binary"
    state = materialize(_first(vectors, books, schema), "codes-0")
    for r in range(1, rounds + 1):
        new = _sums(state, books)
        moved = [Moved(a, b) for a, b in zip(books, new, strict=True)]
        books = new
        if r < rounds:
            was, state = state, materialize(_updated(state, books, moved, schema), f"codes-{r}")
            discard(was)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(parts)
        for b in _slices(batches):
            x, codes, _, _ = _next(b, books, moved)
            error = ((x - books[place[None, :], codes]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _bytes(codes, "u1"), pa.array(error)], names=["vec_id", "label", "codes", "error"])

    out = materialize(state.mapInArrow(last, f"vec_id long, label {label}, codes binary, error long"), "codes")
    discard(state)
    return out, books


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, c] for p, c in enumerate(codes)]) / SCALE


def digest(table: DataFrame) -> DataFrame:
    """Per vector: vec_id, code, error, label_error and codebooks_sha256."""
    coded, books = compress(table)
    told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # One row per label after partial aggregation; both sides are written, so a label that fills a third of the table is split.
    totals = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(told).alias("codebooks_sha256"))
