import hashlib
import random

import numpy as np
import pytest

from varloom.llm import codes
from varloom.llm.registry import ORACLE, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, q string, codes string"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) that take part; all with Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))
    dims = len(rows[0][1])
    top, d = codes.limit(dims), dims // parts
    floor = lambda x: max(-top, min(top, int(np.floor(np.float64(x) * 256)) if abs(x) < 1e300 else (top if x > 0 else -top)))
    ints = [[floor(x) for x in r[1]] for r in rows]
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(v[p], books[p])[1] for v in cut]
            new = []
            for e, c in enumerate(books[p]):
                mine = [v[p] for v, a in zip(cut, at) if a == e]
                new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
            books[p] = new
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(f[0] for f in x) for x in found]
    by = {}
    for r, e in zip(rows, errors):
        by[r[2]] = by.get(r[2], 0) + e
    told = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{i:02x}" for _, i in x), e, by[r[2]], told)) for r, x, e in zip(rows, found, errors))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", "y") for i, v, g in rows], SCHEMA)


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def vectors(n, dims, seed, values=None):
    draw = random.Random(seed)
    pick = (lambda: draw.choice(values)) if values else (lambda: draw.gauss(0, 0.3))
    return [(draw.randrange(10 * n), [pick() for _ in range(dims)], draw.choice([1, 2, None])) for _ in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(300, 64, 1),
        vectors(200, 16, 2, [0.0, 1 / 256, -1 / 256, 0.5]),  # ties everywhere
        vectors(40, 32, 3),  # fewer vectors than entries
        [(i, [0.25] * 16, 7) for i in range(200)],  # all alike
        [(7, [x / 300 - 0.2] * 16, i % 2) for i, x in enumerate(range(150))],  # one id
        [(i, [1e300 if i % 3 else -1e12] * 16, 1) for i in range(100)],
        [(1, [0.5] * 16, None)],
    ],
)
def test_codes_equal_brute_force(spark, rows):
    assert told(codes.digest(frame(spark, rows).repartition(3))) == brute(rows)


def test_vectors_that_take_no_part(spark):
    good = vectors(100, 16, 4)
    odd = [(1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] + [0.0] * 15, 1), (5, [], 1), (6, [1.0] * 32, 1), (7, [1.0] * 5, 1)]
    good.append((None, [0.1] * 16, None))
    assert told(codes.digest(frame(spark, good + odd))) == brute(good)
    assert codes.digest(frame(spark, [])).collect() == []
    assert codes.digest(frame(spark, odd[:3])).collect() == []


def test_bounds_give_what_scanning_gives():
    draw = np.random.default_rng(6)
    for top in (3, 60, 5000, 1 << 26):
        x = draw.integers(-top, top + 1, (4000, 4))
        book = x[:64].copy()
        code, upper, lower = codes._scan(x, book)
        scanned = 0
        for _ in range(6):
            new = np.array([x[code == e].sum(axis=0) // (code == e).sum() if (code == e).any() else book[e] for e in range(64)])
            moved, book = codes.Moved(book, new), new
            scanned += codes.reassign(x, book, moved, code, upper, lower)
            d2 = np.stack([((x.astype(object) - c.astype(object)) ** 2).sum(axis=1) for c in book], axis=1)
            assert (code == d2.argmin(axis=1)).all()
            assert (upper.astype(object) ** 2 >= d2[np.arange(len(x)), code] * codes.STEP**2).all() or top > 1 << 20
            rest = np.partition(np.where(np.arange(64) == code[:, None], d2.max() * 4, d2), 0, axis=1)[:, 0]
            assert (lower.astype(object) ** 2 <= rest * codes.STEP**2).all()
        if top == 60:
            assert scanned < 0.8 * 6 * len(x)  # bounds spare scans


def test_decoded_vectors_are_near(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    coded, books = codes.compress(table)
    by_id = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    for r in coded.limit(50).collect():
        x = codes.integers(by_id[r.vec_id])
        assert ((x - codes.decode(r.codes, books) * codes.SCALE) ** 2).sum() == r.error


def test_query_and_its_sql_are_registered():
    assert "op13_vector_codes" in QUERIES and "op13_vector_codes" in ORACLE
