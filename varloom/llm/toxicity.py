"""Toxicity by a factorization machine over hashed terms.

Terms (runs of ASCII letters and digits and of other characters, lower-cased) and their beginnings are
hashed to 2^18 places. The machine scores bias + sum of weights + pairwise products of the present terms' factor
vectors, so a pair such as an insult with a group's name can weigh more than both do apart.

It is fitted on a bounded sample of labelled documents: `max_train` rows at most, up to half of
them toxic, chosen by a hash of doc_id among rows that are not held out. Two kinds of places take part: the `n_features`
that tell the classes apart best by themselves, and of the `n_paired` most frequent ones those of which some pair tells
more than either place does, such as a name that is harmless until it meets an insult. Counts by place and
the sample's rows, cut to places that may take part, are all that comes to the driver: 2^18 counts and
max_train rows of n_features + n_paired numbers at most, however long the texts. Every document is scored over its whole text.

Null text is empty text and gets the score of no terms. Labels that are null, not 0 or 1, or of a
null doc_id are not used; of repeated labels the larger counts. Without labels of both classes every
score is the share of toxic ones (0 without any). A null doc_id is never held out. Repeated rows
are each scored; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.text import id_and_text
from varloom.storage import materialize

PLACES = 1 << 18
THRESHOLD = 0.7
#: Standard deviations beyond which a pair speaks for its places; there are a million pairs, so some reach 5 by chance.
PAIR_EVIDENCE = 6.0
#: Bytes of the beginnings that count as terms of their own.
BEGINNINGS = (4, 5, 6)
#: Everything but letters, digits and bytes of other scripts parts terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def places(text: bytes) -> np.ndarray:
    """The distinct places of a text's terms and of their beginnings, which inflected forms share."""
    whole = set(text.translate(_TERM).split())
    terms = whole.union(*({t[:k] + b"*" for t in whole if len(t) >= k} for k in BEGINNINGS))
    return np.unique(np.fromiter(map(crc32, terms), np.uint32, len(terms)) & np.uint32(PLACES - 1))


@dataclass
class Machine:
    slots: np.ndarray  # by place: the feature, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, text: bytes) -> float:
        found = self.slots[places(text)]
        found = found[found >= 0]
        v = self.factors[found]
        total = v.sum(axis=0)
        z = self.bias + self.weights[found].sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def single_evidence(with_term: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By place: how many standard deviations its share of documents differs by between the classes; with_term (2, places) counts documents."""
    rate = (with_term + 0.5) / (n[:, None] + 1)
    both = (with_term.sum(axis=0) + 1.0) / (n.sum() + 2)
    apart = np.abs(rate[1] - rate[0]) / np.sqrt(both * (1 - both) * (1 / n).sum())
    apart[with_term.sum(axis=0) < 4] = 0
    return apart


def pair_evidence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By column: over its pairs, the most standard deviations by which the pair's share of toxic documents leaves the range of its two places' own shares."""
    toxic = x[y == 1]
    together, bad = x.T @ x, toxic.T @ toxic
    own = np.clip(np.diag(bad) / np.maximum(np.diag(together), 1), 0.01, 0.99)
    out = np.zeros(x.shape[1], np.float32)
    for i in range(x.shape[1]):
        both = np.maximum(together[i], 1)
        high, low = np.maximum(own, own[i]), np.minimum(own, own[i])
        over = (bad[i] - both * high) / np.sqrt(both * high * (1 - high))
        under = (both * low - bad[i]) / np.sqrt(both * low * (1 - low))
        out[i] = np.where(together[i] >= 8, np.maximum(over, under), 0).max()
    return out


def constant(y: np.ndarray, rank: int = 4) -> Machine:
    """Without labels of both classes."""
    share = float(y.mean()) if len(y) else 0.0
    z = float(np.log(share / (1 - share))) if 0 < share < 1 else 30.0 if share else -30.0
    return Machine(np.full(PLACES, -1, np.int32), z, np.zeros(1, np.float32), np.zeros((1, rank), np.float32))


def train(x: np.ndarray, y: np.ndarray, rank: int = 4, steps: int = 400, l2: float = 2e-3, seed: int = 11) -> list[np.ndarray]:
    """Bias, weights and factors by full-batch Adam on log loss with weight decay; x: documents by features, 0 or 1."""
    rng = np.random.default_rng(seed)
    par = [np.zeros(1), np.zeros(x.shape[1]), rng.normal(0, 0.01, (x.shape[1], rank))]
    par = [p.astype(np.float32) for p in par]
    m, s = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for t in range(1, steps + 1):
        b, w, v = par
        xv = x @ v
        z = b[0] + x @ w + 0.5 * (xv**2 - x @ (v * v)).sum(axis=1)
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        gx = x.T @ g
        grads = [np.array([g.sum()], np.float32), gx + l2 / 10 * w, x.T @ (g[:, None] * xv) - v * gx[:, None] + l2 * v]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d * d
            par[k] = par[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return par


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000, n_features: int = 1024, n_paired: int = 1536, **settings) -> Machine:
    """Fit on `max_train` labelled rows at most that are not held out."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda c: lab.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
    some = F.broadcast(first(0).union(first(1)))  # max_train rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [places(t).astype(np.int32) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "places"])

    d = id_and_text(docs).join(some, "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, places array<int>")
    # Each text counts once. Where ids repeat there may be more rows than max_train: those with the least hashes stay, found by the hashes alone.
    d = materialize(d.distinct().withColumn("hash", F.xxhash64("toxic", "places")), "toxicity-sample")
    last = d.select("hash").orderBy("hash").limit(max_train).agg(F.max("hash")).first()[0]
    d = d.where(F.col("hash") <= (last or 0)).select("toxic", "places")
    n = np.zeros(2)
    for r in d.groupBy("toxic").count().collect():
        n[r["toxic"]] = r["count"]
    if not n.all():
        return constant(np.repeat([0, 1], n.astype(int)), settings.get("rank", 4))
    counts = d.select("toxic", F.explode("places").alias("place")).groupBy("place").agg(*[F.count_if(F.col("toxic") == c) for c in (0, 1)]).toPandas().to_numpy(np.int64)
    with_term = np.zeros((2, PLACES))
    with_term[:, counts[:, 0]] = counts[:, 1:].T
    apart = single_evidence(with_term, n)
    telling = np.argsort(-apart, kind="stable")[:n_features]
    telling = telling[apart[telling] > 3]
    total = with_term.sum(axis=0)
    frequent = np.argsort(-total, kind="stable")[:n_paired]
    frequent = np.setdiff1d(frequent[(total[frequent] >= 8) & (total[frequent] < n.sum())], telling)
    pool = np.r_[telling, frequent]
    column = np.full(PLACES, -1, np.int32)
    column[pool] = np.arange(len(pool))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [column[np.asarray(p, np.int64)] for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.sort(a[a >= 0]).astype(np.uint16).tobytes() for a in at], pa.binary())], names=["toxic", "at"])

    rows = sorted((bytes(r["at"]), r["toxic"]) for r in d.mapInArrow(cut, "toxic int, at binary").toLocalIterator())
    y = np.array([t for _, t in rows], np.float64)
    x = np.zeros((len(rows), max(1, len(pool))), np.float32)
    for i, (at, _) in enumerate(rows):
        x[i, np.frombuffer(at, np.uint16)] = 1
    keep = np.arange(len(telling))
    if len(pool):
        found = pair_evidence(x, y)[len(telling) :]
        keep = np.r_[keep, len(telling) + np.flatnonzero(found > PAIR_EVIDENCE)]
    chosen, slots = pool[keep], np.full(PLACES, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    x = x[:, keep] if len(keep) else np.zeros((len(y), 1), np.float32)
    bias, weights, factors = train(x, y, **settings)
    return Machine(slots, float(bias[0]), weights, factors)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # 2^18 slots and n_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents under the threshold, with all their columns, scored where they are: nothing is shuffled."""
    model, text = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield b.filter(pa.array([m.score(t or b"") < threshold for t in b.column(text).cast(pa.binary()).to_pylist()], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
