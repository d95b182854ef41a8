"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one node with their smallest ids, so that copies can't cut a graph apart. Nodes
are dealt by hash into shards of about SHARD_ROWS. A shard's graph is built in insertion order:
each node takes its candidates from the nodes before it (found exactly, by blocks of a matrix
product), keeps those that are nearer to it than to one another, and links back; lists that
grow too long are thinned the same way. Levels are drawn from a hash of the id. The graph is stored as
flat neighbour arrays, one for each level, in one row per shard.

Nearness is the inner product. For building, a component sqrt(R^2 - |x|^2) makes it a distance; searches
use the product itself: a greedy walk down the levels, then a beam of EF nodes on level 0, for a
whole block of queries at a time. Graphs and walks use single precision, over vectors divided by their shard's
largest component and queries by their own, so that any finite size will do; scores are worked out again in double
precision from the original components.

A shard moves once: its row comes first in its task's stream, the blocks of queries follow and are searched one by one.
Only where there are fewer shards than tasks, queries are dealt into lanes and each lane gets its copy.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than most. Ids that are null take no part. An id that repeats takes part once for each
vector it has. Ties go to the smaller id; fewer candidates than k give fewer rows; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.storage import materialize, partitions

SHARD_ROWS = 8192
QUERY_BLOCK = 512
M = 16
CANDIDATES = 64
EF = 96


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec array<double>) of the vectors that take part."""
    d = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    inf = F.lit(float("inf"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    d = d.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(whole & F.exists("vec", lambda x: x != 0))
    lengths = d.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return d.where(F.size("vec") == (lengths["n"] if lengths else 0))


def _choose(x: np.ndarray, node: np.ndarray, cand: np.ndarray, dist: np.ndarray, cap: int) -> np.ndarray:
    """HNSW's neighbour rule for many nodes at once: cand (n, c) by distance, -1 for none; at most cap of each row stay, -1 after them."""
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    sq = (v * v).sum(axis=2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((n, c), bool)
    for j in range(c):
        nearer = kept & (between[:, j, :] < dist[:, j, None])
        kept[:, j] = (cand[:, j] >= 0) & ~nearer.any(axis=1) & (kept.sum(axis=1) < cap)
    # Places that are still free go to the nearest of the rest.
    rest = (cand >= 0) & ~kept
    kept |= rest & (np.cumsum(rest, axis=1) <= (cap - kept.sum(axis=1))[:, None])
    order = np.argsort(~kept, axis=1, kind="stable")[:, :cap]
    return np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(cand, order, 1), -1)


def _level(x: np.ndarray, members: np.ndarray, m: int, cap: int) -> np.ndarray:
    """Neighbours (by row of x, -1 for none) of the members of one level, in insertion order."""
    n, y = len(members), x[members]
    sq = (y * y).sum(axis=1)
    forward = np.full((n, m), -1, np.int64)
    for s in range(0, n, 256):
        e = min(n, s + 256)
        d = sq[s:e, None] + sq[None, :e] - 2 * (y[s:e] @ y[:e].T)
        d[np.arange(e)[None, :] >= np.arange(s, e)[:, None]] = np.inf
        c = min(CANDIDATES, e)
        near = np.argpartition(d, c - 1, axis=1)[:, :c]
        far = np.take_along_axis(d, near, 1)
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        near[~np.isfinite(far)] = -1
        got = _choose(y, np.arange(s, e), near, far, m)
        forward[s:e, : got.shape[1]] = got
    a, b = np.repeat(np.arange(n), m), forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    left, right = np.r_[a, b], np.r_[b, a]
    far = ((y[left] - y[right]) ** 2).sum(axis=1)
    order = np.lexsort((far, left))
    left, right, far = left[order], right[order], far[order]
    starts = np.searchsorted(left, np.arange(n))
    rank = np.arange(len(left)) - starts[left]
    near = rank < 4 * cap
    width = min(4 * cap, int(rank.max()) + 1) if len(rank) else 1
    cand, dist = np.full((n, width), -1, np.int64), np.full((n, width), np.inf)
    cand[left[near], rank[near]], dist[left[near], rank[near]] = right[near], far[near]
    out = np.full((n, cap), -1, np.int64)
    for s in range(0, n, 256):
        got = _choose(y, np.arange(s, min(n, s + 256)), cand[s : s + 256], dist[s : s + 256], cap)
        out[s : s + 256, : got.shape[1]] = got
    return np.where(out >= 0, members[np.maximum(out, 0)], -1).astype(np.int32)


def _single(vec: np.ndarray) -> np.ndarray:
    return (vec / max(float(np.abs(vec).max()), np.finfo(np.float64).tiny)).astype(np.float32)


def build(ids: np.ndarray, vec: np.ndarray, m: int = M) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Insertion order, then for each level its nodes and their neighbours; level 0 holds all nodes."""
    from xxhash import xxh64_intdigest as xxh

    u = (np.array([xxh(int(i).to_bytes(8, "little", signed=True)) for i in ids], np.float64) + 1) / 2.0**64
    top = np.minimum((-np.log(np.minimum(u, 1.0)) / np.log(m)).astype(np.int64), 8)
    order = np.argsort(-top, kind="stable")  # the first node is on the top level: every search enters there
    x, top = _single(vec[order]), top[order]
    sq = (x * x).sum(axis=1)
    x = np.c_[x, np.sqrt(np.maximum(sq.max() - sq, 0))]
    nodes = [np.flatnonzero(top >= level) for level in range(int(top[0]) + 1)]
    rng = np.random.default_rng(3)
    # Within a level nodes come in hash order, so early ones make the long links.
    shuffled = [rng.permutation(n) for n in nodes]
    return order, nodes, [_level(x, n, m, 2 * m if i == 0 else m)[np.argsort(n)] for i, n in enumerate(shuffled)]


def search(x: np.ndarray, nodes: list[np.ndarray], near: list[np.ndarray], q: np.ndarray, ef: int = EF) -> np.ndarray:
    """For each query up to ef rows of x, largest product first, -1 for none."""
    n, rows = len(x), np.arange(len(q))
    at, best = np.zeros(len(q), np.int64), q @ x[0]
    for level in range(len(nodes) - 1, 0, -1):
        place = np.full(n, -1, np.int64)
        place[nodes[level]] = np.arange(len(nodes[level]))
        moving = rows
        while len(moving):
            to = near[level][place[at[moving]]]
            s = np.where(to >= 0, np.einsum("qd,qnd->qn", q[moving], x[np.maximum(to, 0)]), -np.inf)
            j = s.argmax(axis=1)
            value = s[np.arange(len(moving)), j]
            up = value > best[moving]
            moving = moving[up]
            at[moving], best[moving] = to[up, j[up]], value[up]
    beam, score = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
    open_, visited = np.zeros((len(q), ef), bool), np.zeros((len(q), n), bool)
    beam[:, 0], score[:, 0], open_[:, 0], visited[rows, at] = at, best, True, True
    active = rows
    while len(active):
        j = np.where(open_[active], score[active], -np.inf).argmax(axis=1)
        going = open_[active, j]
        active, j = active[going], j[going]
        if not len(active):
            break
        open_[active, j] = False
        to = near[0][beam[active, j]]
        new = (to >= 0) & ~visited[active[:, None], np.maximum(to, 0)]
        s = np.where(new, np.einsum("qd,qnd->qn", q[active], x[np.maximum(to, 0)]), -np.inf).astype(np.float32)
        r, c = np.nonzero(new)
        visited[active[r], to[r, c]] = True
        all_s, all_b, all_o = np.c_[score[active], s], np.c_[beam[active], np.where(new, to, -1)], np.c_[open_[active], new]
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        score[active], beam[active], open_[active] = (np.take_along_axis(a, top, 1) for a in (all_s, all_b, all_o))
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(beam, order, 1)


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """A row for each shard: its node vectors, levels, flat neighbour arrays and the k + 1 smallest ids of each node."""
    least = Window.partitionBy("vec").orderBy("vec_id")
    nodes = vectors.distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    nodes = nodes.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes, "ann-nodes")
    shards = max(1, round(nodes.count() / shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([i[0] for i in pdf["ids"]])]
        vec = np.stack(pdf["vec"].to_list())
        order, levels, near = build(np.array([i[0] for i in pdf["ids"]]), vec)
        ids = [np.asarray(pdf["ids"].iloc[i], np.int64) for i in order]
        row = {"shard": int(pdf["shard"].iloc[0]), "vectors": vec[order].astype(np.float64).tobytes(), "ids": np.concatenate(ids).tobytes()}
        row |= {"n_ids": np.array([len(i) for i in ids], np.int32).tobytes(), "levels": [n.astype(np.int32).tobytes() for n in levels], "near": [x.tobytes() for x in near]}
        return pd.DataFrame([row])

    out = nodes.groupBy("shard").applyInPandas(graph, "shard int, vectors binary, ids binary, n_ids binary, levels array<binary>, near array<binary>")
    return materialize(out, "ann-index"), shards


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF) -> DataFrame:
    """The k nearest found of each row whose id divides by `every`: query_id, rank, vec_id, score."""
    vectors = materialize(usable(table, id_col, vec_col), "ann-vectors")
    graphs, shards = index(vectors, k, shard_rows)
    queries = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame([{"block": int(pdf["block"].iloc[0]), "query_ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "queries": np.stack(pdf["vec"].to_list()).astype(np.float64).tobytes()}])

    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block")
    packed = packed.applyInPandas(pack, "block int, query_ids binary, queries binary")
    # The stated queries, in blocks, meet each shard once.
    lanes = max(1, min(blocks, partitions(table.sparkSession) // shards))
    lane = F.pmod(F.col("block"), F.lit(lanes))
    shared = graphs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("block", F.lit(-1))
    asked = packed.withColumn("lane", lane).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    stream = shared.unionByName(asked, allowMissingColumns=True).select("shard", "lane", "block", "vectors", "ids", "n_ids", "levels", "near", "query_ids", "queries")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: tuple = ()
        for b in batches:
            for r in (row for i in range(len(b)) for row in b.slice(i, 1).to_pylist()):
                if r["block"] < 0:
                    n_ids = np.frombuffer(r["n_ids"], np.int32)
                    exact = np.frombuffer(r["vectors"], np.float64).reshape(len(n_ids), -1)
                    levels = [np.frombuffer(x, np.int32) for x in r["levels"]]
                    near = [np.frombuffer(x, np.int32).reshape(len(n), -1) for n, x in zip(levels, r["near"], strict=True)]
                    graph = exact, _single(exact), levels, near, n_ids, np.frombuffer(r["ids"], np.int64), r["shard"]
                elif graph and graph[-1] == r["shard"]:
                    q = np.frombuffer(r["queries"], np.float64).reshape(-1, graph[0].shape[1])
                    yield pa.RecordBatch.from_arrays(_hits(graph, np.frombuffer(r["query_ids"], np.int64), q, k, ef), names=["query_id", "vec_id", "score"])

    dealt = stream.repartition(max(partitions(table.sparkSession), shards * lanes), "shard", "lane").sortWithinPartitions("shard", "lane", "block")
    hits = dealt.mapInArrow(find, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _hits(graph: tuple, qid: np.ndarray, q: np.ndarray, k: int, ef: int) -> list[pa.Array]:
    """query_id, vec_id, score of the k nearest found in one shard, ties to the smaller id."""
    exact, x, levels, near, n_ids, every, _ = graph
    found = search(x, levels, near, (q / np.abs(q).max(axis=1, keepdims=True)).astype(np.float32), max(ef, k + 1))
    row, col = np.nonzero(found >= 0)
    node = found[row, col]
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("nd,nd->n", q[row], exact[node])
    # Nodes become their ids; an id of the query's own drops out.
    starts, times = np.cumsum(n_ids) - n_ids, n_ids[node]
    row, score = np.repeat(row, times), np.repeat(score, times)
    ids = every[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[node], times)]
    other = ids != qid[row]
    row, score, ids = row[other], score[other], ids[other]
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return [pa.array(qid[row[top]]), pa.array(ids[top]), pa.array(score[top])]
