import hashlib
import math

import numpy as np

from varloom.llm import ann, warc

PAGES = "page_id long, url string, html string, digest string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def test_warc_round_trip_and_revisits(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/é x\r\ny", big), (2, "http://b", big), (3, None, "small"), (4, "http://c", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (None, "u", other), (8, "u", "c" * 200_000), (9, "u", "d" * 999), (10, "u", "d" * 999)]
    index = warc.write(pages(spark, rows))
    assert index.count() == len(rows)
    got = {r["page_id"]: r for r in warc.read(index, index._varloom_warc).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        again = len(raw) >= 1000 and page != max(same)
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", max(same)) if again else ("response", None))
        assert r["payload"] == (None if again else raw)


def test_warc_reads_selected_records_only_and_empty_tables(spark):
    index = warc.write(pages(spark, [(i, "u", f"page {i}" * 50) for i in range(100)]))
    some = warc.read(index.where("page_id % 10 = 3"), index._varloom_warc).collect()
    assert sorted(r["page_id"] for r in some) == list(range(3, 100, 10))
    none = warc.write(pages(spark, []))
    assert none.count() == 0 and warc.read(none, none._varloom_warc).count() == 0


def test_payloads_are_passed_on_in_bounded_batches_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(warc, "HELD", 1000)
    index = warc.write(pages(spark, [(i, "u", f"{i} " * 500) for i in range(30)]))
    got = {r["page_id"]: r for r in warc.read(index, index._varloom_warc).collect()}
    assert {i: r["payload"].decode() for i, r in got.items()} == {i: f"{i} " * 500 for i in range(30)}
    bare = {r["page_id"]: r for r in warc.read(index, index._varloom_warc, payload=False).collect()}
    assert {i: (r["payload"], r["payload_digest"]) for i, r in bare.items()} == {i: (None, r["payload_digest"]) for i, r in got.items()}


def test_records_are_gzip_members_of_the_standard_form():
    import gzip

    html = b"<p>x</p>"
    digest = hashlib.sha1(html).hexdigest()
    raw = warc.record(7, "http://a", html, digest, None, False)
    text = gzip.decompress(raw)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(html + b"\r\n\r\n")
    assert warc.parse(raw)["payload"] == html
    assert gzip.decompress(raw + raw) == text * 2


def brute(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in rows if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")


def test_hnsw_recall_over_several_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    got = ann.nearest(table(spark, rows), k=10, every=50, shard_rows=1000).toPandas()
    want = brute(rows, 10, 50)
    hits = sum(len(set(got[got.query_id == q].vec_id) & set(w)) for q, w in want.items())
    assert hits / (10 * len(want)) >= 0.95
    of = dict(rows)
    for r in got.itertuples():
        assert math.isclose(r.score, float(np.dot(np.array(of[r.query_id]), np.array(of[r.vec_id]))), rel_tol=1e-12, abs_tol=1e-12)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300, 3)] + [(i, [float(c) for c in np.float32(rng.normal(size=3))]) for i in range(1, 300, 3)]
    odd = [(1000, None), (1020, [0.0, 0.0, 0.0]), (1040, [1.0, None, 2.0]), (1060, [1.0, float("nan"), 2.0]), (1080, [float("inf"), 1.0, 1.0]), (1100, [1.0]), (None, [9.0, 9.0, 9.0])]
    got = ann.nearest(table(spark, rows + odd), k=20, every=20).toPandas().sort_values(["query_id", "rank"])
    want = brute(rows, 20, 20)
    assert {q: list(g.vec_id) for q, g in got.groupby("query_id")} == want


def test_fewer_candidates_than_k_and_no_rows(spark):
    got = ann.nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])]), k=20, every=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(table(spark, []), k=20, every=20).count() == 0


def test_recall_with_production_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 64))
    x = np.float32(centres[rng.integers(0, 200, 20_000)] + 0.6 * rng.normal(size=(20_000, 64))).astype(np.float64)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {q: set(g.vec_id) for q, g in ann.nearest(d).toPandas().groupby("query_id")}
    queries = np.arange(0, 20_000, 20)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-score, 20, axis=1)[:, :20]
    recall = [len(got[q] & set(b)) / 20 for q, b in zip(queries.tolist(), best.tolist(), strict=True)]
    assert np.mean(recall) >= 0.95 and all(len(g) == 20 for g in got.values())


def test_vectors_of_any_finite_size_take_part(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)) * 10.0 ** rng.choice([-25, 25], 400)[:, None]
    big = [(i, v) for i, v in enumerate((np.abs(x) + x).tolist()) if any(v)]
    got = ann.nearest(spark.createDataFrame(big, "vec_id long, embedding array<double>"), k=5, every=20).toPandas()
    assert len(got) == 5 * sum(i % 20 == 0 for i, _ in big) and np.isfinite(got.score).all()
    small = [(i, (1e25 * v).tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))]
    got = ann.nearest(spark.createDataFrame(small, "vec_id long, embedding array<double>"), k=20, every=20).toPandas().sort_values(["query_id", "rank"])
    want = brute(small, 20, 20)
    assert np.mean([len(set(g.vec_id) & set(want[q])) / 20 for q, g in got.groupby("query_id")]) > 0.98 and len(got) == 400
