import hashlib
import random

import numpy as np
import pytest
import xxhash

from varloom.llm import exact_dedup, simhash

DOCS = "doc_id long, text string, source string, fp string, digest string"


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "s", "x", None) for i, t in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup_equals_brute_force(spark):
    rows = [(1, "Ab C"), (7, "aB c"), (3, "ab c"), (4, ""), (5, None), (6, "É"), (8, "é"), (9, "x" * 50_000), (10, "X" * 50_000)]
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(docs(spark, rows), exact_dedup.DigestIndex(spark)).collect()}
    for i, t in rows:
        same = [j for j, u in rows if lower(u) == lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["digest"].hex() == hashlib.sha256(lower(t).encode()).hexdigest()


def test_index_persists_and_drops_what_it_has(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.deduplicate(docs(spark, [(1, "a"), (2, "b"), (3, "B")]), index)
    assert {r["doc_id"] for r in first.where("kept").collect()} == {1, 3}
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    second = {r["doc_id"]: r for r in exact_dedup.deduplicate(docs(spark, [(9, "A"), (10, "c")]), again).collect()}
    assert (second[9]["kept"], second[9]["keep_id"], second[10]["kept"]) == (False, 1, True)
    assert again.read().count() == 3
    assert [again.buckets, again.generation] == [4, 0]
    new = spark.createDataFrame([(bytearray(b"x"), 1)], "digest binary, keep_id long")
    plan = new.hint("merge").join(again.read(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_a_batch_that_is_run_again_has_the_same_result(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.deduplicate(docs(spark, [(1, "a")]), index, "first")
    batch = docs(spark, [(5, "a"), (6, "b"), (7, "B"), (8, "c")])
    results = [sorted(map(tuple, exact_dedup.deduplicate(batch, index, "second").drop("digest").collect())) for _ in range(3)]
    assert results[0] == [(5, 1, 1, False), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True)] and results == results[:1] * 3
    assert index.read().count() == 3
    assert {r["kept"] for r in exact_dedup.deduplicate(batch, index, "third").collect()} == {False}
    index.close()
    assert not spark.catalog.tableExists(index.table)


def test_index_that_outgrows_its_buckets_is_rewritten(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_FILES", 2)
    index = exact_dedup.DigestIndex(spark, buckets=2)
    for k in range(8):
        out = exact_dedup.deduplicate(docs(spark, [(100 * k + i, f"text {(k * 10 + i) % 60}") for i in range(20)]), index)
        assert out.where("kept").count() == (20 if k == 0 else 10 if k < 5 else 0)
    again = exact_dedup.DigestIndex(spark, index.path)
    assert (again.generation, again.buckets) == (index.generation, index.buckets) and again.generation > 0 and again.buckets == 16
    assert again.read().count() == 60 == again.read().select("digest").distinct().count()


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_parts_have_the_result_of_one_batch(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(30)]), rng.choice("abcdefghABC")) for _ in range(120)]
    d = docs(spark, rows)
    one = sorted(map(str, exact_dedup.deduplicate(d, exact_dedup.DigestIndex(spark)).drop("digest").collect()))
    assert sorted(map(str, exact_dedup.deduplicate_by_parts(d, exact_dedup.DigestIndex(spark), parts).drop("digest").collect())) == one
    assert exact_dedup.deduplicate_by_parts(d.limit(0), exact_dedup.DigestIndex(spark), parts).count() == 0


def test_repeated_rows_keep_one_and_empty_table(spark):
    d = docs(spark, [(1, "a"), (1, "a"), (None, "b"), (2, "c"), (2, "d")])
    kept = exact_dedup.keep_first(d, exact_dedup.DigestIndex(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "b"), (1, "a"), (2, "c"), (2, "d")]
    same = docs(spark, [(1, "Ab"), (1, "aB"), (1, "ab")])
    assert len({exact_dedup.keep_first(same.repartition(n), exact_dedup.DigestIndex(spark)).collect()[0]["text"] for n in (1, 2, 3)}) == 1
    none = exact_dedup.keep_first(d.limit(0), exact_dedup.DigestIndex(spark))
    assert none.count() == 0 and none.columns == d.columns


def slow_simhash(text, words=4):
    w = [x for x in "".join(lower(c) if c not in "\t\n\v\f\r" else " " for c in text or "").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius):
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= radius:
                    root[i] = root[j] = min(root[i], root[j])
    return {i: min(ids[k] for k in range(len(ids)) if root[k] == r) for i, r in zip(ids, root, strict=True)}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(30):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 60, 400]))]
        rows.append((10 * i, " ".join(w)))
        for k in range(1, rng.choice([1, 3, 5])):
            w[rng.randrange(len(w))] = "changed"
            rows.append((10 * i + k, "\t".join(w).upper()))
    rows += [(1001, None), (1002, " \n"), (1003, "É a"), (1004, "é A")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = [slow_simhash(t) for _, t in rows]
    assert {i: r["fp"].hex() for i, r in got.items()} == {i: f"{f:016x}" for (i, _), f in zip(rows, fps, strict=True)}
    assert {i: r["component_id"] for i, r in got.items()} == slow_components([i for i, _ in rows], fps, 4)
    assert len({r["component_id"] for r in got.values()}) < len(rows)


def test_cells_find_every_link_at_all_sizes():
    rng = np.random.default_rng(1)
    for n in (10, 10**6, 10**9):
        cells = simhash._cells(n, 4, 1)
        for _ in range(200):
            flips = rng.choice(64, 4, replace=False)
            assert any(not set(flips) & set(c) for c in cells)


@pytest.mark.parametrize("size", [5, 40, 400])
def test_linked_cells_have_the_components_of_all_pairs(size):
    rng = np.random.default_rng(size)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fp = np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in rng.choice(centre, size)], dtype=np.uint64)[:, None]
    found = simhash._link_sorted(np.zeros((size, 2), np.int64), fp, 4, simhash._mixed(1, 16).reshape(16, 1))
    assert len(found) < size

    def classes(pairs):
        root = {x: x for x in fp[:, 0].tolist()}
        for _ in range(size):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    values = fp[:, 0].tolist()
    close = [(a, b) for a in set(values) for b in set(values) if bin(a ^ b).count("1") <= 4]
    linked = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in found]
    for _ in range(1):
        assert classes(linked) == classes(close)


def test_keep_one_takes_near_copies_and_leaves_others(spark):
    rng = random.Random(3)
    base = [" ".join(f"t{rng.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    near = [" ".join(w if i not in (50, 150) else "other" for i, w in enumerate(b.split())) for b in base[:8]]
    half = [b[: len(b) // 2] + " ".join(f"u{rng.randrange(5000)}" for _ in range(150)) for b in base[8:12]]
    rows = list(enumerate(base)) + [(100 + i, t) for i, t in enumerate(near)] + [(200 + i, t) for i, t in enumerate(half)] + [(None, base[0]), (5, base[5])]
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20)) + [200, 201, 202, 203]
    assert simhash.keep_one(docs(spark, rows).limit(0)).count() == 0


def slow_similarity(a, b):
    of = lambda t: {tuple(w) for w in zip(*(t.split()[i:] for i in range(5)), strict=False)}
    return len(of(a) & of(b)) / len(of(a) | of(b))


def test_near_copies_are_told_by_their_shingle_sets(spark):
    rng, rows, expected = random.Random(9), [], set()
    for i in range(120):
        w = [f"t{rng.randrange(10**6)}" for _ in range(204)]
        # Shingles lost to other words at the end of the text: a similarity around 0.8, on both sides.
        k = rng.randrange(14, 33)
        a, b = " ".join(w), " ".join(w[: 204 - k] + [f"u{rng.randrange(10**6)}" for _ in range(k)])
        rows += [(2 * i, a), (2 * i + 1, b)]
        expected |= {2 * i} if slow_similarity(a, b) >= 0.8 else {2 * i, 2 * i + 1}
    assert 150 < len(expected) < 200
    line = "one line of boiler plate text that repeats itself over and over "
    rows += [(1000, line * 3 + "and an end of a few words"), (1001, line * 40 + "and an end of a few words")]
    got = {r["doc_id"] for r in simhash.keep_one(docs(spark, rows)).collect()}
    assert got == expected | {1000}


def family(rng, n, length=60, most=14):
    """Texts that are one text with some words changed."""
    w = [f"t{i}" for i in range(length)]
    out = []
    for _ in range(n):
        own = list(w)
        for k in rng.sample(range(length), rng.randrange(most)):
            own[k] = f"u{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return list(dict.fromkeys(out))


def test_groups_of_many_blocks_link_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(2)
    texts = family(rng, 90) + family(rng, 5, 200, 3)
    root = list(range(len(texts)))
    for _ in range(3):
        for i, a in enumerate(texts):
            for j, b in enumerate(texts[:i]):
                if slow_similarity(a, b) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < len(texts)


@pytest.mark.parametrize("sides", [1, 2])
def test_shared_counts_and_links_of_blocks(sides, monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 16)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    shared = simhash._shared(sets)
    side, near = np.arange(40) % sides, set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(set(a.tolist()) & set(b.tolist()))
            assert i == j or shared[i, j] == both
            if i != j and (sides == 1 or side[i] != side[j]) and both >= 0.5 * (len(a) + len(b) - both):
                near.add((min(i, j), max(i, j)))
    found = {(min(p), max(p)) for p in simhash._link_block(sets, side, 0.5)}
    assert found <= near and len(found) < 40

    def classes(pairs):
        root = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(found) == classes(near)


def test_one_document_stays_where_ids_are_null_or_shared(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"t{rng.randrange(5000)}" for _ in range(300)) for _ in range(3))
    rows = [(None, a), (None, a + " tail"), (None, a + " other tail"), (7, b), (7, b + " tail"), (8, b + " more"), (9, c), (9, c), (None, c + " tail")]
    kept = [(r["doc_id"], r["text"].split()[0]) for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a.split()[0]), (7, b.split()[0]), (9, c.split()[0])], key=str)
