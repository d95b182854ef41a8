import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import aggregates, consequence, family, genes, intervals, network, phenotype, scan, sites

EX = "array<struct<start: int, end: int>>"


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 400)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id int, chrom string, pos int")


@pytest.fixture(scope="module")
def ivs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), s := rng.randrange(0, 400), s + rng.choice([0, 3, 40, 150]), float(rng.randrange(-3, 9))) for i in range(60)]
    return rows, spark.createDataFrame(rows, "iid int, ichrom string, start int, end int, score double")


@pytest.mark.parametrize("scale", [1, 97, 900_000])
@pytest.mark.parametrize("wide", [False, True])
def test_interval_joins_equal_brute_force(points, ivs, scale, wide):
    """At any scale, so that intervals lie on several levels, and with nested columns, which stay out of the binned tables."""
    (p, dp), (v, dv) = points, ivs
    p, v = [(i, c, x * scale) for i, c, x in p], [(i, c, s * scale, e * scale + (i % 3) * 5, w) for i, c, s, e, w in v]
    dp = dp.withColumn("pos", F.col("pos") * scale)
    dv = dv.withColumns({"start": F.col("start") * scale, "end": F.col("end") * scale + (F.col("iid") % 3) * 5})
    if wide:
        dp, dv = dp.withColumn("tags", F.array("id")), dv.withColumn("exons", F.array("iid"))
    args = ("chrom", "pos", "ichrom", "start", "end")
    want = sorted((a[0], b[0]) for a in p for b in v if a[1] == b[1] and b[2] <= a[2] <= b[3])
    got = intervals.point_join(dp, dv, *args)
    assert sorted((r["id"], r["iid"]) for r in got.collect()) == want and got.columns == [*dp.columns, *dv.columns]
    assert sorted(r["id"] for r in intervals.point_join(dp, dv, *args, how="left_semi").collect()) == sorted({a for a, _ in want})
    missed = {a[0] for a in p} - {a for a, _ in want}
    assert sorted(r["id"] for r in intervals.point_join(dp, dv, *args, how="left_anti").collect()) == sorted(missed)
    outer = intervals.point_join(dp, dv, *args, how="left").collect()
    assert sorted((r["id"], r["iid"] is None, r["iid"] or 0) for r in outer) == sorted([(a, False, b) for a, b in want] + [(a, True, 0) for a in missed])
    half = sorted((a[0], b[0]) for a in p for b in v if a[1] == b[1] and b[2] < a[2] <= b[3])
    assert sorted((r["id"], r["iid"]) for r in intervals.point_join(dp, dv, *args, bounds="(]").collect()) == half
    near = sorted((a[0], b[0]) for a in p for b in v if a[1] == b[1] and b[2] - 9 <= a[2] <= b[3] + 9)
    assert sorted((r["id"], r["iid"]) for r in intervals.point_join(dp, dv, *args, pad=9).collect()) == near
    other = dv.select(*[F.col(c).alias(f"b_{c}") for c in dv.columns])
    pairs = intervals.overlap_join(dv, other, "ichrom", "start", "end", "b_ichrom", "b_start", "b_end")
    assert sorted((r["iid"], r["b_iid"]) for r in pairs.collect()) == sorted((a[0], b[0]) for a in v for b in v if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    rows = intervals.binned(dv, "start", "end").groupBy("iid").count()
    assert rows.agg(F.max("count")).first()[0] <= 2  # however long an interval is
    for plan in (got, pairs):
        assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()


def test_best_score_flanks_merge_and_nearest(points, ivs):
    (p, dp), (v, dv) = points, ivs
    got = {r["id"]: r["score"] for r in intervals.best_score(dp, dv, ["id"], "chrom", "pos", "ichrom", "start", "end", "score").collect()}
    over = {a[0]: [b[4] for b in v if a[1] == b[1] and b[2] <= a[2] <= b[3] and b[4] > 0] for a in p}
    assert got == {k: max(x) for k, x in over.items() if x}
    rows = intervals.flanks(dp, dv, "chrom", "pos", "ichrom", "start", "end", 5).collect()
    place = lambda x, b: ("5p", b[2] - x) if x < b[2] else ("3p", x - b[3]) if x > b[3] else ("core", 0)
    assert sorted((r["id"], r["iid"], r["place"], r["distance"]) for r in rows) == sorted((a[0], b[0], *place(a[2], b)) for a in p for b in v if a[1] == b[1] and b[2] - 5 <= a[2] <= b[3] + 5)
    for parts in (None, 1, 13):
        islands = {(r["ichrom"], r["start"], r["end"], r["n"]) for r in intervals.merge(dv, "ichrom", "start", "end", parts).collect()}
        want = []
        for c in "ab":
            for s, e in sorted((b[2], b[3]) for b in v if b[1] == c):
                if want and want[-1][0] == c and s <= want[-1][2]:
                    want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
                else:
                    want.append((c, s, e, 1))
        assert islands == set(want)
    site = dv.select(F.col("ichrom").alias("sc"), F.col("start").alias("sp"), F.col("iid").alias("gene"))
    for r in intervals.nearest(dp, site, "chrom", "pos", "sc", "sp", "gene", 20).collect():
        before = [(b[2], b[0]) for b in v if b[1] == r["chrom"] and 0 < r["pos"] - b[2] <= 20]
        after = [(b[2], -b[0]) for b in v if b[1] == r["chrom"] and 0 < b[2] - r["pos"] <= 20]
        assert r["previous_gene"] == (max(before)[1] if before else None) and r["next_gene"] == (-min(after)[1] if after else None)


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_running_values_go_over_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(300)]
    d = scan.dealt(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], parts)
    for how in ("sum", "max", "last"):
        for inclusive in (True, False):
            got = {r["i"]: r["x"] for r in scan.running(d, ["g"], ["i"], "x", F.col("v"), how, inclusive).collect()}
            for g, i, _ in rows:
                before = [v for h, j, v in rows if h == g and (j < i or (inclusive and j == i)) and v is not None]
                want = sum(before) if how == "sum" else (max(before) if how == "max" else before[-1]) if before else None
                assert got[i] == want, (how, inclusive, i)
    assert [r["n"] for r in scan.numbered(spark.range(50).select((-F.col("id")).alias("k")), ["k"], "n").orderBy("k").collect()] == list(range(1, 51))


def test_one_island_over_all_partitions(spark):
    d = spark.range(500).select(F.lit("1").alias("c"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + F.when(F.col("id") == 0, 4003).otherwise(3)).alias("e"))
    got = sorted(map(tuple, intervals.merge(d, "c", "s", "e", 20).collect()))
    assert got[0] == ("1", 0, 4003, 401) and len(got) == 100
    plan = intervals.merge(d, "c", "s", "e", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan  # windows are by partition


def test_liftover(spark):
    chain = spark.createDataFrame([("1", 100, 199, "1", 1100, "+"), ("1", 300, 399, "2", 50, "-")], "from_chrom string, from_start int, from_end int, to_chrom string, to_start int, to_strand string")
    d = spark.createDataFrame([("1", 150), ("1", 250), ("1", 300)], "chrom string, pos int")
    assert [(r["to_chrom"], r["to_pos"]) for r in intervals.liftover(d, chain, "chrom", "pos").orderBy("pos").collect()] == [("1", 1150), (None, None), ("2", 149)]


def test_two_stage_lookup(spark):
    table = spark.createDataFrame([("1", 10, "A", "G", 0.1), ("1", 20, "C", "T", 0.2), ("1", 21, "G", "A", 0.3)], "chrom string, pos int, ref string, alt string, af double")
    v = spark.createDataFrame([(1, "1", 10, "A", "G"), (2, "1", 20, "CG", "TA"), (3, "1", 30, "C", "T"), (4, "1", 20, "CT", "TA")], "row int, chrom string, pos int, ref string, alt string")
    from varloom.functions.variant import decompose

    v = v.withColumn("parts", F.transform(decompose(F.col("pos"), F.col("ref"), F.col("alt")), lambda p: F.struct(F.lit("1").alias("chrom"), p["pos"].cast("int").alias("pos"), p["ref"].alias("ref"), p["alt"].alias("alt"))))
    got = sites.two_stage(v, table, ["chrom", "pos", "ref", "alt"], "parts", ["chrom", "pos", "ref", "alt"], "af", "row")
    assert {r["row"]: r["af"] for r in got.collect()} == {1: "0.1", 2: "0.2:0.3", 3: None, 4: "0.2:."}


def tx(spark):
    """A coding transcript on each strand: two exons, CDS ATG GCA | TGG TAA."""
    frames = [0, 0]
    plus = (1, "NM_1", "P", "1", "+", 100, 140, 104, 132, [(100, 110), (126, 140)], frames, "ATGGCATGGTAA")
    minus = (2, "NM_2", "M", "2", "-", 100, 140, 104, 132, [(100, 110), (126, 140)], frames, "ATGGCATGGTAA")
    none = (3, "NR_3", "N", "3", "+", 100, 140, 140, 140, [(100, 110), (126, 140)], [-1, -1], "")
    return spark.createDataFrame([plus, minus, none], f"gid int, accession string, gene string, chrom string, strand string, tx_start int, tx_end int, cds_start int, cds_end int, exons {EX}, frames array<int>, sequence string")


CASES = [  # chrom, start, end, ref, alt, region, consequence
    ("1", 105, 105, "A", "G", "CodingExonic", "StartLoss"),
    ("1", 110, 110, "A", "T", "CodingExonic", "Syn"),
    ("1", 109, 109, "C", "T", "CodingExonic", "NonSyn"),
    ("1", 128, 128, "G", "A", "CodingExonic", "StopGain"),
    ("1", 130, 130, "T", "C", "CodingExonic", "StopLoss"),
    ("1", 132, 132, "A", "G", "CodingExonic", "SynStop"),
    ("1", 108, 108, "G", "-", "CodingExonic", "FrameShiftDelete"),
    ("1", 108, 109, "-", "CC", "CodingExonic", "FrameShiftInsert"),
    ("1", 107, 108, "-", "TAA", "CodingExonic", "StopGain"),
    ("1", 107, 108, "-", "CCC", "CodingExonic", "NonFrameShiftInsert"),
    ("1", 102, 102, "A", "G", "UTR5", None),
    ("1", 135, 135, "A", "G", "UTR3", None),
    ("1", 115, 115, "A", "G", "CodingIntronic", None),
    ("1", 103, 106, "AAAA", "-", "UTR5_CodingExonic_boundary", "StartLoss"),
    ("2", 132, 132, "T", "A", "CodingExonic", "StartLoss"),
    ("2", 127, 127, "T", "A", "CodingExonic", "Syn"),
    ("2", 135, 135, "A", "G", "UTR5", None),
    ("3", 105, 105, "A", "G", "NonCodingExonic", None),
    ("3", 115, 115, "A", "G", "NonCodingIntronic", None),
]


def test_consequences_on_both_strands(spark):
    v = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], "id int, chrom string, start int, end int, ref string, alt string")
    # CDS bases of '+': 105-110, then 127-132; of '-': 132-127, then 110-105.
    got = {r["id"]: r for r in consequence.annotate(v.join(tx(spark), "chrom")).collect()}
    for i, c in enumerate(CASES):
        assert (got[i]["region"], got[i]["consequence"]) == (c[5], c[6]), c


def test_splice_sites(spark):
    d = spark.createDataFrame([(s, b, [(100, 110), (126, 140)]) for s in "+-" for b in (110, 111, 114, 124, 105)], f"strand string, base int, exons {EX}")
    got = [r["s"] for r in d.select(consequence.splice_site(F.col("base"), F.col("exons"), F.col("strand")).alias("s")).collect()]
    assert got[:5] == ["SpliceDonor", "SpliceDonor", "Exon1_SpliceDonor_5__Exon2_SpliceAcceptor_12", "SpliceAcceptor", None]
    assert got[5:8] == ["SpliceAcceptor", "SpliceAcceptor", "Exon1_SpliceDonor_12__Exon2_SpliceAcceptor_5"]


def test_gene_models(spark):
    t = tx(spark).withColumn("name", F.col("accession"))
    assert {r["gene"]: r["protein_len"] for r in genes.max_cds_length(t).collect()} == {"P": 4, "M": 4, "N": 480}
    assert {r["gene"]: r["length"] for r in genes.union_length(t).collect()} == {"P": 12, "M": 12}
    assert genes.defects(t).count() == 0
    codons = {(r["name"], r["codon"]): r["positions"] for r in genes.codon_map(t).collect()}
    assert codons["NM_1", 1] == [104, 105, 106] and codons["NM_2", 1] == [131, 130, 129] and codons["NM_1", 3] == [126, 127, 128]


def test_diffusion_equals_matrix(spark):
    rng = np.random.default_rng(4)
    a = rng.random((12, 12)) * (rng.random((12, 12)) < 0.4)
    e = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*a.nonzero(), strict=True)], "src long, dst long, w double")
    r, c = a.sum(1), a.sum(0)
    n = np.divide(a, np.sqrt(np.outer(r, c)), where=a > 0, out=np.zeros_like(a))
    edges = network.normalize_edges(e)
    assert all(math.isclose(x["w"], n[x["src"], x["dst"]]) for x in edges.collect())
    y = rng.random(12)
    y, off = y / (y.sum() + 0.5), 0.5 / (y.sum() + 0.5)
    vec = lambda v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "node long, value double")
    s, s0 = np.zeros(12), 0.0
    for _ in range(4):
        s, s0 = 0.98 * s + 0.02 * (0.9 * n @ s + 0.1 * y), 0.98 * s0 + 0.02 * 0.1 * off
        s, s0 = s / (s.sum() + s0), s0 / (s.sum() + s0)
    got = network.heat_diffusion(edges, vec(y), spark.createDataFrame([(99, float(off))], "node long, value double"), rounds=4).collect()
    assert math.isclose(sum(x["value"] for x in got), 1.0)
    assert all(math.isclose(x["value"], s0 if x["node"] == 99 else s[x["node"]], rel_tol=1e-9) for x in got)
    r0 = np.r_[1.0, 3.0, np.zeros(10)]
    rr, cc = r0 / 4, np.zeros(12)
    for _ in range(5):
        rr, cc = 0.75 * n @ cc + 0.25 * r0 / 4, 0.75 * n.T @ rr
    got = {x["node"]: x["value"] for x in network.bipartite_diffusion(e, vec(r0[:2]), rounds=5).collect()}
    assert all(math.isclose(got.get(i, 0.0), v, abs_tol=1e-12) for i, v in enumerate(rr))
    assert network.bipartite_diffusion(e, vec([0.0])).count() == 0
    assert abs(network.heat_diffusion(edges, vec(y / y.sum()), max_rounds=12).agg(F.sum("value")).first()[0] - 1) < 1e-9


def test_phenotype_similarity(spark):
    is_a = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("f", "c")], "term string, parent string")
    dis = spark.createDataFrame([("D1", "d"), ("D1", "f"), ("D2", "e"), ("D3", "f"), ("D4", "c")], "disease_id string, term string")
    got = {r["disease_id"]: r["score"] for r in phenotype.disease_similarity(spark.createDataFrame([("d",)], "term string"), dis, is_a).collect()}
    assert got["D1"] == 1.0 and 0 < got["D2"] < 1 and got.get("D3", 0.0) == 0.0
    pairs = {(r["term"], r["ancestor"]) for r in phenotype.closure(is_a).collect()}
    assert {("d", "a"), ("d", "b"), ("d", "d")} <= pairs and ("d", "c") not in pairs


def test_gene_scores_enrichment_and_combination(spark):
    dis = spark.createDataFrame([("D1", "g1", 0.9), ("D1", "g2", 0.9), ("D2", "g2", 0.8), ("D3", "x", 1.0)], "disease_id string, gene string, score double")
    mut = spark.createDataFrame([("g1",), ("g2",), ("g3",), ("g4",)], "gene string")
    sc = {r["gene"]: (r["score"], r["disease_id"]) for r in phenotype.gene_scores(dis, mut).collect()}
    assert math.isclose(sc["g1"][0], 0.9 / math.log(5)) and math.isclose(sc["g2"][0], max(0.9 / math.log(5), 0.8 / math.log(4)))
    pheno = phenotype.gene_scores(dis, mut).select("gene", "score")
    sim = spark.createDataFrame([("g3", "g1", 0.97, 3), ("g2", "g4", 0.99, 1)], "gene1 string, gene2 string, score double, denominator int")
    path = spark.createDataFrame([("g1", "p", 1.0), ("g3", "p", 1.0), ("g4", "q", 1.0)], "src string, dst string, w double")
    extra = {r["gene"]: r["score"] for r in phenotype.enrich(mut, pheno, dis, sim, path).collect()}
    top = max(s for s, _ in sc.values())
    assert set(extra) == {"g3"} and math.isclose(extra["g3"], top * 0.8)
    comb = {r["gene"]: r for r in phenotype.combine(spark.createDataFrame([("g1", 1.0), ("g9", 3.0)], "gene string, score double"), pheno).collect()}
    least = min(s for s, _ in sc.values()) * 1.25
    p = sc["g1"][0] / (sc["g1"][0] + least) / 2
    g = 0.25 / 2
    assert math.isclose(comb["g1"]["seed_score"], p * g / (p * g + (1 - p) * (1 - g)))


def test_disease_table(spark):
    dis = spark.createDataFrame([("D1", "one", "a", 0.9), ("D1", "one", "b", 0.9), ("D2", "two", "b", 0.0)], "disease_id string, description string, gene string, score double")
    g = spark.createDataFrame([("a", 0.5, 0.7, True), ("c", 0.1, 0.2, False)], "gene string, seed_score double, predicted_score double, pathogenic boolean")
    edges = spark.createDataFrame([("c", "b")], "src string, dst string")
    paths = spark.createDataFrame([("b", "p"), ("c", "p")], "gene string, pathway string")
    r = phenotype.disease_table(dis, g, edges, paths).collect()
    assert [(x["disease_id"], x["genes"], x["external_genes"], x["n_mutated"]) for x in r] == [("D1", "a*^,b", "c", 1)]


def test_family(spark):
    rows = [("G", "T", "CodingExonic", "FrameShiftInsert", 10, 1, "PASS", "0/1", "0/0", "0/1"), ("G", "T", "CodingExonic", "FrameShiftDelete", 20, -1, "PASS", "0/1", "0/0", "0/1"), ("G", "T", "CodingExonic", "NonSyn", 30, 0, "PASS", "0/0", "0/1", "0/1"), ("H", "U", "CodingExonic", "NonSyn", 1, 0, "LOW", "0/1", "0/0", "0/1")]
    d = spark.createDataFrame(rows, "gene string, transcript string, region string, consequence string, pos int, size int, filter string, father string, mother string, child string")
    got = family.downstream(d).orderBy("pos").collect()
    assert [(r["pos"], r["haplotype"], r["running"]) for r in got] == [(10, 1, 1), (20, 1, 0)]
    gt = spark.createDataFrame([("s", "chrX", "0/1")] * 10 + [("s", "chrY", "1/1")] + [("t", "chrX", "0/1"), ("t", "chrY", "./.")], "sample string, chrom string, gt string")
    assert {r["sample"]: r["male"] for r in family.sex(gt, "sample", "chrom", "gt").collect()} == {"s": True, "t": False}


def test_folds_and_runs(spark):
    d = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (-1, "a"), (-1, "a")])], "k int, i int, size int, e string")
    run = [r["running"] for r in aggregates.fold_until_restored(d, ["k"], ["i"], "size").orderBy("i").collect()]
    assert run == [1, 2, 3, 2, 1, 0]
    assert [(r["e"], r["n"]) for r in aggregates.run_lengths(d, ["k"], ["i"], "e").orderBy("run").collect()] == [("a", 2), ("b", 1), ("a", 3)]


@pytest.mark.parametrize("buckets", [2, 1024])
def test_percentiles_by_refinement_equal_numpy(spark, buckets):
    rng = random.Random(buckets)
    pick = {"ties": lambda: rng.choice([1.0, 2.0, 2.0, 7.5]), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300), "near": lambda: 1.0 + rng.randrange(5) * 2.0**-52, "all": lambda: rng.random()}
    rows = [(k, f()) for k, f in pick.items() for _ in range(25 if k != "all" else 400)] + [("one", 3.0), (None, 1.0), (None, 5.0), ("ties", None), ("ties", float("nan"))]
    at = {"a": 0.0, "b": 0.15, "c": 0.5, "d": 1.0}
    got = {r["k"]: r for r in aggregates.refined_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at, buckets).collect()}
    for k in [*pick, "one", None]:
        values = [v for h, v in rows if h == k and v is not None and v == v]
        for name, p in at.items():
            want = float(np.percentile(values, 100 * p))
            assert math.isclose(got[k][name], want, rel_tol=1e-12, abs_tol=1e-300) or abs(got[k][name] - want) <= 1e-9 * max(map(abs, values)), (k, name)
    assert aggregates.refined_percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", at).count() == 0


def test_kept_edges_are_made_again_only_when_an_input_is_newer(spark, tmp_path):
    import time

    source, out, made = tmp_path / "in.txt", f"file://{tmp_path}/edges", []
    source.write_text("x")
    raw = lambda: made.append(1) or spark.createDataFrame([("a", "b", 4.0), ("b", "a", 4.0), ("a", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, w double")
    y = spark.createDataFrame([("a", 0.7), ("c", 0.3)], "node string, value double")
    runs = []
    for turn in range(3):
        if turn == 2:
            time.sleep(1.1)
            source.write_text("y")
        edges = network.normalized(spark, raw, out, [str(source)])
        plan = edges.join(y.hint("merge"), F.col("dst") == F.col("node"))._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and len(made) == (1 if turn < 2 else 2)
        runs.append(sorted((r["node"], round(r["value"], 12)) for r in network.heat_diffusion(edges, y, rounds=2).collect()))
        network.drop(edges)
    assert runs[0] == runs[1] == runs[2] and abs(sum(v for _, v in runs[0]) - 1) < 1e-9


@pytest.mark.parametrize(("tolerance", "rounds"), [(1e-4, 60), (3e-3, 60), (1e-4, 1), (1e-4, 3)])
def test_settled_heat_equals_the_rounds(spark, tolerance, rounds):
    """A path longer than the powers that count, a part that no seed reaches, edges in one direction, and a prior off the network."""
    links = [(f"n{i}", f"n{i + 1}", 1.0 + i % 3) for i in range(40)]
    links += [(b, a, w) for a, b, w in links] + [("n0", "q", 2.0), ("x", "y", 1.0), ("y", "x", 1.0), ("n1", "n2", 4.0)]
    links = spark.createDataFrame(links, "src string, dst string, w double")
    y = spark.createDataFrame([("n0", 0.4), ("n0", 0.1), ("n3", 0.0), ("z", 0.2)], "node string, value double")
    y0 = spark.createDataFrame([("g", 0.3)], "node string, value double")
    want = network.heat_diffusion(network.normalize_edges(links), y, y0, tolerance=tolerance, max_rounds=rounds)
    got = network.settled_heat(links, y, y0, tolerance=tolerance, max_rounds=rounds)
    assert got._varloom_rounds == want._varloom_rounds
    a, b = ({(r["node"], r["on_network"]): r["value"] for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-14 for x in a)


def test_settled_heat_without_seeds_or_links(spark):
    none = spark.createDataFrame([], "node string, value double")
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    one = spark.createDataFrame([("a", 1.0)], "node string, value double")
    assert network.settled_heat(links, none).count() == 0
    assert [tuple(r) for r in network.settled_heat(links, none, one).collect()] == [("a", 1.0, False)]
    assert [tuple(r) for r in network.settled_heat(links.limit(0), one).collect()] == [("a", 1.0, True)]
    assert {r["value"] for r in network.settled_heat(links, spark.createDataFrame([("a", 0.0)], "node string, value double")).collect()} == {0.0}
