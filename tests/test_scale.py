"""Shapes of plans and results whose cost must not grow faster than the input."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from varloom import storage
from varloom.operators import annotations, family, genes, intervals, network, phenotype
from varloom.sources import fasta, tables, vcf


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_motif_counts_send_the_motifs_and_not_the_windows(spark):
    mrnas = spark.range(3).select(F.col("id").cast("string").alias("name"), F.lit("GCATGGCATGGAAATTC").alias("sequence"))
    motifs = spark.createDataFrame([("GCATGG",), ("AAATTC",), ("GCATGG",)], "motif string")
    d = genes.motif_counts(mrnas, motifs, "n")
    joined = [line for line in plan(d).splitlines() if "HashJoin" in line]
    assert joined and all("BuildRight" in line for line in joined)
    assert {r["name"]: r["n"] for r in d.collect()} == {"0": 2, "1": 2, "2": 2}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("wide", [False, True])
def test_interval_joins_send_no_side_whole(spark, how, wide):
    points = spark.range(40).select(F.lit("1").alias("chrom"), F.col("id").cast("int").alias("pos"))
    ivs = spark.range(9).select(F.lit("1").alias("ichrom"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 1).alias("end"))
    ivs = ivs.withColumn("exons", F.array("start")) if wide else ivs
    d = intervals.point_join(points, ivs, "chrom", "pos", "ichrom", "start", "end", how=how)
    assert "Broadcast" not in plan(d)
    inside = 18
    assert d.count() == {"inner": inside, "left": 40, "left_semi": inside, "left_anti": 40 - inside}[how]


def test_disease_genes_join_one_row_for_each_concept_and_gene(spark):
    d = spark.createDataFrame([("D1", "C1"), ("D2", "C1"), ("D2", "C1")], "disease_id string, concept string")
    a = spark.range(50).select(F.lit("C1").alias("concept"), (F.col("id") % 2).cast("string").alias("gene"), F.col("id").cast("double").alias("score"))
    out = annotations.disease_genes(d, d, a, 3)
    assert sorted(map(tuple, out.collect())) == [("D1", "0", 48.0), ("D1", "1", 49.0), ("D2", "0", 48.0), ("D2", "1", 49.0)]
    text = plan(out)
    assert "max(score" in text[text.index("Join") :]


def _ontology(rng, n=60):
    """(is_a rows, ancestors by term): a graph in which some terms have two parents."""
    up = {t: {(t - 1) // 3} | ({(t - 1) // 5} if t % 4 == 0 else set()) for t in range(1, n)} | {0: set()}
    above = {}
    for t in range(n):
        above[t] = {t}.union(*(above[x] for x in up[t]))
    return [(t, x) for t in up for x in up[t]], above


def _lin(objects, above):
    under = {}
    for o, terms in objects.items():
        for x in set().union(*(above[t] for t in terms)):
            under.setdefault(x, set()).add(o)
    ic = {x: -math.log(len(o) / len(objects)) for x, o in under.items()}
    return lambda a, b: 2 * max([ic[x] for x in above[a] & above[b] if x in ic], default=0) / (ic[a] + ic[b]) if a in ic and b in ic and ic[a] + ic[b] else 0.0


def test_disease_similarity_by_blocks_of_terms_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    is_a, above = _ontology(rng)
    objects = {f"D{i}": set(rng.sample(range(60), rng.randint(1, 4))) for i in range(30)}
    patient = rng.sample(range(60), 17)
    lin = _lin(objects, above)
    raw = {o: max(sum(max(lin(a, b) for b in terms) for a in patient) / len(patient), sum(max(lin(a, b) for a in patient) for b in terms) / len(terms)) for o, terms in objects.items()}
    monkeypatch.setattr(phenotype, "TERMS", 5)
    monkeypatch.setattr(phenotype, "DISEASES", 8)
    made = {}
    plain = phenotype.materialize

    def counted(d, tag):
        out = plain(d, tag)
        made[tag] = made.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(phenotype, "materialize", counted)
    d = spark.createDataFrame([(o, t) for o, terms in objects.items() for t in terms], "disease_id string, term int")
    got = phenotype.disease_similarity(spark.createDataFrame([(t,) for t in patient], "term int"), d, spark.createDataFrame(is_a, "term int, parent int"))
    top = max(raw.values())
    assert {r["disease_id"]: pytest.approx(r["score"], abs=1e-12) for r in got.collect()} == {o: v / top for o, v in raw.items()}
    assert "term-sims" not in made  # pairs of terms are never rows


@pytest.mark.parametrize("k, least", [(2, 0.4), (40, 0.3)])
def test_similar_diseases_ask_again_only_for_those_without_enough(spark, monkeypatch, k, least):
    rng = random.Random(6)
    is_a, above = _ontology(rng)
    objects = {i: set(rng.sample(range(20, 60), rng.randint(1, 2))) for i in range(60)}
    lin = _lin(objects, above)
    mean = lambda p, q: sum(max(lin(a, b) for b in q) for a in p) / len(p)
    want = {}
    for o, p in objects.items():
        every = sorted((-round(max(mean(p, q), mean(q, p)), 9), e) for e, q in objects.items() if e != o)
        want[o] = [(e, -s) for s, e in every if -s >= least][:k]
    made = []
    plain = phenotype.materialize

    def counted(d, tag):
        out = plain(d, tag)
        if tag == "disease-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(phenotype, "materialize", counted)
    d = spark.createDataFrame([(o, t) for o, terms in objects.items() for t in terms], "disease_id int, term int")
    got = {}
    for r in phenotype.similar_diseases(d, spark.createDataFrame(is_a, "term int, parent int"), k, least).orderBy("disease_id", "place").collect():
        got.setdefault(r["disease_id"], []).append((r["other"], round(r["score"], 9)))
    assert [[s for _, s in got.get(o, [])] for o in want] == [[pytest.approx(s) for _, s in rows] for rows in want.values()]
    if k == 2:
        assert len(made) > 1 and made[0] < 60 * 59 / 4


def test_gene_scores_sort_no_gene_whole(spark):
    rows = [("D2", "g", 5.0), ("D1", "g", 5.0), ("D3", "g", 4.0), ("D1", "h", 1.0), ("D9", "x", 9.0)]
    d = spark.createDataFrame(rows, "disease_id string, gene string, score double")
    out = phenotype.gene_scores(d, spark.createDataFrame([("g",), ("h",)], "gene string"))
    assert "Window" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [("g", 5 / math.log(4), "D2"), ("h", 1 / math.log(5), "D1")]


def test_edges_are_summed_once_and_neither_sorted_nor_held(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.randrange(9), rng.randrange(7), float(rng.randint(1, 5))) for _ in range(200)]
    monkeypatch.setattr(network, "HELD_BYTES", 100)
    spark.createDataFrame(rows, "src int, dst int, w double").coalesce(1).write.parquet(f"{tmp_path}/edges")
    d, parts = spark.read.parquet(f"{tmp_path}/edges"), []
    plain = network.materialize
    monkeypatch.setattr(network, "materialize", lambda e, tag: parts.append(e.rdd.getNumPartitions()) or plain(e, tag))
    out = network.normalize_edges(d)
    assert parts[0] > 4  # more than spark.sql.shuffle.partitions: as many as the input asks for
    assert "SortMergeJoin" not in plan(out) and not [line for line in plan(out).splitlines() if "HashAggregate(keys=[src" in line and "dst" in line]
    e, r, c = {}, {}, {}
    for s, t, w in rows:
        e[s, t], r[s], c[t] = e.get((s, t), 0) + w, r.get(s, 0) + w, c.get(t, 0) + w
    assert {(x["src"], x["dst"]): pytest.approx(x["w"]) for x in out.collect()} == {(s, t): w / math.sqrt(r[s]) / math.sqrt(c[t]) for (s, t), w in e.items()}
    vector = spark.range(7).select(F.col("id").cast("int").alias("node"), F.lit(1.0).alias("value"))
    assert "SortMergeJoin" not in plan(network.multiply(out, vector))


def test_long_genotypes_parse_each_record_once(spark):
    lines = spark.createDataFrame([("1\t5\t.\tA\tC\t.\t.\t.\tGT:DP\t0/1:7\t1|1",), ("1\t6\t.\tA\tC\t.\t.\t.",)], "value string")
    out = vcf.long_genotypes(vcf.parse_records(lines, ["S1", "S2"]), ["pos"])
    assert "Filter" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(5, "S1", "DP", "7"), (5, "S1", "GT", "0/1"), (5, "S2", "DP", None), (5, "S2", "GT", "1|1")]


def test_disease_table_copies_no_rows_to_count_genes(spark):
    d = spark.createDataFrame([("D1", "", "a", 2.0), ("D1", "", "a", 2.0), ("D1", "", "b", 2.0), ("D1", "", "x", 2.0), ("D2", "", None, 1.0), ("D3", "", "a", 0.0)], "disease_id string, description string, gene string, score double")
    g = spark.createDataFrame([("a", 1.0, 1.0, True), ("b", 4.0, 4.0, False)], "gene string, seed_score double, predicted_score double, pathogenic boolean")
    out = phenotype.disease_table(d, g)
    assert "Expand" not in plan(out)
    assert [tuple(r) for r in out.select("disease_id", "genes", "n_genes", "n_mutated", "avg_seed", "max_seed").collect()] == [("D1", "a*^,b^,x", 3, 2, 2.0, 4.0), ("D2", "", 0, 0, None, None)]


def test_external_genes_come_from_pairs_of_genes(spark):
    d = spark.range(40).select(F.concat(F.lit("D"), F.col("id")).alias("disease_id"), F.lit("").alias("description"), F.lit("x").alias("gene"), F.lit(1.0).alias("score"))
    g = spark.createDataFrame([("a", 1.0, 1.0, False), ("b", 1.0, 1.0, False)], "gene string, seed_score double, predicted_score double, pathogenic boolean")
    edges = spark.createDataFrame([("x", "a"), ("b", "x"), ("x", "y")], "src string, dst string")
    paths = spark.createDataFrame([(n, f"p{i}") for n in "xay" for i in range(9)] + [("b", "q")], "gene string, pathway string")
    out = phenotype.disease_table(d, g, edges, paths)
    assert {r["external_genes"] for r in out.collect()} == {"a"}
    text = out._jdf.queryExecution().optimizedPlan().toString()
    at = text.index("collect_set(other")
    assert "Aggregate [gene" in text[at:].split("Join Inner")[1] or "Aggregate [gene" in text[at:].split("Join Inner")[2]  # pairs are distinct before they meet diseases


def test_downstream_sorts_once(spark):
    rows = [("g", "t", "CodingExonic", "FrameShiftInsert", 1, 1, "PASS", "0/1", "0/1", "1/1"), ("g", "t", "CodingExonic", "Syn", 2, 3, "PASS", "0/1", "0/1", "1/1"), ("g", "u", "CodingExonic", "Syn", 2, 3, "PASS", "0/1", "0/1", "1/1")]
    d = spark.createDataFrame(rows, "gene string, transcript string, region string, consequence string, pos int, size int, filter string, father string, mother string, child string")
    out = family.downstream(d)
    assert len([line for line in plan(out).splitlines() if "- Sort [" in line]) == 1
    assert sorted((r["haplotype"], r["pos"], r["running"]) for r in out.collect()) == [(1, 1, 1), (1, 2, 4), (2, 1, 1), (2, 2, 4)]


def test_bases_send_no_side_and_sort_as_many_rows_as_a_task_may(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "SORTED_BYTES", 1000)
    spark.range(90).select(F.concat(F.lit("p"), F.col("id") % 30).alias("chrom"), F.floor(F.col("id") / 30).cast("int").alias("chunk"), (F.floor(F.col("id") / 30) * 4).alias("offset"), F.lit("ACGT").alias("sequence")).write.parquet(f"{tmp_path}/c")
    want = spark.range(31).select(F.col("id").alias("row"), F.concat(F.lit("p"), "id").alias("chrom"), F.lit(2).alias("start"), F.lit(7).alias("n"))
    out = tables.bases(want, spark.read.parquet(f"{tmp_path}/c"), "chrom", "start", "n", 4)
    assert "Broadcast" not in plan(out)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^)]*?, (\d+)\)", plan(out))]
    assert dealt and min(dealt) == (90 * 104 + 90 * 100) // 1000 + 1  # 90 chunks of 4 bases, 31 rows on three chunks each, of which p30 has none
    assert {r["row"]: r["bases"] for r in out.collect()} == {i: "GTACGTA" if i < 30 else None for i in range(31)}


def test_large_indexes_of_sequences_are_not_sent(spark, tmp_path, monkeypatch):
    (tmp_path / "a.fa").write_text("".join(f">p{i}\nACGTA\nCG\n" for i in range(50)))
    found = storage.materialize(fasta.index(spark, str(tmp_path / "a.fa")), "fasta-index")
    want = spark.range(60).select(F.col("id").alias("row"), F.concat(F.lit("p"), "id").alias("chrom"), F.lit(3).alias("s"), F.lit(3).alias("n"))
    plans, plain = [], fasta.materialize
    monkeypatch.setattr(fasta, "materialize", lambda d, tag: plans.append(plan(d)) or plain(d, tag))
    for sent in (50, 49):
        monkeypatch.setattr(fasta, "SENT", sent)
        out = fasta.substrings(want, found, "chrom", "s", "n")
        assert "Broadcast" not in plan(out)
        assert {r["row"]: r["bases"] for r in out.collect()} == {i: "TAC" if i < 50 else None for i in range(60)}
    assert ["Broadcast" in p for p in plans] == [True, False]


def test_chunks_need_a_row_for_each_split_and_no_index(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    made, written = [("a", name, "".join(rng.choice("acgt") for _ in range(size))) for name, size in (("x", 900), ("y", 3), ("z", 0), ("x2", 400))], {}
    made += [("b", "x", "".join(rng.choice("acgt") for _ in range(333)))]  # a name that another file has too
    for file in "ab":
        (tmp_path / f"{file}.fa").write_text("no sequence yet\n" + "".join(f">{n} about\n" + "".join(s[i : i + 7] + "\n" for i in range(0, len(s), 7)) for f, n, s in made if f == file))
    plain = fasta.materialize
    monkeypatch.setattr(fasta, "materialize", lambda d, tag: written.setdefault(tag, plain(d, tag)))
    for split, chunk in ((100, 16), (100, 250), (64, 1), (10_000, 500)):
        written.clear()
        got = sorted(map(tuple, fasta.chunks(spark, str(tmp_path), chunk, split).collect()))
        assert got == sorted((n, k, k * chunk, s[k * chunk : (k + 1) * chunk].upper()) for _, n, s in made for k in range(-(-len(s) // chunk)))
        size = [(tmp_path / f"{file}.fa").stat().st_size for file in "ab"]
        assert set(written) == {"fasta-tails", "fasta-chunks"} and written["fasta-tails"].count() == sum(-(-n // split) for n in size)


def test_similarity_reads_the_annotations_once_and_deals_diseases_to_all_tasks(spark, monkeypatch):
    """Annotations that come from joins are computed once; before, several steps did so, and all diseases of up to 50,000 went through one task a block."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    is_a = spark.createDataFrame([(t, (t - 1) // 3) for t in range(1, 60)], "term long, parent long")
    rows = [(d, 59 - (d * k) % 59) for d in range(400) for k in (1, 7, 12)]
    dis = spark.createDataFrame(rows, "disease_id long, term long").mapInArrow(seen, "disease_id long, term long")
    groups, real = [], phenotype.materialize

    def kept(d, tag):
        out = real(d, tag)
        if tag == "forward":
            groups.append(out.select(F.spark_partition_id()).distinct().count())
        return out

    monkeypatch.setattr(phenotype, "materialize", kept)
    monkeypatch.setattr(phenotype, "FEW", 50, raising=False)
    patient = spark.createDataFrame([(t,) for t in range(20, 60, 2)], "term long")
    with_adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = phenotype.disease_similarity(patient, dis, is_a).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_adaptive)
    assert len(out) == 400 and read.value == len(rows) and groups[0] > 1
