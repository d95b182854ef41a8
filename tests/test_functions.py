import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varloom.functions import clinical, damage, sequence, variant
from varloom.sources import vcf


def ev(spark, column, **values):
    """The value of a Column over one row."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def many(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("ACGTNacgtn", max_size=30), min_size=30, max_size=30))
def test_reverse_complement_is_an_involution(spark, texts):
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    assert d.where(sequence.reverse_complement(sequence.reverse_complement(F.col("s"))) != F.col("s")).count() == 0


def test_codons(spark):
    assert len(sequence.CODONS) == 64 and sequence.CODONS["ATG"] == "M" and [c for c, a in sequence.CODONS.items() if a == "*"] == ["TAA", "TAG", "TGA"]
    assert ev(spark, sequence.translate(F.lit("ATGGCNTAAG"))) == "MX*"
    assert many(spark, [("CCN",), ("TAR",), ("NNN",), ("atg",)], "c string", sequence.amino_acid(F.col("c"))) == ["P", "*", "X", "M"]
    assert tuple(ev(spark, sequence.codon_at(F.lit("ATGGCA"), F.lit(4)))) == ("GCA", 2, "A", 2)
    assert ev(spark, sequence.codon_usage(F.lit("GCA"), F.lit("GCC"), {"GCA": 0.2, "GCC": 0.4})) == "up"
    assert ev(spark, sequence.to_three(F.lit("w"))) == "Trp" and ev(spark, sequence.to_one(F.lit("ter"))) == "*"


def test_motifs_do_not_overlap(spark):
    import re

    seqs = ["GGGGGGGGGGGGG", "AAGAAGAAGAAG", "ACGT", ""]
    for m in ("GGGGGG", "AAGAAG", "GT"):
        got = many(spark, [(s, m) for s in seqs], "s string, m string", sequence.motif_positions(F.col("s"), F.col("m")))
        assert got == [[x.start() for x in re.finditer(m, s)] for s in seqs]


def test_sequence_edits(spark):
    assert ev(spark, sequence.mutate(F.lit("ACGT"), F.lit(1), F.lit(2), F.lit("TTT"))) == "ATTTT"
    assert ev(spark, sequence.pad_or_clip(F.array(F.lit("a")), 3)) == ["a", ".", "."]
    ex = F.from_json(F.lit('[{"start":2,"end":5},{"start":8,"end":10}]'), "array<struct<start:int,end:int>>")
    assert ev(spark, sequence.spliced(F.lit("AACCCGGGTTT"), ex, F.lit("+"))) == "CCCTT" and ev(spark, sequence.spliced(F.lit("AACCCGGGTTT"), ex, F.lit("-"))) == "AAGGG"
    assert [tuple(x) for x in ev(spark, sequence.coding(ex, F.lit(4), F.lit(9)))] == [(4, 5), (8, 9)]
    assert ev(spark, sequence.first_coding_exon(F.array(*map(F.lit, (-1, 0, 2))))) == 1


@pytest.mark.parametrize(
    "pos, ref, alt, want",
    [(10, "A", "G", (10, 10, "A", "G")), (17961, "TGAGA", "T", (17962, 17965, "GAGA", "-")), (15903, "G", "GCAC", (15903, 15904, "-", "CAC")), (5, "AC", "GT", (5, 6, "AC", "GT")), (7, "ACG", "<DEL>", (7, 9, "ACG", "-"))],
)
def test_minimal_alleles(spark, pos, ref, alt, want):
    assert tuple(ev(spark, variant.minimal_alleles(F.lit(pos), F.lit(ref), F.lit(alt)))) == want


def test_decomposition(spark):
    d = lambda r, a: [tuple(x) for x in ev(spark, variant.decompose(F.lit(100), F.lit(r), F.lit(a)))]
    assert d("A", "G") == [("SNP", 100, "A", "G")]
    assert d("ACGT", "AGGC") == [("SNP", 101, "C", "G"), ("SNP", 103, "T", "C")]
    assert d("TACG", "TA") == [("DEL", 101, "ACG", "A")] and d("TACG", "TC") == [("COMPLEX_DEL", 101, "ACG", "C")]
    assert d("TA", "TACG") == [("INS", 101, "A", "ACG")]
    kind = lambda r, *a: ev(spark, variant.variant_type(F.lit(r), F.array(*map(F.lit, a))))
    assert [kind("A", "G"), kind("AC", "GT"), kind("AC", "A"), kind("A", "AC"), kind("A", "G", "GT")] == ["mismatch", "mnp", "del", "ins", "complex"]
    assert ev(spark, variant.deletion_span(F.lit("ACGT"), F.array(F.lit("A"), F.lit("ACGTT")))) == 3


def slow_phase(f, m, c):
    c1, c2 = c
    straight, crossed = c1 in f and c2 in m, c2 in f and c1 in m
    if straight and (c1 == c2 or not crossed):
        return f"{c1}|{c2}"
    return f"{c2}|{c1}" if crossed and not straight else f"{c1}/{c2}"


def test_phasing_against_set_logic(spark):
    gts = list(itertools.product("012", repeat=2))
    rows = [("/".join(f), "/".join(m), "/".join(c)) for f in gts for m in gts for c in gts]
    got = many(spark, rows, "f string, m string, c string", variant.phase(F.col("f"), F.col("m"), F.col("c")))
    assert got == [slow_phase(f.split("/"), m.split("/"), c.split("/")) for f, m, c in rows]
    assert all(sorted(g[::2]) == sorted(c[::2]) for g, (_, _, c) in zip(got, rows, strict=True))
    assert many(spark, [("0/0", "0/1", "0/1"), ("./.", "0/1", "0/1")], "f string, m string, c string", variant.phase(F.col("f"), F.col("m"), F.col("c"))) == ["0|1", "0/1"]
    assert ev(spark, variant.phase_one_parent(F.lit("1/1"), F.lit("0/1"), True)) == "1|0"
    assert ev(spark, variant.phase_x(F.lit("0/0"), F.lit("0/1"), F.lit("1/1"), F.lit(True))) == "1" and ev(spark, variant.phase_y(F.lit("1/1"), F.lit("1/1"))) == "1"


def test_votes_and_frequencies(spark):
    votes = [("5", 1), ("2|5", 0), ("2", -1), ("3,4", 0), ("3", -1), ("4", 1), ("255", 0), ("", 0)]
    assert many(spark, [(c,) for c, _ in votes], "c string", clinical.clinvar_vote(clinical.significance_codes(F.col("c")))) == [v for _, v in votes]
    assert many(spark, [(["DP", "DM"],), (["R"],), ([],), (["?"],)], "c array<string>", clinical.hgmd_vote(F.col("c"))) == [4, -1, 0, 0]
    rows = [(None, None, "novel"), (0.0, None, "rare"), (0.02, None, "frequent"), (0.0, 0.2, "frequent")]
    assert many(spark, rows, "a double, b double, w string", clinical.frequency_class([F.col("a"), F.col("b")], 0.01)) == [r[2] for r in rows]
    assert many(spark, [("0.1:0.01:.",), (".",), ("7",)], "t string", clinical.least_frequency(F.col("t"))) == [0.01, None, 1.0]
    assert tuple(ev(spark, clinical.hgvs(F.lit("NM_1.2(GENE):c.5A>G (p.Lys2Arg)")))) == ("NM_1.2", "c.5A>G", "p.Lys2Arg")
    assert many(spark, [("c.5+2A>G",), ("c.5-3A>G",), ("c.5A>G",)], "t string", clinical.near_splice_site(F.col("t"))) == [True, False, False]
    hits = [("UTR5", "hpm"), ("CodingExonic", "warn"), ("CodingExonic", "hpm"), ("CodingExonic", "hpm")]
    best = ev(spark, clinical.most_damaging(F.array(*[F.struct(F.lit(a).alias("region"), F.lit(b).alias("consequence")) for a, b in hits])))
    assert (best["r"], best["c"], best["i"]) == (5, 4, 3)


def test_damage_scalars(spark):
    for maf in (0.0, 1e-9, 1e-4, 0.01, 0.5, 1.0):
        y = 0.8 if maf == 0 else 0.0125 * math.log10(maf) ** 2 - 0.093 * math.log10(maf) - 0.298
        assert math.isclose(ev(spark, damage.frequency_offset(F.lit(maf))), 0.1 if y < 0 else min(y, 0.8))
    for x in (0.01, 0.5, 1.0, 3.7, 50.0):
        assert math.isclose(ev(spark, damage.log_gamma(F.lit(x))), math.lgamma(x), rel_tol=1e-11, abs_tol=1e-11)
    assert ev(spark, damage.bayes(F.lit(0.0), F.lit(0.7))) == 0
    weight = damage.allele_weight(F.lit("rare"), F.lit("hom"), F.lit(True))
    assert ev(spark, weight) == 0.375
    none = F.lit(None).cast("double")
    got = ev(spark, damage.variant_score(F.lit("c4en"), F.lit(0.0), F.lit(0.9), none, F.lit(0.2), F.lit(0.85), F.lit(100)))
    assert math.isclose(got, ((0.05 + 0.50 + 0.8 + 0.2) * 0.5 + 0.5 * 0.9) * 0.85 / 2)
    rows = [("g", "het", 1.0), ("g", "het", 3.0), ("g", "hom", 2.0), ("h", "hom", 1.0)]
    d = spark.createDataFrame(rows, "gene string, z string, s double")
    assert {r["gene"]: r["t"] for r in damage.gene_scores(d, "gene", "z", "s", "t").collect()} == {"g": 5.0, "h": 1.0}


def test_fits(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    d = spark.createDataFrame([("a", float(x)) for x in rng.beta(2, 5, 20000)], "aa string, v double")
    r = damage.beta_moments(d, "aa", "v").first()
    assert abs(r["a"] - 2) < 0.4 and abs(r["b"] - 5) < 1.2
    x = rng.normal(size=400)
    y = (x + rng.normal(size=400) > 0).astype(int)
    w, b = damage.logistic_1d(spark.createDataFrame([(float(p), int(q)) for p, q in zip(x, y, strict=True)], "x double, y int"), "x", "y")
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(((p - y) * x).sum() + w) < 1e-6 and abs((p - y).sum()) < 1e-6


def test_info_parse(spark):
    got = ev(spark, vcf.parse_info(F.lit("DB;AF=0.1,0.2;X=a=b;AF=9;.")))
    assert got == {"DB": None, "AF": "9", "X": "a=b"}
    assert vcf.quoted_split('ID=X,Description="a, b"') == ["ID=X", "Description=a, b"]


def test_chromosomes(spark):
    assert many(spark, [("chr1",), ("M",), ("chrX",), ("MT",)], "c string", variant.chrom_bare(F.col("c"))) == ["1", "MT", "X", "MT"]
    assert many(spark, [("1",), ("MT",)], "c string", variant.chrom_ucsc(F.col("c"))) == ["chr1", "chrM"]


def test_likelihood_fits_are_stationary(spark):
    import random

    draw = random.Random(3)
    rows = [(k, draw.betavariate(a, b) * 7 - 2) for k, (a, b) in {"x": (2.0, 5.0), "y": (0.6, 0.7), "z": (30.0, 2.0)}.items() for _ in range(400)]
    rows += [("one", 5.0), ("same", 1.0), ("same", 1.0), (None, 1.0), (None, 2.0), (None, 4.0), ("x", None)]
    got = {r["k"]: r for r in damage.beta_likelihood(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["one"]["a"] is None and got["same"]["b"] is None and got[None]["a"] > 0
    for k in ("x", "y", "z"):
        r, values = got[k], [v for h, v in rows if h == k and v is not None]
        z = [(v - r["loc"]) / r["scale"] for v in values]
        assert len(z) == r["n"] and 0 < min(z) and max(z) < 1
        l0, l1 = sum(map(math.log, z)) / len(z), sum(math.log(1 - x) for x in z) / len(z)
        like = lambda a, b: (a - 1) * l0 + (b - 1) * l1 + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        a, b, h = r["a"], r["b"], 1e-4
        assert abs(like(a + h, b) - like(a - h, b)) / (2 * h) < 1e-6 and abs(like(a, b + h) - like(a, b - h)) / (2 * h) < 1e-6
        assert like(a, b) >= max(like(a * 1.01, b), like(a / 1.01, b), like(a, b * 1.01), like(a, b / 1.01))
