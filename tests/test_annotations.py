from pyspark.sql import functions as F

from varloom.operators import annotations as A


def test_predictions_prefer_the_site(spark):
    p = spark.createDataFrame([("1", 5, "G", 7, 0.2, "site"), ("1", 9, "G", 7, 0.9, "best"), ("1", 8, "G", 7, 0.5, "other")], "chrom string, pos int, gene string, aapos int, score double, pred string")
    v = spark.createDataFrame([("1", 5, "G", 7), ("1", 6, "G", 7), ("1", 6, "H", 7)], "chrom string, pos int, gene string, aapos int")
    got = {(r["pos"], r["gene"]): r["pred"] for r in A.effect_predictions(v, p, ["chrom", "pos"], ["gene", "aapos"], "score", ["pred"]).collect()}
    assert got == {(5, "G"): "site", (6, "G"): "best", (6, "H"): None}


def test_binding_sites_and_signals(spark):
    m = spark.createDataFrame([("mir", "NM_1", "aCgT", [10, 11, 12, 13])], "mirna string, refseq_acc string, align string, coords array<int>")
    v = spark.createDataFrame([("NM_1", p) for p in range(9, 15)], "tx string, pos int")
    assert sorted(r["pos"] for r in A.binding_sites(v, m, "tx", "pos").collect()) == [11, 13]
    s = spark.createDataFrame([("1", 10, 20, "NM_1", "uORF"), ("1", 10, 20, "NM_2", "uORF")], "schrom string, start int, end int, accession string, site string")
    d = v.withColumn("chrom", F.lit("1"))
    assert sorted(r["pos"] for r in A.transcript_signals(d, s, "chrom", "pos", "tx").collect()) == [10, 11, 12, 13, 14]


def test_clinical_records_take_the_first_known_accession(spark):
    rec = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["x"])], "row int, accessions array<string>")
    summary = spark.createDataFrame([("a", 1, "r"), ("b", 2, "q")], "accession string, variation_id int, review string")
    subs = spark.createDataFrame([(2, "lab2"), (2, "lab1")], "variation_id int, submitter string")
    got = {r["row"]: (r["accession"], r["review"], r["submitters"]) for r in A.clinical_records(rec, summary, subs).collect()}
    assert got == {1: ("b", "q", "lab1|lab2"), 2: (None, None, None)}


def test_transcripts_pack_and_unpack(spark):
    d = spark.createDataFrame([("v", "G", "NM_1", "c.(5_6)A>G"), ("v", "G", "NM_2", None), ("v", "H", "NM_3", "x")], "v string, gene string, tx string, cdna string")
    text = A.pack_transcripts(d, ["v"], "gene", ["tx", "cdna"])
    assert text.first()["transcripts"] == "G(NM_1:c.(5_6)A>G|NM_2:);H(NM_3:x)"
    got = text.select(A.unpack_transcripts(F.col("transcripts"), ["tx", "cdna"]).alias("t")).first()["t"]
    assert [(g["gene"], [dict(t) for t in g["transcripts"]]) for g in got] == [("G", [{"tx": "NM_1", "cdna": "c.(5_6)A>G"}, {"tx": "NM_2", "cdna": ""}]), ("H", [{"tx": "NM_3", "cdna": "x"}])]


def test_text_helpers(spark):
    d = spark.createDataFrame([("January",), ("mar",), ("nope",)], "m string").select(A.month_number(F.col("m")).alias("n"))
    assert [r["n"] for r in d.collect()] == [1, 3, None]
    ft = spark.createDataFrame([(1, ["ID x", "FT   uORF            10..25", 'FT                   /evid="yes"', "FT   IRES            1..5"])], "record int, lines array<string>")
    got = A.feature_table(ft).orderBy("feature").collect()
    assert [(r["type"], r["start"], r["end"], [tuple(q) for q in r["qualifiers"]]) for r in got] == [("uORF", 10, 25, [("evid", "yes")]), ("IRES", 1, 5, [])]
    ttl = [(["<http://x/D1> a", "  skos:exactMatch <http://y/C001> ;", "  skos:exactMatch <http://y/C002> ."],), (["<http://x/D2> a"],)]
    m = A.concept_mapping(spark.createDataFrame(ttl, "lines array<string>"))
    assert sorted(map(tuple, m.collect())) == [("D1", "C001"), ("D1", "C002")]
    n = A.clinvar_summary(spark.createDataFrame([("NM_1.2(G):c.5+2A>G",)], "names string"), "names").first()
    assert (n["transcript"], n["cdna"], n["near_splice"]) == ("NM_1.2", "c.5+2A>G", True)
    assert tuple(A.proband_ped(spark, "S", True).first())[4:] == (1, 2)
    s = spark.createDataFrame([(5, "0/1"), (50, "0/1"), (50, "./."), (None, "0/1")], "dp int, gt string")
    assert A.sample_filter(s, F.col("dp"), 10, F.col("gt")).count() == 1
