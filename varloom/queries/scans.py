"""Scans and sinks: tables are written in the raw formats to the shared folder and read back by the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators import aggregates, annotations, genes, scan, sites
from varloom.queries.base import Tables, query
from varloom.queries.models import _TX, _transcripts
from varloom.sources import fasta, sinks, tables, vcf
from varloom.sources import lines as splits
from varloom.storage import fresh_path, materialize


def _written(t: Tables, lines: DataFrame, tag: str, **options: str) -> str:
    path = fresh_path(t.spark, tag)
    lines.write.options(**options).text(path)
    return path


def _tabbed(*fields: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


_HEADER = [
    "##fileformat=VCFv4.1",
    '##INFO=<ID=SZ,Number=1,Type=Integer,Description="Size, in all">',
    '##INFO=<ID=BR,Number=1,Type=String,Description="Brand">',
    '##INFO=<ID=LS,Number=.,Type=Float,Description="List">',
    '##INFO=<ID=FL,Number=0,Type=Flag,Description="Flag">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2",
]


def _records(t: Tables) -> DataFrame:
    c = F.col
    k, s = c("p_partkey"), c("p_size")
    entry = lambda key, value: F.struct(F.lit(key).alias("k"), value.cast("string").alias("v"))
    info = F.map_from_entries(F.concat(F.array(entry("SZ", s), entry("BR", c("p_brand")), entry("LS", F.concat(s, F.lit(",0.5")))), F.when(s % 2 == 0, F.array(entry("FL", F.lit(None)))).otherwise(F.array().cast("array<struct<k: string, v: string>>"))))
    sample = lambda gt, dp: F.map_from_arrays(F.array(F.lit("GT"), F.lit("DP")), F.array(gt, dp.cast("string")))
    return t.part.select(
        F.concat(F.lit("chr"), k % 22 + 1).alias("chrom"), (k + 1).cast("int").alias("pos"), F.when(k % 2 == 0, F.array(F.concat(F.lit("rs"), k))).otherwise(F.array().cast("array<string>")).alias("id"), F.lit("A").alias("ref"), F.when(s % 3 == 0, F.array(F.lit("G"), F.lit("T"))).otherwise(F.array(F.lit("C"))).alias("alt"),
        (s % 5).cast("double").alias("qual"), F.when(s > 25, F.array(F.lit("PASS"))).otherwise(F.array(F.lit("LOW"), F.lit("Q10"))).alias("filter"), info.alias("info"),
        F.create_map(F.lit("S1"), sample(F.lit("0/1"), s), F.lit("S2"), sample(F.when(s % 4 == 0, "./.").otherwise("1|1"), s + 1)).alias("genotypes"),
    )


@query("""SELECT 'chr' || CAST(p_partkey % 22 + 1 AS VARCHAR) AS chrom, CAST(p_partkey + 1 AS INTEGER) AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'rs' || CAST(p_partkey AS VARCHAR) ELSE '' END AS ids, CASE WHEN p_size % 3 = 0 THEN 'G,T' ELSE 'C' END AS alts, CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS DOUBLE) END AS qual,
    CASE WHEN p_size > 25 THEN 'PASS' ELSE 'LOW;Q10' END AS filters, p_size AS size, p_brand AS brand, CAST(p_size AS DOUBLE) + 0.5 AS listed, p_size % 2 = 0 AS flag, CASE WHEN p_size % 4 = 0 THEN './.' ELSE '1|1' END AS gt, p_size + 1 AS depth FROM part""")
def vcf_round_trip(t: Tables):
    """Records written as VCF and read back with one of two samples, typed by the header."""
    path = fresh_path(t.spark, "vcf")
    vcf.write_vcf(_records(t), vcf.Header.parse(_HEADER), path)
    d, header = vcf.read_vcf(t.spark, path, ["S2"])
    d = vcf.typed_format(vcf.typed_info(d, header), header, "S2", "f_")
    return d.select("chrom", "pos", F.array_join("id", ",").alias("ids"), F.array_join("alt", ",").alias("alts"), "qual", F.array_join("filter", ";").alias("filters"), F.col("info_SZ").alias("size"), F.col("info_BR").alias("brand"), F.aggregate("info_LS", F.lit(0.0), lambda a, b: a + b).alias("listed"), F.col("info_FL").alias("flag"), F.col("f_GT").alias("gt"), F.col("f_DP").alias("depth"))


@query("""SELECT 'B' || replace(p_brand, '#', '') AS id, 'Integer' AS type, '1' AS count, 'Parts, ' || CAST(count(*) AS VARCHAR) || ' of them' AS description FROM part GROUP BY p_brand
    UNION ALL SELECT unnest(['SZ', 'BR', 'LS', 'FL']), unnest(['Integer', 'String', 'Float', 'Flag']), unnest(['1', '1', '.', '0']), unnest(['Size, in all', 'Brand', 'List', 'Flag'])""")
def vcf_header(t: Tables):
    """Header lines with quoted commas and definitions from a table, written, read from the file's head and parsed."""
    path = fresh_path(t.spark, "vcf")
    header = vcf.Header.parse(_HEADER)
    brand = F.concat(F.lit("B"), F.replace("p_brand", F.lit("#"), F.lit("")))
    header.define("INFO", t.part.groupBy(brand.alias("id")).agg(F.concat(F.lit("Parts, "), F.count(F.lit(1)), F.lit(" of them")).alias("description")).withColumns({"type": F.lit("Integer"), "count": F.lit("1")}))
    vcf.write_vcf(_records(t), header, path)
    return vcf.info_table(t.spark, vcf.read_header(t.spark, path))


@query("""WITH x AS (SELECT p_partkey, unnest(['S1', 'S2']) AS sample, unnest([p_size, p_size + 1]) AS dp, unnest(['0/1', CASE WHEN p_size % 4 = 0 THEN './.' ELSE '1|1' END]) AS gt FROM part)
    SELECT CAST(p_partkey + 1 AS INTEGER) AS pos, sample, 'DP' AS key, CAST(dp AS VARCHAR) AS value FROM x UNION ALL SELECT CAST(p_partkey + 1 AS INTEGER), sample, 'GT', gt FROM x""")
def vcf_long_genotypes(t: Tables):
    lines = vcf.format_records(_records(t), ["S1", "S2"])
    return vcf.long_genotypes(vcf.parse_records(lines, ["S1", "S2"]), ["pos"])


@query("""SELECT CAST(p_partkey + 1 AS INTEGER) AS pos, unnest(CASE WHEN p_size % 3 = 0 THEN ['G', 'T'] ELSE ['C'] END) AS alt, CAST(unnest(CASE WHEN p_size % 3 = 0 THEN [1, 2] ELSE [1] END) AS INTEGER) AS alt_no FROM part""")
def vcf_alleles(t: Tables):
    return vcf.explode_alts(_records(t)).select("pos", "alt", "alt_no")


@query("""SELECT 'chr' || CAST(p_partkey % 22 + 1 AS VARCHAR) AS chrom, CAST(p_partkey AS INTEGER) AS "start", CAST(p_partkey + p_size AS INTEGER) AS "end", p_brand AS name, CAST(p_size AS DOUBLE) AS score, CASE p_size % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' END AS strand FROM part WHERE p_size % 10 <> 9""")
def bed_scan(t: Tables):
    """BED lines, gzipped, among comments, unknown chromosomes and intervals that end before they start."""
    c = F.col
    good = _tabbed(F.concat(F.lit("chr"), c("p_partkey") % 22 + 1), c("p_partkey"), c("p_partkey") + c("p_size"), c("p_brand"), c("p_size"), F.element_at(F.array(*map(F.lit, "+-.")), (c("p_size") % 3 + 1).cast("int")))
    bad = F.when(c("p_partkey") % 3 == 0, "track name=x").when(c("p_partkey") % 3 == 1, "scaffold 1 2").otherwise("chr1\t9\t2")
    path = _written(t, t.part.select(F.when(c("p_size") % 10 == 9, bad).otherwise(good).alias("value")), "bed", compression="gzip")
    return tables.bed(t.spark, path)


@query(f"""WITH {_TX} SELECT 'NM_' || CAST(k AS VARCHAR) AS name, number, CAST(s0 AS INTEGER) AS "start", CAST(e0 AS INTEGER) AS "end", gene FROM ex""")
def genepred_scan(t: Tables):
    """Transcripts as genePred lines and back; exons are numbered along the strand."""
    c = F.col
    listed = lambda part: F.concat(F.array_join(F.transform("exons", lambda e: e[part].cast("string")), ","), F.lit(","))
    name = F.concat(F.lit("NM_"), c("gid"))
    line = _tabbed(F.lit(0), name, F.concat(F.lit("chr"), c("chrom")), c("strand"), c("tx_start"), c("tx_end"), c("cds_start"), c("cds_end"), F.lit(2), listed("start"), listed("end"), F.lit(0), c("gene"), F.lit("cmpl"), F.lit("cmpl"), listed("frame"))
    d = tables.genepred(t.spark, _written(t, _transcripts(t).select(line.alias("value")), "genepred"))
    return d.select("name", "gene", F.explode("exons").alias("e")).select("name", F.col("e.number").alias("number"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), "gene")


_SEQ = "repeat(translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'ACGTACGTACGTACGTACGTACGTACG'), 9)"


@query(f"SELECT p_partkey, substr({_SEQ}, CAST(p_size + 1 AS BIGINT), 30) AS bases FROM part")
def fasta_substrings(t: Tables):
    """A sequence for each part in lines of 20 bases, cut into chunks of 16, and substrings over the chunks."""
    c = F.col
    seq = F.expr(_SEQ)
    text = F.concat(F.lit(">p"), c("p_partkey"), F.lit(" part\n"), F.array_join(F.regexp_extract_all(F.lower(seq), F.lit(".{1,20}"), F.lit(0)), "\n"))
    chunks = tables.fasta(t.spark, _written(t, t.part.select(text.alias("value")), "fasta"), 16)
    wanted = t.part.select(c("p_partkey").alias("row"), F.concat(F.lit("p"), c("p_partkey")).alias("chrom"), c("p_size").alias("start"), F.least(F.lit(30), F.length(seq) - c("p_size")).alias("n"))
    return tables.bases(wanted, chunks, "chrom", "start", "n", 16).select(c("row").alias("p_partkey"), "bases")


@query(f"""WITH x AS (SELECT p_partkey, p_partkey % 2 = 0 AS fwd, {_SEQ} AS s FROM part), y AS (SELECT *, substr(s, 3, 10) || substr(s, 21, 7) AS j FROM x) SELECT CAST(p_partkey AS INTEGER) AS gid, CAST(len(j) AS INTEGER) AS seq_len, CASE WHEN fwd THEN j ELSE reverse(translate(j, 'ACGT', 'TGCA')) END AS sequence FROM y""")
def spliced_mrna(t: Tables):
    c = F.col
    chunks = t.part.select(F.concat(F.lit("p"), c("p_partkey")).alias("chrom"), F.posexplode(F.regexp_extract_all(F.expr(_SEQ), F.lit(".{1,16}"), F.lit(0))).alias("chunk", "sequence")).withColumn("offset", c("chunk") * 16)
    chunks = materialize(chunks, "chunks")
    exon = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    tx = t.part.select(c("p_partkey").cast("int").alias("gid"), F.concat(F.lit("t"), c("p_partkey")).alias("name"), F.concat(F.lit("p"), c("p_partkey")).alias("chrom"), F.when(c("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.array(exon(2, 12), exon(20, 27)).alias("exons"))
    return genes.mrna(tx, chunks, 16).select("gid", "seq_len", "sequence")


@query("SELECT 'P' || CAST(p_partkey AS VARCHAR) AS accession, 'G' || CAST(p_size AS VARCHAR) AS gene, CAST(600000 + p_partkey AS VARCHAR) AS mim_id FROM part WHERE p_size % 2 = 0")
def swissprot_records(t: Tables):
    """A flat file with a record for each part; every second one names a phenotype."""
    c = F.col
    mim = F.when(c("p_size") % 2 == 0, F.concat(F.lit("DR   MIM; "), 600000 + c("p_partkey"), F.lit("; phenotype.\n"))).otherwise("DR   MIM; 1; gene.\n")
    text = F.concat(F.lit("ID   X\nAC   P"), c("p_partkey"), F.lit(";\nGN   Name=G"), c("p_size"), F.lit(" {E};\n"), mim, F.lit("//"))
    return tables.uniprot(tables.record_scan(t.spark, _written(t, t.part.select(text.alias("value")), "swissprot"), "swissprot"))


@query("""SELECT 'P' || CAST(p_partkey AS VARCHAR) AS id, unnest(['UTR5', 'uORF']) AS type, CAST(unnest([1, p_size]) AS INTEGER) AS "start", CAST(unnest([p_size, p_size + 30]) AS INTEGER) AS "end" FROM part""")
def feature_tables(t: Tables):
    c = F.col
    text = F.concat(F.lit("ID   P"), c("p_partkey"), F.lit("\nFT   UTR5            1.."), c("p_size"), F.lit('\nFT                   /note="a b"\nFT   uORF            '), c("p_size"), F.lit(".."), c("p_size") + 30, F.lit("\n//"))
    recs = tables.record_scan(t.spark, _written(t, t.part.select(text.alias("value")), "utr"), "utr")
    ident = recs.select("file", "record", F.regexp_extract(F.get("lines", F.lit(0)), r"ID\s+(\S+)", 1).alias("id"), F.concat_ws(":", "file", "record").alias("key"), "lines")
    feats = annotations.feature_table(ident.select(F.col("key").alias("record"), "lines"))
    return feats.join(ident.select(F.col("key").alias("record"), "id"), "record").select("id", "type", "start", "end")


@query("SELECT s_name AS gene, 'excl' AS mode FROM supplier WHERE s_nationkey > 12 UNION ALL SELECT s_name, 'incl' FROM supplier WHERE s_nationkey <= 12")
def gene_list_sections(t: Tables):
    """Lists of many short sections, in many files; the genes of one mode are spread over all of them."""
    mode = F.when(F.col("s_nationkey") > 12, "excl").otherwise("incl")
    path = _written(t, t.supplier.select(F.concat(F.lit("#"), mode, F.lit("\n\n"), "s_name").alias("value")), "genes")
    return tables.gene_list(t.spark, path).select("gene", "mode")


@query("SELECT s_name AS item FROM supplier")
def listed_items(t: Tables):
    return tables.listing(t.spark, _written(t, t.supplier.select(F.concat(F.lit("# note\n\n  "), "s_name").alias("value")), "list"))


@query("""SELECT CAST(p_partkey AS INTEGER) AS pos, CAST(p_size AS INTEGER) AS pos_aa, CAST(least(0.5, p_size / 100.0) AS DOUBLE) AS sift_score, CAST(greatest(0.2, p_size / 60.0) AS DOUBLE) AS pp2_score, CASE WHEN p_size / 100.0 < 0.5 THEN 'T2' ELSE 'T1' END AS transcript FROM part""")
def effect_table_scan(t: Tables):
    c = F.col
    d = t.part.select(F.lit("1").alias("chrom"), c("p_partkey").cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), c("p_brand").alias("gene"), F.lit("T1;T2").alias("transcript"), F.concat(c("p_size"), F.lit(";"), c("p_size")).alias("aapos"), F.concat(F.lit("0.5;"), c("p_size") / 100.0).alias("sift_score"), F.concat(c("p_size") / 60.0, F.lit(";0.2")).alias("pp2_score"))
    return tables.nsfp(d).select("pos", "pos_aa", "sift_score", "pp2_score", "transcript")


@query("""SELECT p_partkey, snp, unnest([p_brand, 'G2']) AS gene, 'GWAS' AS refdb FROM (SELECT p_partkey, p_brand, unnest(['rs' || CAST(p_partkey AS VARCHAR), 'rs' || CAST(p_size AS VARCHAR)]) AS snp FROM part WHERE p_size > 20)""")
def association_catalogue(t: Tables):
    c = F.col
    snps = F.when(c("p_size") > 20, F.concat(F.lit("rs"), c("p_partkey"), F.lit("; rs"), c("p_size"))).otherwise("none")
    d = t.part.select("p_partkey", snps.alias("snps"), F.concat(c("p_brand"), F.lit(" / G2")).alias("genes"))
    return tables.catalogue(d, "snps", "genes", "GWAS").select("p_partkey", "snp", "gene", "refdb")


@query("SELECT DISTINCT 'U' || CAST(p_size AS VARCHAR) AS uniprot, p_brand AS gene FROM part")
def gene_annotation_pairs(t: Tables):
    lines = t.part.select(F.concat(F.lit("!comment\nUniProtKB\tU"), "p_size", F.lit("\t"), "p_brand", F.lit("\tx")).alias("value"))
    return tables.goa(t.spark, _written(t, lines, "goa"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS disease_id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS genes, 'HP:' || CAST(o_custkey AS VARCHAR) AS hpos, 'about ' || CAST(o_custkey AS VARCHAR) AS description FROM orders GROUP BY o_custkey""")
def disease_catalogue(t: Tables):
    c = F.col
    d = t.orders.select(_tabbed(F.concat(F.lit("OMIM:"), c("o_custkey")), c("o_orderpriority"), F.lit(1), F.concat(F.lit("HP:"), c("o_custkey")), F.lit("x")).alias("value"))
    a = t.orders.select("o_custkey").distinct().select(_tabbed(F.lit("OMIM"), c("o_custkey"), F.concat(F.lit("about "), c("o_custkey"))).alias("value"))
    out = tables.diseases(t.spark, _written(t, d, "diseases"), _written(t, a, "descriptions"))
    return out.select(F.split_part("disease_id", F.lit(":"), F.lit(2)).alias("disease_id"), F.array_join("genes", "|").alias("genes"), F.array_join("hpos", "|").alias("hpos"), "description")


@query("SELECT DISTINCT 'OMIM:' || CAST(o_custkey AS VARCHAR) AS disease_id, 'HP:' || o_orderstatus AS hpo_id FROM orders WHERE o_orderpriority <> '5-LOW'")
def phenotype_annotations(t: Tables):
    c = F.col
    line = _tabbed(F.lit("OMIM"), c("o_custkey"), F.lit("name"), F.when(c("o_orderpriority") == "5-LOW", "NOT"), F.concat(F.lit("HP:"), c("o_orderstatus")), *[F.lit("x")] * 9)
    return tables.hpo(t.spark, _written(t, t.orders.select(line.alias("value")), "hpo"))


def _with_header(t: Tables, rows: DataFrame, tag: str, sep: str) -> str:
    """Write rows so that each file begins with a line of the columns' names."""
    path = fresh_path(t.spark, tag)
    rows.write.option("sep", sep).option("header", True).csv(path)
    return path


@query("SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS src, 'P' || CAST(l_partkey AS VARCHAR) AS dst, l_quantity * 20 AS w FROM lineitem WHERE l_quantity * 20 >= 350")
def protein_network(t: Tables):
    c = F.col
    links = t.lineitem.select(F.concat(F.lit("9606.P"), c("l_suppkey")).alias("protein1"), F.concat(F.lit("9606.P"), c("l_partkey")).alias("protein2"), (c("l_quantity") * 20).alias("combined_score"))
    return tables.string_links(t.spark, _with_header(t, links, "string", " "))


@query("SELECT p_brand AS gene, arg_min(p_type, p_partkey) AS first_type, arg_max(p_type, p_partkey) AS last_type FROM part GROUP BY 1")
def first_and_last_names(t: Tables):
    d = t.part.withColumnRenamed("p_brand", "gene")
    last = tables.last_of(d, "gene", "p_type", "p_partkey").withColumnRenamed("p_type", "last_type")
    return tables.first_of(d, "gene", "p_type", "p_partkey").withColumnRenamed("p_type", "first_type").join(last, "gene")


@query("""SELECT DISTINCT o_orderpriority AS gene, 'h' || CAST(o_custkey AS VARCHAR) AS pathway, CAST(1.0 AS DOUBLE) AS w FROM orders""")
def pathway_table(t: Tables):
    c = F.col
    rows = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_set("o_orderpriority"), ",").alias("genes"))
    rows = rows.select(F.concat(F.lit("h"), c("o_custkey")).alias("hsa_id"), F.lit("path").alias("pathway_desc"), "genes")
    return tables.pathways(t.spark, _with_header(t, rows, "pathways", "\t")).select(c("src").alias("gene"), c("dst").alias("pathway"), "w")


@query("""SELECT 'chr7' AS chrom, CAST(p_partkey AS INTEGER) AS "start", CAST(p_partkey + p_size AS INTEGER) AS "end", CAST(p_size AS DOUBLE) AS score, '1e-' || CAST(p_size AS VARCHAR) AS pvalue FROM part""")
def conserved_elements(t: Tables):
    """The chromosome comes from the file's name."""
    c = F.col
    path = fresh_path(t.spark, "gerp") + "/chr7_elems.txt"
    t.part.select(F.concat_ws(" ", c("p_partkey"), c("p_partkey") + c("p_size"), F.lit(3), c("p_size"), F.concat(F.lit("1e-"), c("p_size"))).alias("value")).write.text(path)
    return tables.gerp_elements(t.spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS ind_id, CAST(c_nationkey % 2 + 1 AS INTEGER) AS sex FROM customer WHERE c_custkey <> 7 AND c_custkey <> 11")
def pedigree_check(t: Tables):
    c = F.col
    line = _tabbed(F.lit("F"), c("c_custkey"), F.lit(0), F.lit(0), c("c_nationkey") % 2 + 1, F.lit(2))
    return tables.ped_missing(tables.ped(t.spark, _written(t, t.customer.select(line.alias("value")), "ped")), ["7", "11"]).select("ind_id", "sex")


@query("SELECT 'D' || CAST(c_custkey AS VARCHAR) AS disease_id, 'C' || CAST(c_nationkey AS VARCHAR) AS concept FROM customer")
def concept_mapping(t: Tables):
    c = F.col
    text = F.concat(F.lit("<http://x/D"), c("c_custkey"), F.lit("> a y ;\n   z w ;\n   skos:exactMatch <http://u/C"), c("c_nationkey"), F.lit("> ."))
    path = _written(t, t.customer.select(text.alias("value")), "ttl")
    return annotations.concept_mapping(splits.records(t.spark, path, r"^<[^>]*/\w+>"))


@query("SELECT p_partkey, 'NM_' || CAST(p_size AS VARCHAR) || '.1' AS transcript, 'c.5' || CASE WHEN p_size % 2 = 0 THEN '+1' ELSE '' END || 'A>G' AS cdna, p_size % 2 = 0 AS near_splice FROM part")
def clinical_summary_names(t: Tables):
    c = F.col
    names = F.concat(F.lit("NM_"), c("p_size"), F.lit(".1(G):c.5"), F.when(c("p_size") % 2 == 0, "+1").otherwise(""), F.lit("A>G (p.Lys2Arg)"))
    return annotations.clinvar_summary(t.part.select("p_partkey", names.alias("names")), "names").select("p_partkey", "transcript", "cdna", "near_splice")


@query("SELECT p_brand AS gene, 'c.' || CAST(p_size AS VARCHAR) || 'A>G' AS cdna, p_type AS classification FROM part WHERE p_size > 10 AND p_type <> 'LARGE'")
def submitted_variants(t: Tables):
    """Lines of 14 fields; rows without a cDNA change or with a class that says nothing drop out, as do short lines."""
    c = F.col
    kind = F.when(c("p_type") == "LARGE", "not provided").otherwise(c("p_type"))
    cdna = F.when(c("p_size") > 20, F.concat(F.lit("c."), c("p_size"), F.lit("A>G"))).when(c("p_size") > 10, F.concat(F.lit("c."), c("p_size"), F.lit("A>G"))).otherwise("")
    line = F.when(c("p_size") > 5, _tabbed(c("p_brand"), cdna, *[F.lit("x")] * 5, kind, *[F.lit("y")] * 6)).otherwise("short\tline")
    return tables.clinvitae(t.spark, _written(t, t.part.select(line.alias("value")), "clinvitae")).select("gene", "cdna", "classification")


@query("SELECT DISTINCT CAST(p_size AS VARCHAR) AS chrom, p_partkey AS pos, repeat('A', CAST(p_size * 3 AS INTEGER)) AS ref, 'G' AS alt FROM part WHERE p_size * 3 <= 100 AND p_size % 2 = 0")
def submitted_alleles(t: Tables):
    c = F.col
    d = t.part.select(c("p_size").cast("string").alias("chrom"), c("p_partkey").alias("pos"), F.repeat(F.lit("A"), c("p_size") * 3).alias("ref"), F.when(c("p_size") % 2 == 0, "G").otherwise("<DEL>").alias("alt"))
    return sinks.clinvitae_to_vcf(d)


@query(f"""WITH {_TX} SELECT DISTINCT chrom, CAST(s0 - 2 AS INTEGER) AS "start", CAST(e0 + 2 AS INTEGER) AS "end", gene AS name FROM cd WHERE acc LIKE 'NM%'""")
def coding_exons_bed(t: Tables):
    return sinks.coding_exons_bed(_transcripts(t), 2)


@query("""WITH x AS (SELECT p_partkey, p_size, p_size % 2 = 0 AS fwd, (['A', '-', 'G'])[p_size % 3 + 1] AS r, (['T', 'C', '-'])[p_size % 3 + 1] AS a FROM part), y AS (SELECT *, CASE WHEN fwd THEN r ELSE translate(r, 'ACGT', 'TGCA') END AS fr, CASE WHEN fwd THEN a ELSE translate(a, 'ACGT', 'TGCA') END AS fa FROM x)
    SELECT p_partkey, CASE WHEN a = '-' THEN p_partkey - 1 ELSE p_partkey END AS pos, CASE WHEN r = '-' THEN 'C' WHEN a = '-' THEN 'C' || fr ELSE fr END AS ref, CASE WHEN a = '-' THEN 'C' WHEN r = '-' THEN 'C' || fa ELSE fa END AS alt FROM y""")
def mutation_alleles(t: Tables):
    c = F.col
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (c("p_size") % 3 + 1).cast("int"))
    d = t.part.select(c("p_partkey").alias("chrom"), c("p_partkey").alias("pos"), pick("A", "-", "G").alias("ref"), pick("T", "C", "-").alias("alt"), F.when(c("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit("C").alias("base_before"))
    return sinks.table_to_vcf_rows(d).withColumnRenamed("chrom", "p_partkey")


@query("SELECT l_suppkey, l_partkey, array_to_string(list_sort(list(DISTINCT CAST(l_orderkey AS VARCHAR))), ',') AS ids FROM lineitem GROUP BY 1, 2")
def collapsed_sites(t: Tables):
    d = t.lineitem.select("l_suppkey", "l_partkey", F.col("l_orderkey").cast("string").alias("ids"))
    return sinks.collapse_sites(d, ["l_suppkey", "l_partkey"], "ids")


@query("SELECT s_name, s_nationkey, CAST(row_number() OVER (ORDER BY CAST(s_suppkey AS BIGINT), s_name) AS INTEGER) AS place FROM supplier")
def version_sorted(t: Tables):
    """Version order of names such as v10: numbers inside of text count as numbers; places go over partitions."""
    d = t.supplier.select("s_name", "s_nationkey", sinks.version_key(F.concat(F.lit("v"), F.col("s_suppkey"))).alias("v"))
    return scan.numbered(d, ["v", "s_name"], "place").select("s_name", "s_nationkey", F.col("place").cast("int").alias("place"))


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 1000 AS BIGINT) AS book FROM orders")
def report_books(t: Tables):
    return sinks.books(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 1000).select("o_orderkey", "book")


@query("SELECT n_name AS dbname, 'v2' AS version, CAST(n_nationkey * 2 AS BIGINT) AS entry_count FROM nation")
def release_versions(t: Tables):
    """Each source set twice: the later version counts."""
    path = fresh_path(t.spark, "releases")
    for version, times in (("v1", 1), ("v2", 2)):
        sinks.set_versions(t.nation.select(F.col("n_name").alias("dbname"), F.lit("2026_01").alias("file_date"), F.lit(version).alias("version"), (F.col("n_nationkey") * times).alias("entry_count")), path)
    return sinks.release_info(t.spark, path).select("dbname", "version", "entry_count")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def ranked_table(t: Tables):
    """A ranked TSV, written in order and read back."""
    path = fresh_path(t.spark, "ranked")
    sinks.ranked_tsv(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], path)
    return tables.tsv(t.spark, path, "o_orderkey long, o_totalprice double", header=True)


@query("SELECT p_partkey, p_brand FROM part")
def split_and_joined_files(t: Tables):
    path = fresh_path(t.spark, "parts")
    sinks.split_rows(t.part.select("p_partkey", "p_brand"), 3, ["p_partkey"]).write.partitionBy("part").parquet(path)
    return sinks.concat_files(t.spark, [f"{path}/part={i}" for i in range(3)])


@query("SELECT p_partkey, p_brand, p_size FROM part")
def loaded_table(t: Tables):
    """The generic loader: built once, sorted by its keys, and left alone while no input is newer."""
    path = fresh_path(t.spark, "loaded")
    make = lambda: t.part.select("p_partkey", "p_brand", "p_size")
    sinks.build(t.spark, make, [f"{t.sf_dir}/part.parquet"], path, ["p_brand", "p_partkey"])
    return sinks.build(t.spark, lambda: t.part.limit(0), [f"{t.sf_dir}/part.parquet"], path, ["p_brand", "p_partkey"])


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN p_size <= 25 THEN p_type END AS site FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def splice_sites_lookup(t: Tables):
    c = F.col
    table = t.part.where("p_size <= 25").select(F.lit("1").alias("chrom"), c("p_partkey").alias("pos"), F.lit("NM_1").alias("accession"), c("p_type").alias("site"))
    v = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.lit("1").alias("chrom"), c("l_partkey").alias("pos"), F.lit("NM_1").alias("accession"))
    return sites.lookup(v, table, ["chrom", "pos", "accession"], ["site"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "site")


@query("SELECT 'GWAS' AS refdb, o_custkey AS snp FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 'GAD', o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2")
def merged_catalogues(t: Tables):
    """Two catalogues in one table: rows of the second only where the first lacks the SNP, none twice."""
    rows = lambda s, db: t.orders.where(F.col("o_orderstatus") == s).select(F.lit(db).alias("refdb"), F.col("o_custkey").alias("snp"))
    gwas = rows("F", "GWAS").distinct()
    return aggregates.append(gwas, aggregates.insert_absent(rows("O", "GAD").distinct(), gwas, ["snp"]))


@query("SELECT s_name AS fam_id, s_name AS ind_id, CAST(CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS sex FROM supplier")
def proband_pedigree(t: Tables):
    """A pedigree of one member for each sample."""
    d = t.supplier.select(F.col("s_name").alias("sample"), (F.col("s_nationkey") % 2 == 0).alias("male"))
    return annotations.proband_peds(d).select("fam_id", "ind_id", "sex")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
def blocked_lines_scan(t: Tables):
    """Lines written as blocked gzip and read in many ranges of its blocks; the files' names don't say what they are."""
    c = F.col
    path = fresh_path(t.spark, "blocked")
    fields = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    splits.write_blocked(t.lineitem.select(_tabbed(*map(c, fields)).alias("value")), path, block_text=4096, suffix=".txt")
    f = F.split("value", "\t")
    kinds = [t.lineitem.schema[n].dataType for n in fields]
    return splits.lines(t.spark, path, 64 << 10).select(*[F.get(f, F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(zip(fields, kinds, strict=True))])


@query("SELECT p_brand || '_' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_size % 5 + 2 AS INTEGER) AS n_lines, f AS format FROM part, (SELECT unnest(['swissprot', 'obo', 'fastq', 'sdf']) AS f) WHERE f <> 'fastq' UNION ALL SELECT p_brand || '_' || CAST(p_partkey AS VARCHAR), 4, 'fastq' FROM part")
def record_format_scan(t: Tables):
    """Records of four kinds of formats (closed by an end line, by the next start, of four lines, with no start mark), in blocked files read in ranges."""
    c = F.col
    name, more = F.concat("p_brand", F.lit("_"), "p_partkey"), F.array_join(F.transform(F.sequence(F.lit(1), c("p_size") % 5), lambda i: F.concat(F.lit("X   "), i.cast("string"), F.lit("\n"))), "")
    more = F.when(c("p_size") % 5 == 0, "").otherwise(more)
    made = {
        "swissprot": F.concat(F.lit("ID   "), name, F.lit("\n"), more, F.lit("//")),
        "obo": F.concat(F.lit("[Term]\nid: "), F.rtrim(F.concat(name, F.lit("\n"), more), F.lit("\n"))),
        "fastq": F.concat(F.lit("@"), name, F.lit("\nACGT\n+\n@@@@")),
        "sdf": F.concat(name, F.lit("\n"), more, F.lit("$$$$")),
    }
    pick = {"swissprot": (0, "ID +(.*)"), "obo": (1, "id: (.*)"), "fastq": (0, "@(.*)"), "sdf": (0, "(.*)")}
    out = None
    for kind, text in made.items():
        path = fresh_path(t.spark, kind)
        splits.write_blocked(t.part.select(text.alias("value")), path, block_text=2048)
        line, pattern = pick[kind]
        d = tables.record_scan(t.spark, path, kind, 16 << 10)
        d = d.select(F.regexp_extract(F.get("lines", F.lit(line)), pattern, 1).alias("name"), F.size("lines").alias("n_lines"), F.lit(kind).alias("format"))
        out = d if out is None else out.unionByName(d)
    return out


@query(f"SELECT p_partkey, substr({_SEQ}, CAST(p_size + 1 AS BIGINT), 30) AS bases FROM part")
def fasta_index_reads(t: Tables):
    """Substrings by the byte offsets of an index, neighbouring ranges read at once."""
    c = F.col
    seq = F.expr(_SEQ)
    text = F.concat(F.lit(">p"), c("p_partkey"), F.lit(" part\n"), F.array_join(F.regexp_extract_all(F.lower(seq), F.lit(".{1,20}"), F.lit(0)), "\n"))
    indexed = materialize(fasta.index(t.spark, _written(t, t.part.select(text.alias("value")), "fasta"), 32 << 10), "fasta-index")
    wanted = t.part.select("p_partkey", F.concat(F.lit("p"), c("p_partkey")).alias("chrom"), c("p_size").alias("start"), F.lit(30).alias("n"))
    return fasta.substrings(wanted, indexed, "chrom", "start", "n", "p_partkey").select("p_partkey", "bases")


@query("SELECT CAST(p_partkey AS INTEGER) AS pos, p_name AS snpid, CAST(p_size AS VARCHAR) AS score FROM part")
def regulatory_table(t: Tables):
    c = F.col
    line = _tabbed(F.concat(F.lit("chr"), c("p_partkey") % 22 + 1), c("p_partkey"), c("p_name"), F.lit("x"), c("p_size"))
    return tables.tsv(t.spark, _written(t, t.part.select(line.alias("value")), "regulome"), tables.REGULOME).select("pos", "snpid", "score")


@query("SELECT 'MI' || CAST(p_partkey AS VARCHAR) AS mirbase_acc, p_brand AS gene, CAST(-p_size / 10.0 AS DOUBLE) AS energy, CAST(p_size AS DOUBLE) AS score FROM part")
def mirna_table(t: Tables):
    c = F.col
    line = _tabbed(F.concat(F.lit("MI"), c("p_partkey")), F.lit("mir"), F.lit("1"), c("p_brand"), F.lit("uc1"), F.lit("NM_1"), F.lit("acg"), F.lit("ugc"), F.lit("[1,2]"), -c("p_size") / 10, c("p_size"))
    return tables.tsv(t.spark, _written(t, t.part.select(line.alias("value")), "mirna"), tables.MIRNA).select("mirbase_acc", "gene", "energy", "score")


@query("""SELECT CAST(p_partkey AS INTEGER) AS "start", CAST(p_partkey + p_size AS INTEGER) AS "end", p_brand AS gene, p_type AS description FROM part""")
def protein_domain_table(t: Tables):
    c = F.col
    line = _tabbed(F.lit("1"), c("p_partkey"), c("p_partkey") + c("p_size"), c("p_brand"), F.lit("NM_1"), F.lit("P1"), F.lit("IPR1"), c("p_type"))
    return tables.tsv(t.spark, _written(t, t.part.select(line.alias("value")), "interpro"), tables.INTERPRO).select("start", "end", "gene", "description")


@query("SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS uniprot1, 'P' || CAST(l_partkey AS VARCHAR) AS uniprot2, (['BP', 'MF', 'CC'])[l_linenumber % 3 + 1] AS category, l_discount AS score FROM lineitem")
def similarity_table(t: Tables):
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, ("BP", "MF", "CC"))), (c("l_linenumber") % 3 + 1).cast("int"))
    line = _tabbed(F.concat(F.lit("P"), c("l_suppkey")), F.concat(F.lit("P"), c("l_partkey")), kind, c("l_discount"))
    return tables.tsv(t.spark, _written(t, t.lineitem.select(line.alias("value")), "funsim"), tables.FUNSIM)


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS genes, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS n FROM orders GROUP BY 1")
def pathway_answers(t: Tables):
    """Answers of a pathway service, as JSON."""
    named = F.transform(F.array_sort(F.collect_set("o_orderpriority")), lambda g: F.struct(g.alias("name")))
    d = t.orders.groupBy("o_custkey").agg(F.to_json(named).alias("answer")).withColumn("g", tables.pathway_json(F.col("answer")))
    return d.select("o_custkey", F.array_join("g", "|").alias("genes"), F.size("g").alias("n"))
