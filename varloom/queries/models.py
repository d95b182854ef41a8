"""Gene models, consequences, families, phenotypes and whole plans. Proxies: each part is a transcript of two exons in the gene of its brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import clinical, damage, sequence
from varloom.functions.clinical import FilterConfig
from varloom.operators import aggregates, annotations, consequence, family, genes, intervals, network, phenotype, sites
from varloom.plans import prioritize
from varloom.queries.base import Tables, query
from varloom.queries.scalars import _case
from varloom.sources import tables

_WORDS = ["GCA", "TGG", "CGT", "AAA", "TTC", "GAG", "TAC", "CCC"]


def _transcripts(t: Tables):
    """Exons [100k, 100k + l1) and, after a gap, one of l2 bases; the CDS lacks three bases on either side, one more where sizes end in 0."""
    c = F.col
    d = t.part.select(c("p_partkey").alias("k"), c("p_brand").alias("gene"), c("p_size").alias("s"), (6 + 3 * (c("p_size") % 4)).alias("l1"), (10 + c("p_size") % 7).alias("gap"), (9 + 3 * (c("p_size") % 5)).alias("l2"), (100 * c("p_partkey")).cast("int").alias("a"))
    coding = c("s") % 9 != 0
    frame = F.when(coding, 0).otherwise(-1)
    b = c("a") + c("l1") + c("gap")
    exon = lambda start, n, first: F.struct(start.alias("start"), (start + n).alias("end"), frame.alias("frame"), F.when(c("k") % 2 == 0, first).otherwise(3 - first).alias("number"))
    words = F.transform(F.sequence(F.lit(1), F.floor((c("l1") + c("l2") - 6) / 3).cast("int") - 2), lambda i: F.element_at(F.array(*map(F.lit, _WORDS)), ((c("k") + i) % 8 + 1).cast("int")))
    return d.select(
        c("k").cast("int").alias("gid"), F.concat(F.when(coding, "NM_").otherwise("NR_"), c("k")).alias("accession"), F.concat(F.when(coding, "NM_").otherwise("NR_"), c("k")).alias("name"), "gene", (c("k") % 22 + 1).cast("string").alias("chrom"), F.when(c("k") % 2 == 0, "+").otherwise("-").alias("strand"),
        c("a").alias("tx_start"), (b + c("l2")).alias("tx_end"), (c("a") + 3).alias("cds_start"), (b + c("l2") - 3 - F.when(c("s") % 10 == 0, 1).otherwise(0)).alias("cds_end"),
        F.array(exon(c("a"), c("l1"), 1), exon(b, c("l2"), 2)).alias("exons"), F.array(frame, frame).alias("frames"), F.concat(F.lit("ATG"), F.array_join(words, ""), F.lit("TAA")).alias("sequence"),
    )


_TX = f"""tx AS (SELECT p_partkey AS k, p_brand AS gene, p_size AS s, 6 + 3 * (p_size % 4) AS l1, 10 + p_size % 7 AS gap, 9 + 3 * (p_size % 5) AS l2, CAST(100 * p_partkey AS INTEGER) AS a, CASE WHEN p_size % 9 = 0 THEN 'NR_' ELSE 'NM_' END || CAST(p_partkey AS VARCHAR) AS acc,
      p_size % 9 <> 0 AS coding, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_partkey % 22 + 1 AS VARCHAR) AS chrom FROM part),
    m AS (SELECT *, a + l1 AS e1, a + l1 + gap AS b, a + l1 + gap + l2 AS e2, a + 3 AS cs, a + l1 + gap + l2 - 3 - CASE WHEN s % 10 = 0 THEN 1 ELSE 0 END AS ce,
      'ATG' || array_to_string([{_WORDS}[CAST((k + i) % 8 + 1 AS INTEGER)] FOR i IN range(1, (l1 + l2 - 6) // 3 - 1)], '') || 'TAA' AS seq FROM tx),
    ex AS (SELECT k, gene, chrom, strand, cs, ce, coding, acc, CAST(CASE WHEN strand = '+' THEN 1 ELSE 2 END AS INTEGER) AS number, a AS s0, e1 AS e0 FROM m UNION ALL SELECT k, gene, chrom, strand, cs, ce, coding, acc, CAST(CASE WHEN strand = '+' THEN 2 ELSE 1 END AS INTEGER), b, e2 FROM m),
    cd AS (SELECT k, gene, chrom, strand, acc, greatest(s0, cs) AS s0, least(e0, ce) AS e0 FROM ex WHERE greatest(s0, cs) < least(e0, ce))"""


@query(f'WITH {_TX} SELECT CAST(k AS INTEGER) AS gid, acc AS name, number, CAST(s0 AS INTEGER) AS "start", CAST(e0 AS INTEGER) AS "end", CAST(CASE WHEN coding THEN 0 ELSE -1 END AS INTEGER) AS frame FROM ex')
def exon_table(t: Tables):
    return genes.exon_table(_transcripts(t))


@query(f"WITH {_TX}, l AS (SELECT k, any_value(acc) AS name, sum(e0 - s0) AS n FROM cd GROUP BY 1) SELECT CAST(k AS INTEGER) AS gid, name, 'CDS_NOT_MULTIPLE_OF_3' AS remark FROM l WHERE n % 3 <> 0")
def transcript_defects(t: Tables):
    return genes.defects(_transcripts(t))


@query(f"WITH {_TX}, l AS (SELECT k, gene, sum(e0 - s0) AS n FROM cd GROUP BY 1, 2) SELECT gene, CAST(CASE WHEN max(n) > 0 THEN max(n) // 3 ELSE 480 END AS INTEGER) AS protein_len FROM l GROUP BY 1")
def protein_lengths(t: Tables):
    return genes.max_cds_length(_transcripts(t))


_UNION = "u AS (SELECT gene, CAST(sum(e0 - s0) AS BIGINT) AS length FROM (SELECT DISTINCT gene, chrom, s0, e0 FROM cd) GROUP BY 1)"


@query(f"WITH {_TX}, {_UNION} SELECT gene, length FROM u")
def union_exon_length(t: Tables):
    return genes.union_length(_transcripts(t))


@query(f'WITH {_TX} SELECT gene, chrom, CAST(s0 AS INTEGER) AS "start", CAST(e0 AS INTEGER) AS "end", CAST(row_number() OVER (PARTITION BY gene ORDER BY s0, e0) AS INTEGER) AS number FROM (SELECT DISTINCT gene, chrom, s0, e0 FROM ex)')
def gene_exon_numbers(t: Tables):
    return genes.gene_exons(_transcripts(t))


@query(f"""WITH {_TX}, p AS (SELECT acc, strand, unnest(range(CAST(s0 AS BIGINT), CAST(e0 AS BIGINT))) AS pos FROM cd), i AS (SELECT *, row_number() OVER (PARTITION BY acc ORDER BY CASE WHEN strand = '-' THEN -pos ELSE pos END) - 1 AS i FROM p)
    SELECT acc AS name, CAST(i // 3 + 1 AS BIGINT) AS codon, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY i) AS positions FROM i GROUP BY 1, 2""")
def codon_map(t: Tables):
    return genes.codon_map(_transcripts(t)).select("name", "codon", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("""WITH i AS (SELECT 'ENST' || CAST(p_partkey // 2 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) AS ens, 'ENST' || CAST(p_partkey // 2 AS VARCHAR) AS bare, p_size AS v, max('NM_' || CAST(p_partkey AS VARCHAR)) AS ref FROM part WHERE p_size > 10 GROUP BY ALL),
    x AS (SELECT p_partkey, 'ENST' || CAST(p_partkey // 2 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) AS name, 'ENST' || CAST(p_partkey // 2 AS VARCHAR) AS bare FROM part), b AS (SELECT bare, arg_max(ref, v) AS ref FROM i GROUP BY 1)
    SELECT p_partkey, coalesce(i.ref, b.ref) AS refseq FROM x LEFT JOIN i ON i.ens = x.name LEFT JOIN b ON b.bare = x.bare""")
def transcript_relabel(t: Tables):
    name = F.concat(F.lit("ENST"), F.floor(F.col("p_partkey") / 2), F.lit("."), F.col("p_size"))
    ids = t.part.where("p_size > 10").groupBy(name.alias("ensembl")).agg(F.max(F.concat(F.lit("NM_"), F.col("p_partkey"))).alias("refseq"))
    return genes.relabel(t.part.select("p_partkey", name.alias("name")), ids).select("p_partkey", "refseq")


@query("""WITH v AS (SELECT p_brand AS gene, count(DISTINCT (l_suppkey, l_partkey)) AS n_variants FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), l AS (SELECT p_brand AS gene, CAST(sum(p_size) AS BIGINT) AS length FROM part GROUP BY 1)
    SELECT gene, n_variants, length, round(n_variants / length, 8) AS score FROM v JOIN l USING (gene)""")
def gene_polymorphism(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_brand", "gene")
    lengths = t.part.groupBy(F.col("p_brand").alias("gene")).agg(F.sum("p_size").alias("length"))
    return genes.polymorphism(genes.variants_per_gene(d, "gene", ["l_suppkey", "l_partkey"]), lengths).withColumn("score", F.round("score", 8))


_KINDS = ["StopGain", "NonSyn", "FrameShiftDelete", "Syn", "NonSynStart", "StopLoss", "NoCDSChange"]
_COUNTS = ", ".join(f"CAST(count(*) FILTER ({k} AND v = {w}) AS BIGINT) AS {n}_{kn}" for kn, k in (("lof", "c IN ('StopGain', 'FrameShiftDelete', 'StopLoss')"), ("nsm", "c IN ('NonSyn', 'NonSynStart')")) for n, w in (("benign", -1), ("vus", 0), ("pathogenic", 1)))


@query(f"""WITH {_TX}, {_UNION}, x AS (SELECT p_brand AS gene, {_KINDS}[l_linenumber] AS c, l_suppkey % 3 - 1 AS v FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT gene, {_COUNTS} FROM x GROUP BY 1) SELECT g.*, u.length FROM g LEFT JOIN u USING (gene)""")
def pathogenic_profile(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("gene"), F.element_at(F.array(*map(F.lit, _KINDS)), F.col("l_linenumber")).alias("consequence"), (F.col("l_suppkey") % 3 - 1).alias("vote"))
    return genes.pathogenic_profile(d, _transcripts(t))


@query(f"""WITH {_TX}, w AS (SELECT acc, seq, unnest(range(0, len(seq) - 5)) AS i FROM m), h AS (SELECT acc, i, substr(seq, CAST(i + 1 AS BIGINT), 6) AS x FROM w) SELECT acc AS name, count(*) AS n FROM h WHERE x IN ('GCATGG', 'AAATTC', 'TACCCC') GROUP BY 1""")
def motif_counts(t: Tables):
    motifs = t.spark.createDataFrame([("GCATGG",), ("AAATTC",), ("TACCCC",)], "motif string")
    return genes.motif_counts(_transcripts(t).select("name", "sequence"), motifs, "n")


def _aa(codon: str) -> str:
    return _case(sequence.CODONS, codon)


def _variants(t: Tables):
    """Four variants for each transcript: two substitutions, a deletion and an insertion, of one base or three, at places in and around it."""
    c = F.col
    j = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")
    d = t.part.select(c("p_partkey").alias("k"), c("p_size").alias("s"), j)
    at = (100 * c("k") + 1 + (c("k") * 7 + c("j") * 11 + c("s")) % 50).cast("int")
    n = F.when(c("s") % 2 == 0, 1).otherwise(3)
    base = lambda q: F.element_at(F.array(*map(F.lit, "ACGT")), (q % 4 + 1).cast("int"))
    bases = F.when(n == 1, base(c("k") + c("j"))).otherwise(F.when(c("s") % 3 == 0, "TAA").otherwise("GCC"))
    sub, gone = c("j") < 2, c("j") == 2
    return d.select("k", "j", (c("k") % 22 + 1).cast("string").alias("chrom"), at.alias("start"), F.when(sub, at).when(gone, at + n - 1).otherwise(at + 1).alias("end"), F.when(sub, "A").when(gone, F.repeat(F.lit("A"), n)).otherwise("-").alias("ref"), F.when(sub, base(c("k") + c("j"))).when(gone, "-").otherwise(bases).alias("alt"))


_VARIANTS = """v0 AS (SELECT p_partkey AS k, p_size AS s, unnest([0, 1, 2, 3]) AS j FROM part), v1 AS (SELECT *, CAST(100 * k + 1 + (k * 7 + j * 11 + s) % 50 AS INTEGER) AS at_, CASE WHEN s % 2 = 0 THEN 1 ELSE 3 END AS n, ['A', 'C', 'G', 'T'][CAST((k + j) % 4 + 1 AS INTEGER)] AS base FROM v0),
    v AS (SELECT k AS vk, j, CAST(k % 22 + 1 AS VARCHAR) AS vchrom, at_ AS st, CASE WHEN j < 2 THEN at_ WHEN j = 2 THEN at_ + n - 1 ELSE at_ + 1 END AS en, CASE WHEN j < 2 THEN 1 WHEN j = 2 THEN n ELSE 0 END AS gone, CASE WHEN j < 2 THEN base WHEN j = 2 THEN '' WHEN n = 1 THEN base WHEN s % 3 = 0 THEN 'TAA' ELSE 'GCC' END AS al FROM v1)"""


def _region(x: str) -> str:
    edge = lambda plus, minus: f"CASE WHEN strand = '-' THEN '{minus}' ELSE '{plus}' END"
    exonic = f"CASE WHEN NOT coding THEN 'NonCodingExonic' WHEN {x} < cs THEN {edge('UTR5', 'UTR3')} WHEN {x} >= ce THEN {edge('UTR3', 'UTR5')} ELSE 'CodingExonic' END"
    return f"CASE WHEN {x} < a OR {x} >= e2 THEN 'Intergenic' WHEN {x} < e1 OR {x} >= b THEN {exonic} WHEN coding THEN 'CodingIntronic' ELSE 'NonCodingIntronic' END"


_HITS = f"""h0 AS (SELECT * FROM v JOIN m ON m.chrom = vchrom AND st > a AND st <= e2), h1 AS (SELECT *, {_region('(st - 1)')} AS r1, {_region('(en - 1)')} AS r2, CASE WHEN j = 3 THEN CASE WHEN strand = '-' THEN st - 1 ELSE en - 1 END WHEN strand = '-' THEN en - 1 ELSE st - 1 END AS base FROM h0),
    h2 AS (SELECT *, CASE WHEN r1 = r2 THEN r1 ELSE r1 || '_' || r2 || '_boundary' END AS region, greatest(0, least(base, least(e1, ce)) - greatest(a, cs)) + greatest(0, least(base, least(e2, ce)) - greatest(b, cs)) AS before,
      greatest(0, least(e1, ce) - greatest(a, cs)) + greatest(0, least(e2, ce) - greatest(b, cs)) AS total, CASE WHEN strand = '-' THEN reverse(translate(al, 'ACGT', 'TGCA')) ELSE al END AS alt FROM h1),
    h3 AS (SELECT *, CASE WHEN strand = '-' THEN total - 1 - before ELSE before END AS ix, len(seq) AS n3 FROM h2),
    h4 AS (SELECT *, substr(seq, CAST(3 * (ix // 3) + 1 AS BIGINT), 3) AS wc, substr(substr(seq, 1, CAST(ix AS BIGINT)) || alt || substr(seq, CAST(ix + gone + 1 AS BIGINT)), CAST(3 * (ix // 3) + 1 AS BIGINT), 3) AS mc, substr(seq, 1, CAST(ix AS BIGINT)) || alt || substr(seq, CAST(ix + 1 AS BIGINT)) AS grown FROM h3),
    h5 AS (SELECT *, {_aa('wc')} AS w, {_aa('mc')} AS mu, array_to_string([{_aa('substr(grown, CAST(3 * i + 1 AS BIGINT), 3)')} FOR i IN range(0, len(grown) // 3)], '') AS pep FROM h4),
    h6 AS (SELECT *, CASE WHEN region = 'CodingExonic' THEN CASE WHEN j < 2 THEN CASE WHEN w = '*' AND mu = '*' THEN 'SynStop' WHEN w = '*' THEN 'StopLoss' WHEN mu = '*' THEN 'StopGain' WHEN ix < 3 AND wc <> 'ATG' AND mc = 'ATG' THEN 'NonSynStart' WHEN ix < 3 AND mc <> 'ATG' THEN 'StartLoss' WHEN w = mu THEN 'Syn' ELSE 'NonSyn' END
        WHEN j = 2 THEN CASE WHEN ix < 3 THEN 'StartLoss' WHEN ix + gone > n3 - 3 THEN 'StopLoss' WHEN gone % 3 <> 0 THEN 'FrameShiftDelete' ELSE 'NonFrameShiftDelete' END
        ELSE CASE WHEN ix >= n3 - 3 THEN CASE WHEN ix >= n3 THEN 'NoCDSChange' WHEN right(pep, 1) = '*' THEN 'SynStop' ELSE 'StopLoss' END WHEN len(alt) % 3 <> 0 THEN 'FrameShiftInsert' WHEN contains(left(pep, len(pep) - 1), '*') THEN 'StopGain' ELSE 'NonFrameShiftInsert' END END
      WHEN contains(region, 'boundary') THEN CASE WHEN contains(region, 'CodingExonic') AND contains(region, 'UTR3') AND j < 3 THEN 'StopLoss' WHEN contains(region, 'CodingExonic') AND contains(region, 'UTR5') AND j < 3 THEN 'StartLoss' END END AS consequence,
      CAST(CASE WHEN st - 1 < e1 AND st - 1 >= a THEN CASE WHEN strand = '-' THEN 2 ELSE 1 END WHEN st - 1 >= b AND st - 1 < e2 THEN CASE WHEN strand = '-' THEN 1 ELSE 2 END ELSE 0 END AS INTEGER) AS exon,
      CASE WHEN st - 1 >= e1 AND st - 1 < b THEN CASE WHEN st - e1 <= 2 THEN CASE WHEN strand = '-' THEN 'SpliceAcceptor' ELSE 'SpliceDonor' END WHEN b - st + 1 <= 2 THEN CASE WHEN strand = '-' THEN 'SpliceDonor' ELSE 'SpliceAcceptor' END
        ELSE 'Exon1_SpliceDonor_' || CAST(CASE WHEN strand = '-' THEN b - st + 1 ELSE st - e1 END AS VARCHAR) || '__Exon2_SpliceAcceptor_' || CAST(CASE WHEN strand = '-' THEN st - e1 ELSE b - st + 1 END AS VARCHAR) END END AS splice FROM h5)"""


def _annotated(t: Tables):
    v = _variants(t).withColumnsRenamed({"chrom": "vchrom"})
    tx = _transcripts(t).withColumn("_first", F.col("tx_start") + 1)
    return consequence.annotate(intervals.point_join(v, tx, "vchrom", "start", "chrom", "_first", "tx_end"))


@query(f"WITH {_TX}, {_VARIANTS}, {_HITS} SELECT vk AS k, CAST(j AS INTEGER) AS j, acc AS accession, region, exon, splice, consequence FROM h6")
def coding_consequences(t: Tables):
    return _annotated(t).select("k", "j", "accession", "region", "exon", "splice", "consequence")


_SEVERITY = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in clinical.SEVERITY.items()) + " ELSE 6 END"
_PLACE = lambda order: "CASE WHEN region LIKE '%boundary%' THEN " + str(order.index("boundary")) + " " + " ".join(f"WHEN region = '{r}' THEN {i}" for i, r in enumerate(order) if r != "boundary") + f" ELSE {len(order)} END"
_WORST = f"""x AS (SELECT l_orderkey, l_suppkey, p_brand AS gene, l_partkey, (['CodingExonic', 'UTR5', 'UTR3', 'CodingIntronic', 'UTR5_CodingExonic_boundary', 'NonCodingExonic', 'NonCodingIntronic'])[l_linenumber] AS region, ({_KINDS})[CAST(l_suppkey % 7 + 1 AS INTEGER)] AS cons FROM lineitem JOIN part ON p_partkey = l_partkey),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, gene ORDER BY {_PLACE(clinical.TRANSCRIPT_ORDER)}, {_SEVERITY.format(c='cons')}, l_partkey, l_suppkey, cons, region) AS n FROM x) WHERE n = 1)"""


def _worst(t: Tables):
    region = F.element_at(F.array(*map(F.lit, ["CodingExonic", "UTR5", "UTR3", "CodingIntronic", "UTR5_CodingExonic_boundary", "NonCodingExonic", "NonCodingIntronic"])), F.col("l_linenumber"))
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.select("l_orderkey", "l_suppkey", F.col("p_brand").alias("gene"), "l_partkey", region.alias("region"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_suppkey") % 7 + 1).cast("int")).alias("consequence"))


@query(f"WITH {_WORST} SELECT l_orderkey, gene, l_partkey, l_suppkey, region, cons AS consequence FROM g")
def worst_transcript(t: Tables):
    return consequence.worst_transcript(_worst(t), ["l_orderkey"], "gene", ["l_partkey", "l_suppkey", "consequence", "region"]).select("l_orderkey", "gene", "l_partkey", "l_suppkey", "region", "consequence")


@query(f"WITH {_WORST} SELECT l_orderkey, gene, region, cons AS consequence FROM (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PLACE(clinical.GENE_ORDER)}, {_SEVERITY.format(c='cons')}, gene) AS n FROM g) WHERE n = 1")
def worst_gene(t: Tables):
    one = consequence.worst_transcript(_worst(t), ["l_orderkey"], "gene", ["l_partkey", "l_suppkey", "consequence", "region"])
    return consequence.worst_gene(one, ["l_orderkey"], ["gene"]).select("l_orderkey", "gene", "region", "consequence")


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_suppkey % 3 = 0 THEN 'NR_' ELSE 'NM_' END || CAST(l_partkey AS VARCHAR) AS accession, min(l_partkey + l_suppkey * 7) AS d FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, coalesce(min(accession) FILTER (accession LIKE 'NM%'), min(accession)) AS accession FROM x GROUP BY 1""")
def intron_choice(t: Tables):
    """Distances that never fall along the fold: the first coding transcript stays, without one the first."""
    acc = F.concat(F.when(F.col("l_suppkey") % 3 == 0, "NR_").otherwise("NM_"), F.col("l_partkey"))
    d = t.lineitem.select("l_orderkey", acc.alias("accession")).distinct()
    d = d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("accession")).alias("a"))
    tx = F.transform("a", lambda a, i: F.struct(a.alias("accession"), (i + 1).alias("donor"), (i + 2).alias("acceptor")))
    return d.select("l_orderkey", consequence.intron_choice(tx)["accession"].alias("accession"))


@query("SELECT k, s, CASE WHEN st BETWEEN a + 1 AND e1 THEN CASE WHEN strand = '-' THEN l2 + e1 - st ELSE st - 1 - a END WHEN st BETWEEN b + 1 AND e2 THEN CASE WHEN strand = '-' THEN e2 - st ELSE l1 + st - 1 - b END END AS ix, array_to_string(list_sort(list_distinct(list_filter([substr(seq, CAST(s % 10 + 1 AS BIGINT), 3), CASE WHEN s % 10 >= 1 THEN substr(seq, CAST(s % 10 AS BIGINT), 3) END, CASE WHEN s % 10 >= 2 THEN substr(seq, CAST(s % 10 - 1 AS BIGINT), 3) END], lambda c: len(c) = 3))), ',') AS codons FROM (SELECT *, a + 1 + k % 40 AS st FROM m)".replace("SELECT k, s,", f"WITH {_TX} SELECT k, CAST(s AS INTEGER) AS s,", 1))
def upstream_codons(t: Tables):
    d = _transcripts(t).join(t.part.select(F.col("p_partkey").cast("int").alias("gid"), F.col("p_size").alias("s")), "gid")
    base = (F.col("tx_start") + F.col("gid") % 40).cast("int")
    return d.select(F.col("gid").cast("bigint").alias("k"), "s", sequence.utr5_index(base, F.col("exons"), F.col("strand")).alias("ix"), F.array_join(F.array_sort(sequence.codons_around(F.col("sequence"), F.col("s") % 10)), ",").alias("codons"))


@query(f"""WITH {_TX}, q AS (SELECT DISTINCT l_partkey * 100 + l_suppkey AS pos, CAST(l_partkey % 22 + 1 AS VARCHAR) AS c FROM lineitem) SELECT pos, c AS chrom, CAST(k AS INTEGER) AS gid, acc AS accession, gene, strand FROM q JOIN m ON m.chrom = c AND pos > a AND pos <= e2""")
def genes_by_location(t: Tables):
    d = t.lineitem.select((F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("pos"), (F.col("l_partkey") % 22 + 1).cast("string").alias("chrom")).distinct()
    return genes.genes_at(d, _transcripts(t), "chrom", "pos").select("pos", "chrom", "gid", "accession", "gene", "strand")


@query(f"WITH {_TX} SELECT CAST(k AS INTEGER) AS gid, acc AS accession, CASE WHEN s > 20 THEN seq END AS sequence FROM m WHERE gene = 'Brand#7' AND strand = '-'")
def gene_and_mrna_lookup(t: Tables):
    tx = _transcripts(t)
    big = t.part.where("p_size > 20").select(F.col("p_partkey").cast("int").alias("gid"))
    mrnas = tx.join(big, "gid", "left_semi").select("gid", "name", "sequence")
    return genes.mrna_lookup(genes.gene_lookup(tx, gene="Brand#7", strand="-").select("gid", "accession"), mrnas)


@query("""WITH s AS (SELECT 'rs' || CAST(l_partkey AS VARCHAR) AS rsid, min((l_suppkey, l_linenumber, l_returnflag)) AS m FROM lineitem GROUP BY 1) SELECT p_partkey, 'rs' || CAST(p_partkey AS VARCHAR) AS rsid, struct_extract(m, 1) AS chrom, struct_extract(m, 2) AS pos, struct_extract(m, 3) AS significance FROM part LEFT JOIN s ON rsid = 'rs' || CAST(p_partkey AS VARCHAR)""")
def sites_by_rsid(t: Tables):
    s = t.lineitem.select(F.concat(F.lit("rs"), F.col("l_partkey")).alias("rsid"), F.col("l_suppkey").alias("chrom"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("significance"))
    return sites.by_rsid(t.part.select("p_partkey", F.concat(F.lit("rs"), F.col("p_partkey")).alias("rsid")), s)


@query("""WITH v AS (SELECT l_suppkey AS chrom, l_partkey AS pos, l_returnflag AS ref, l_linestatus AS alt, l_linenumber % 3 - 1 AS v FROM lineitem)
    SELECT chrom, pos, ref, alt, CASE max(v) WHEN 1 THEN 'pathogenic' WHEN -1 THEN 'benign' ELSE 'vus' END AS label FROM v GROUP BY chrom, pos, ref, alt HAVING min(v) = max(v)""")
def training_labels(t: Tables):
    d = t.lineitem.select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), "l_linenumber")
    return sites.labelled(d, F.col("l_linenumber") % 3 - 1)


@query("""WITH r AS (SELECT DISTINCT s_suppkey * 20 AS s, s_suppkey * 20 + s_nationkey AS e FROM supplier) SELECT p_partkey, EXISTS (SELECT 1 FROM r WHERE p_partkey BETWEEN s AND e) AS has_region FROM part""")
def region_membership(t: Tables):
    c = F.col
    r = t.supplier.select(F.lit("1").alias("rchrom"), (c("s_suppkey") * 20).alias("rstart"), (c("s_suppkey") * 20 + c("s_nationkey")).alias("rend"))
    return intervals.has_region(t.part.select("p_partkey", F.lit("1").alias("chrom")), r, "chrom", "p_partkey").select("p_partkey", "has_region")


@query("""WITH d AS (SELECT s_suppkey * 20 AS s, s_suppkey * 20 + s_nationkey AS e, s_name AS t FROM supplier) SELECT p_partkey, array_to_string(list_sort(list(DISTINCT t)), '|') AS descriptions FROM part JOIN d ON p_partkey <= e AND s <= p_partkey + p_size GROUP BY 1""")
def domain_descriptions(t: Tables):
    c = F.col
    dom = t.supplier.select(F.lit("1").alias("dchrom"), (c("s_suppkey") * 20).alias("dstart"), (c("s_suppkey") * 20 + c("s_nationkey")).alias("dend"), c("s_name").alias("description"))
    v = t.part.select("p_partkey", F.lit("1").alias("chrom"), c("p_partkey").alias("start"), (c("p_partkey") + c("p_size")).alias("end"))
    return intervals.domain_texts(v, dom, "p_partkey", "chrom", "start", "end").select("p_partkey", F.array_join("descriptions", "|").alias("descriptions"))


@query("""WITH b AS (SELECT s_suppkey * 20 AS s, s_suppkey * 20 + 14 AS e, s_suppkey * 1000 AS q, s_suppkey % 2 = 0 AS fwd, CAST(s_nationkey AS VARCHAR) AS c FROM supplier)
    SELECT p_partkey, c AS to_chrom, q + CASE WHEN fwd THEN p_partkey - s ELSE e - p_partkey END AS to_pos FROM part LEFT JOIN b ON p_partkey BETWEEN s AND e""")
def liftover(t: Tables):
    c = F.col
    chain = t.supplier.select(F.lit("1").alias("from_chrom"), (c("s_suppkey") * 20).alias("from_start"), (c("s_suppkey") * 20 + 14).alias("from_end"), c("s_nationkey").cast("string").alias("to_chrom"), (c("s_suppkey") * 1000).alias("to_start"), F.when(c("s_suppkey") % 2 == 0, "+").otherwise("-").alias("to_strand"))
    return intervals.liftover(t.part.select("p_partkey", F.lit("1").alias("chrom")), chain, "chrom", "p_partkey").select("p_partkey", "to_chrom", "to_pos")


_TRIO = """t AS (SELECT p_brand AS gene, l_suppkey AS transcript, l_partkey AS pos, l_orderkey, l_linenumber, (['FrameShiftInsert', 'NonSyn', 'FrameShiftDelete', 'StopGain', 'Syn', 'NonSyn', 'Syn'])[l_linenumber] AS consequence, CAST(([1, 0, -2, 0, 3, 0, -1])[l_linenumber] AS BIGINT) AS size,
      CAST(l_orderkey % 2 AS VARCHAR) AS f1, CAST(l_partkey % 2 AS VARCHAR) AS f2, CAST(l_suppkey % 2 AS VARCHAR) AS m1, CAST((l_orderkey + l_partkey) % 2 AS VARCHAR) AS m2, CAST(l_linenumber % 2 AS VARCHAR) AS c1, CAST((l_suppkey + l_linenumber) % 2 AS VARCHAR) AS c2 FROM lineitem JOIN part ON p_partkey = l_partkey),
    p AS (SELECT *, c1 IN (f1, f2) AND c2 IN (m1, m2) AS s, c2 IN (f1, f2) AND c1 IN (m1, m2) AS k FROM t), q AS (SELECT *, CASE WHEN k AND NOT s THEN c2 ELSE c1 END AS a1, CASE WHEN k AND NOT s THEN c1 ELSE c2 END AS a2, (s AND (c1 = c2 OR NOT k)) OR (k AND NOT s) OR c1 = c2 AS sure FROM p),
    h AS (SELECT *, unnest([1, 2]) AS haplotype, unnest([a1, a2]) AS al FROM q WHERE sure), g AS (SELECT *, count(*) OVER w AS n, max(CASE WHEN consequence IN ('FrameShiftInsert', 'FrameShiftDelete', 'StopGain') THEN 1 ELSE 0 END) OVER w AS z FROM h WHERE al <> '0' WINDOW w AS (PARTITION BY gene, transcript, haplotype))"""


@query(f"""WITH {_TRIO}, o AS (SELECT *, sum(size) OVER (PARTITION BY gene, transcript, haplotype ORDER BY pos, consequence, l_orderkey, l_linenumber) AS total FROM g WHERE n > 1 AND z = 1),
    b AS (SELECT *, coalesce(last_value(CASE WHEN total % 3 = 0 THEN total END IGNORE NULLS) OVER (PARTITION BY gene, transcript, haplotype ORDER BY pos, consequence, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM o)
    SELECT gene, transcript, CAST(haplotype AS INTEGER) AS haplotype, pos, consequence, count(*) AS n, CAST(sum(total - base) AS BIGINT) AS running FROM b GROUP BY ALL""")
def downstream_variants(t: Tables):
    c = F.col
    d = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), c("l_linenumber"))
    gt = lambda a, b: F.concat((a % 2).cast("string"), F.lit("/"), (b % 2).cast("string"))
    trio = d.select(c("p_brand").alias("gene"), c("l_suppkey").alias("transcript"), F.lit("CodingExonic").alias("region"), pick(["FrameShiftInsert", "NonSyn", "FrameShiftDelete", "StopGain", "Syn", "NonSyn", "Syn"]).alias("consequence"), c("l_partkey").alias("pos"), pick([1, 0, -2, 0, 3, 0, -1]).cast("bigint").alias("size"), F.lit("PASS").alias("filter"),
                    gt(c("l_orderkey"), c("l_partkey")).alias("father"), gt(c("l_suppkey"), c("l_orderkey") + c("l_partkey")).alias("mother"), gt(c("l_linenumber"), c("l_suppkey") + c("l_linenumber")).alias("child"), "l_orderkey", "l_linenumber")
    out = family.downstream(trio, tie=["l_orderkey", "l_linenumber"])
    return out.groupBy("gene", "transcript", "haplotype", "pos", "consequence").agg(F.count(F.lit(1)).alias("n"), F.sum("running").alias("running"))


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linenumber <> 5) AS n_top, count(*) FILTER (l_returnflag = 'A' AND l_linenumber <> 5) AS n_under,
    coalesce(count(*) FILTER (l_returnflag = 'R' AND l_linenumber <> 5) / nullif(count(*) FILTER (l_returnflag = 'A' AND l_linenumber <> 5), 0) > 1.0, false) AS male FROM lineitem GROUP BY 1""")
def sex_from_genotypes(t: Tables):
    chrom = F.when(F.col("l_returnflag") == "R", "chrY").when(F.col("l_returnflag") == "A", "X").otherwise("1")
    d = t.lineitem.select("l_suppkey", chrom.alias("chrom"), F.when(F.col("l_linenumber") == 5, "./.").otherwise("0/1").alias("gt"))
    return family.sex(d, "l_suppkey", "chrom", "gt", 1.0)


def _ontology(least: int) -> str:
    """Terms with their ancestors, diseases of line items over a quantity, and one patient's similarity to them."""
    return f"""e AS (SELECT s_suppkey AS term, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey > 0), c AS (SELECT s_suppkey AS term, s_suppkey AS ancestor FROM supplier UNION SELECT c.term, e.parent FROM c JOIN e ON e.term = c.ancestor),
    a AS (SELECT DISTINCT o_custkey AS disease, l_suppkey AS term FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > {least}), ic AS (SELECT c.ancestor AS term, -ln(count(DISTINCT a.disease) / (SELECT count(DISTINCT disease) FROM a)) AS ic FROM a JOIN c ON c.term = a.term GROUP BY 1),
    p AS (SELECT s_suppkey AS x FROM supplier WHERE s_acctbal > 8000), b AS (SELECT DISTINCT term AS y FROM a),
    s AS (SELECT x, y, max(ic.ic) AS common FROM p CROSS JOIN b JOIN c c1 ON c1.term = x JOIN c c2 ON c2.term = y AND c2.ancestor = c1.ancestor JOIN ic ON ic.term = c1.ancestor GROUP BY 1, 2),
    l AS (SELECT x, y, coalesce(2 * common / nullif(i.ic + k.ic, 0), 0) AS lin FROM s JOIN ic i ON i.term = x JOIN ic k ON k.term = y),
    d AS (SELECT disease, x, y, lin FROM a JOIN l ON y = term), f AS (SELECT disease, sum(m) / (SELECT count(*) FROM p) AS f FROM (SELECT disease, x, max(lin) AS m FROM d GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT disease, sum(m) / any_value(n) AS g FROM (SELECT disease, y, max(lin) AS m FROM d GROUP BY 1, 2) JOIN (SELECT disease, count(*) AS n FROM a GROUP BY 1) USING (disease) GROUP BY 1), r AS (SELECT disease, greatest(f, g) AS raw FROM f JOIN g USING (disease))"""


_ONTOLOGY = _ontology(45)


@query(f"WITH RECURSIVE {_ONTOLOGY} SELECT disease AS disease_id, round(raw / (SELECT max(raw) FROM r), 6) AS score FROM r")
def disease_similarity(t: Tables):
    c = F.col
    is_a = t.supplier.where("s_suppkey > 0").select(c("s_suppkey").alias("term"), F.floor(c("s_suppkey") / 3).alias("parent"))
    dis = t.orders.join(t.lineitem.where("l_quantity > 45"), c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("disease_id"), c("l_suppkey").alias("term")).distinct()
    patient = t.supplier.where("s_acctbal > 8000").select(c("s_suppkey").alias("term"))
    return phenotype.disease_similarity(patient, dis, is_a).select("disease_id", F.round("score", 6).alias("score"))


_BOTH = """g AS (SELECT p_brand AS gene, sum(p_retailprice) AS score FROM part GROUP BY 1), p AS (SELECT p_brand AS gene, sum(p_size) AS score FROM part WHERE p_type = 'PROMO' AND p_size > 40 GROUP BY 1),
    j AS (SELECT g.gene, g.score AS g, coalesce(p.score, (SELECT min(score) FROM p) * 1.25, 0) AS p FROM g LEFT JOIN p USING (gene)), n AS (SELECT gene, g / (SELECT sum(g) FROM j) AS g, p / (SELECT sum(p) FROM j) AS p FROM j),
    c AS (SELECT *, CASE WHEN g = 0 OR p = 0 THEN 0 ELSE 0.25 * g * p / (0.25 * g * p + (1 - 0.5 * p) * (1 - 0.5 * g)) END AS seed FROM n)"""


def _evidence(t: Tables):
    g = t.part.groupBy(F.col("p_brand").alias("gene")).agg(F.sum("p_retailprice").alias("score"))
    return g, t.part.where("p_type = 'PROMO' AND p_size > 40").groupBy(F.col("p_brand").alias("gene")).agg(F.sum("p_size").cast("double").alias("score"))


@query(f"WITH {_BOTH} SELECT gene, round(g, 8) AS gt_dmg_score, round(p, 8) AS pheno_score, round(seed, 10) AS seed_score FROM c")
def combined_evidence(t: Tables):
    out = phenotype.combine(*_evidence(t))
    return out.select("gene", F.round("gt_dmg_score", 8).alias("gt_dmg_score"), F.round("pheno_score", 8).alias("pheno_score"), F.round("seed_score", 10).alias("seed_score"))


@query("SELECT o_custkey AS disease_id, max(o_totalprice) AS score FROM orders GROUP BY 1 ORDER BY score DESC, disease_id LIMIT 12")
def top_diseases(t: Tables):
    return phenotype.top_diseases(t.orders.select(F.col("o_custkey").alias("disease_id"), F.col("o_totalprice").alias("score")), 12)


@query("WITH g AS (SELECT p_brand AS gene, sum(p_retailprice) AS score FROM part GROUP BY 1) SELECT gene, score FROM g ORDER BY score DESC, gene LIMIT 1")
def best_phenotype_gene(t: Tables):
    return phenotype.best_gene(_evidence(t)[0])


@query("""WITH g AS (SELECT p_brand AS gene, max(p_retailprice) AS s FROM part WHERE p_size > 45 GROUP BY 1) SELECT p_partkey, p_brand AS gene, coalesce(s, 0) + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS gene_score FROM part LEFT JOIN g ON g.gene = p_brand""")
def report_scores(t: Tables):
    g = t.part.where("p_size > 45").groupBy(F.col("p_brand").alias("gene")).agg(F.max("p_retailprice").alias("score"))
    v = t.part.select("p_partkey", F.col("p_brand").alias("gene"), F.when(F.col("p_size") % 3 == 0, "c3e").otherwise("3e").alias("class_tag"))
    return phenotype.report_scores(v, g).select("p_partkey", "gene", "gene_score")


@query("""WITH s AS (SELECT p_brand AS gene, sum(p_size) AS v FROM part GROUP BY 1), n AS (SELECT DISTINCT s_suppkey AS node, 'Brand#' || CAST(s_nationkey AS VARCHAR) AS gene FROM supplier WHERE s_acctbal > 4000), o AS (SELECT CAST(node AS VARCHAR) AS label, CAST(v AS DOUBLE) AS v, true AS on_ FROM n JOIN s USING (gene)),
    x AS (SELECT * FROM o UNION ALL SELECT gene, v, false FROM s WHERE gene NOT IN (SELECT gene FROM n)) SELECT label, on_, round(v / (SELECT sum(v) FROM x), 8) AS value FROM x""")
def node_prior(t: Tables):
    scores = t.part.groupBy(F.col("p_brand").alias("node")).agg(F.sum("p_size").cast("double").alias("value"))
    nodes = t.supplier.where("s_acctbal > 4000").select(F.col("s_suppkey").cast("string").alias("node"), F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("gene")).distinct()
    on, off = network.prior(nodes, scores)
    both = on.withColumn("on_", F.lit(True)).unionByName(off.withColumn("on_", F.lit(False)))
    return both.select(F.col("node").alias("label"), "on_", F.round("value", 8).alias("value"))


@query("""WITH v AS (SELECT s_suppkey AS node, s_acctbal AS value, 'G' || CAST(s_nationkey AS VARCHAR) AS gene FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY value DESC, node) AS n FROM v) SELECT CASE WHEN n = 1 THEN gene ELSE gene || '|' || CAST(node AS VARCHAR) END AS label, value FROM r""")
def node_labels(t: Tables):
    nodes = t.supplier.select(F.col("s_suppkey").alias("node"), F.concat(F.lit("G"), F.col("s_nationkey")).alias("gene"))
    return network.label_nodes(t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("value")), nodes)


@query("""WITH a AS (SELECT s_suppkey AS node, s_acctbal AS v FROM supplier), b AS (SELECT s_suppkey AS node, s_acctbal * 0.5 + 1 AS v FROM supplier WHERE s_nationkey > 5), d AS (SELECT abs(coalesce(a.v, 0) - coalesce(b.v, 0)) AS d FROM a FULL JOIN b USING (node)) SELECT round(sum(d), 6) AS l1, round(max(d), 6) AS largest FROM d""")
def vector_distances(t: Tables):
    a = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("value"))
    b = t.supplier.where("s_nationkey > 5").select(F.col("s_suppkey").alias("node"), (F.col("s_acctbal") * 0.5 + 1).alias("value"))
    return t.spark.createDataFrame([(round(network.distance_l1(a, b), 6), round(network.distance_max(a, b), 6))], "l1 double, largest double")


@query("SELECT c_custkey AS disease_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def diseases_without_genes(t: Tables):
    return tables.without_genes(t.customer.select(F.col("c_custkey").alias("disease_id")), t.orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("disease_id")))


@query("""WITH k AS (SELECT DISTINCT l_partkey, l_suppkey % 24 AS c, CAST(l_linenumber AS VARCHAR) AS tx FROM lineitem), s AS (SELECT p_partkey % 24 AS c, p_partkey AS a, p_partkey + p_size AS b, CAST(p_size % 7 + 1 AS VARCHAR) AS tx, p_type AS site FROM part)
    SELECT l_partkey, k.tx AS transcript, a AS "start", site FROM k JOIN s ON s.c = k.c AND s.tx = k.tx AND l_partkey BETWEEN a AND b""")
def transcript_signals(t: Tables):
    c = F.col
    v = t.lineitem.select("l_partkey", (c("l_suppkey") % 24).alias("chrom"), c("l_linenumber").cast("string").alias("transcript")).distinct()
    s = t.part.select((c("p_partkey") % 24).alias("schrom"), c("p_partkey").alias("start"), (c("p_partkey") + c("p_size")).alias("end"), (c("p_size") % 7 + 1).cast("string").alias("accession"), c("p_type").alias("site"))
    return annotations.transcript_signals(v, s, "chrom", "l_partkey", "transcript").select("l_partkey", "transcript", "start", "site")


@query("""WITH m AS (SELECT p_partkey AS mirna, p_size % 7 + 1 AS tx, unnest(['A', 'c', 'G', '-', 'U']) AS base, unnest([p_partkey, p_partkey + 1, p_partkey + 2, NULL, p_partkey + 9]) AS at_ FROM part), v AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem)
    SELECT DISTINCT l_partkey, l_linenumber, mirna FROM v JOIN m ON tx = l_linenumber AND at_ = l_partkey WHERE base IN ('A', 'G', 'U')""")
def mirna_binding(t: Tables):
    c = F.col
    k = c("p_partkey").cast("int")
    m = t.part.select(c("p_partkey").alias("mirna"), (c("p_size") % 7 + 1).alias("refseq_acc"), F.lit("AcG-U").alias("align"), F.array(k, k + 1, k + 2, F.lit(None).cast("int"), k + 9).alias("coords"))
    return annotations.binding_sites(t.lineitem.select("l_partkey", "l_linenumber").distinct(), m, "l_linenumber", "l_partkey").select("l_partkey", "l_linenumber", "mirna")


_RARE = "CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'novel' WHEN {d} OR {t} THEN 'frequent' ELSE 'rare' END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS gene, (['CodingExonic', 'NonCodingExonic', 'CodingIntronic', 'UTR5', 'UTR3', 'NonCodingIntronic', 'Intergenic'])[l_linenumber] AS region, CASE l_partkey % 5 WHEN 0 THEN 'ESE' WHEN 1 THEN 'ESS' END AS motif, (['StopGain', 'NonSyn', 'NonFrameShiftDelete', 'Syn', 'NoCDSChange'])[CAST(l_suppkey % 5 + 1 AS INTEGER)] AS cons,
      l_quantity AS off, l_suppkey % 6 AS sig, (['DM', 'FP', 'DP', 'R', 'DM?', 'none'])[CAST(l_orderkey % 6 + 1 AS INTEGER)] AS hg, p_size < 5 AS lcr, l_linestatus = 'O' AND l_linenumber = 2 AS bad, {_RARE.format(d='nullif(l_discount, 0) > 0.06', t='nullif(l_tax, 0) > 0.06')} AS fc, {_RARE.format(d='nullif(l_discount, 0) > 0.04', t='nullif(l_tax, 0) > 0.04')} AS fn, gene IN (SELECT p_brand FROM part WHERE p_size = 50) AS known
      FROM lineitem JOIN part ON p_partkey = l_partkey),
    y AS (SELECT *, CASE WHEN region IN ('CodingExonic', 'NonCodingExonic') THEN CASE WHEN motif IS NOT NULL THEN CASE WHEN cons IN ('StopGain', 'NonSyn', 'NonFrameShiftDelete') THEN 'S' ELSE 's' END WHEN cons IN ('StopGain', 'NonSyn', 'NonFrameShiftDelete') THEN 'e' END WHEN region <> 'Intergenic' AND off <= 20 THEN 'i' END AS mark,
      CASE hg WHEN 'DM' THEN 4 WHEN 'DM?' THEN 3 WHEN 'DP' THEN 1 WHEN 'FP' THEN 0 WHEN 'R' THEN -1 ELSE 0 END AS hv, CASE sig WHEN 2 THEN -1 WHEN 5 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS cv FROM x),
    z AS (SELECT *, cv = 1 OR hv > 2 AS clinical, CASE WHEN cv = 1 OR hv > 2 THEN fc ELSE fn END AS kind FROM y)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN clinical THEN 'c' ELSE '' END) || (CASE WHEN kind = 'novel' THEN '4' ELSE '3' END) || mark || (CASE WHEN region LIKE 'NonCoding%' THEN 'n' ELSE '' END) || (CASE WHEN NOT clinical AND known THEN 'g' ELSE '' END) AS class_tag
    FROM z WHERE NOT bad AND cv <> -1 AND hv <> -1 AND kind <> 'frequent' AND mark IS NOT NULL AND NOT (lcr AND NOT clinical)""")
def filter_retained(t: Tables):
    """The plan's filter on annotated rows: frequency, clinical votes, splice motifs, regions, low complexity, pathogenic genes."""
    c = F.col
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    d = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("p_brand").alias("gene"), pick(["CodingExonic", "NonCodingExonic", "CodingIntronic", "UTR5", "UTR3", "NonCodingIntronic", "Intergenic"], c("l_linenumber")).alias("region"), F.when(c("l_partkey") % 5 == 0, "ESE").when(c("l_partkey") % 5 == 1, "ESS").alias("motif"),
        pick(["StopGain", "NonSyn", "NonFrameShiftDelete", "Syn", "NoCDSChange"], c("l_suppkey") % 5 + 1).alias("consequence"), c("l_quantity").cast("int").alias("offset"), (c("l_suppkey") % 6).cast("string").alias("clnsig"), F.array(pick(["DM", "FP", "DP", "R", "DM?", "none"], c("l_orderkey") % 6 + 1)).alias("hgmd"), (c("p_size") < 5).alias("lcr"),
        F.array(F.when((c("l_linestatus") == "O") & (c("l_linenumber") == 2), "BAD").otherwise("PASS")).alias("filter"), F.nullif(c("l_discount"), F.lit(0.0)).alias("exac"), F.nullif(c("l_tax"), F.lit(0.0)).alias("esp"), F.lit(None).cast("double").alias("kg"), F.lit("A").alias("ref"), F.lit("G").alias("alt"),
    )
    config = FilterConfig(filter_include=("PASS",), filter_exclude=("BAD",), frequency=0.04, clinical_frequency=0.06)
    known = t.part.where("p_size = 50").select(c("p_brand").alias("gene"))
    return prioritize.filter_variants(d, config, known).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "class_tag")


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS variant, p_brand AS gene, (['mismatch', 'del', 'mnp'])[l_linenumber % 3 + 1] AS v, (CASE WHEN l_suppkey % 2 = 0 THEN '3' ELSE '4' END) || (['e', 'i', 'S', 's', 'w'])[l_linenumber % 5 + 1] || (CASE l_partkey % 7 WHEN 0 THEN 'H' WHEN 1 THEN 'h' ELSE '' END) AS tag, CASE WHEN l_orderkey % 50 = 0 THEN 'c' ELSE '' END AS c,
      p_size * 10 + 50 AS len, l_tax * 10 AS px, l_discount AS maf, l_quantity / 100 AS pdom, l_quantity / 200 AS pdens, l_partkey, l_suppkey, ([NULL, 'dominant', 'unknown', 'recessive'])[CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 4 + 1] AS inh FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity <= 40),
    k AS (SELECT *, CASE WHEN c = 'c' THEN 'ns' WHEN v = 'mismatch' THEN CASE WHEN tag LIKE '4%' THEN 'ns' ELSE 'r' END WHEN tag LIKE '4%' THEN 'ni' ELSE 'ri' END AS kind, CASE WHEN tag LIKE '%H%' THEN 3 WHEN c = 'c' THEN CASE WHEN tag LIKE '%h%' THEN 2 ELSE 1 END WHEN inh = 'dominant' THEN 3 WHEN tag LIKE '%h%' OR inh = 'unknown' THEN 2 ELSE 1 END AS z, CASE WHEN maf > 0 THEN log10(maf) END AS lg FROM r),
    s AS (SELECT *, (0.5 * (CASE WHEN tag LIKE '%i%' THEN 0.055 WHEN tag LIKE '%e%' THEN 0.35 WHEN contains(tag, 'S') THEN 0.45 WHEN contains(tag, 's') THEN 0.06 ELSE 0.07 END + CASE WHEN c = 'c' THEN 0.5 ELSE 0 END + CASE WHEN maf <= 0 THEN 0.8 ELSE CASE WHEN 0.0125 * lg * lg - 0.093 * lg - 0.298 < 0 THEN 0.1 WHEN 0.0125 * lg * lg - 0.093 * lg - 0.298 > 0.8 THEN 0.8 ELSE 0.0125 * lg * lg - 0.093 * lg - 0.298 END END + pdens) + 0.5 * (px + pdom))
      * CAST((CASE kind WHEN 'r' THEN [0.1, 0.2, 0.75] WHEN 'ns' THEN [0.4, 0.5, 0.85] WHEN 'ni' THEN [0.1, 0.15, 0.25] ELSE [0.2, 0.25, 0.3] END)[z] AS DOUBLE) * CASE WHEN v = 'mnp' THEN 0.5 ELSE 1 END / log10(CAST(len AS DOUBLE)) AS sc FROM k),
    n AS (SELECT *, row_number() OVER (PARTITION BY gene, c ORDER BY sc DESC, variant) AS q FROM s), b AS (SELECT gene, tag LIKE '%H%' AS hom, max(sc) AS sc FROM n WHERE c = '' OR q = 1 GROUP BY 1, 2) SELECT gene, round(sum(sc), 8) AS score FROM b GROUP BY 1""")
def damage_model(t: Tables):
    c = F.col
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    tag = F.concat(F.when(c("l_orderkey") % 50 == 0, "c").otherwise(""), F.when(c("l_suppkey") % 2 == 0, "3").otherwise("4"), pick(["e", "i", "S", "s", "w"], c("l_linenumber") % 5 + 1), F.when(c("l_partkey") % 7 == 0, "H").when(c("l_partkey") % 7 == 1, "h").otherwise(""), F.when(c("l_quantity") > 48, "1").when(c("l_quantity") > 45, "2").when(c("l_quantity") > 40, "b").otherwise(""))
    d = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    rows = d.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("variant"), c("p_brand").alias("gene"), pick(["mismatch", "del", "mnp"], c("l_linenumber") % 3 + 1).alias("vartype"), tag.alias("class_tag"), (c("p_size") * 10 + 50).alias("protein_len"), (c("l_tax") * 10).alias("px"), c("l_discount").alias("maf"), (c("l_quantity") / 100).alias("pdom"), (c("l_quantity") / 200).alias("pdens"))
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % 4
    inherit = t.part.select(c("p_brand").alias("gene"), F.when(number == 1, "dominant").when(number == 2, "unknown").when(number == 3, "recessive").alias("inherit")).distinct()
    return prioritize.damage_of(rows, inherit).select("gene", F.round("score", 8).alias("score"))


def _rank_sql(rounds: int, tolerance: float) -> str:
    return f"""WITH RECURSIVE {_BOTH}, nd AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node, 'Brand#' || CAST(s_nationkey AS VARCHAR) AS gene FROM supplier), l AS (SELECT src, dst, sum(q) AS w FROM (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst, l_quantity AS q FROM lineitem UNION ALL SELECT 'p' || CAST(l_partkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR), l_quantity FROM lineitem) GROUP BY 1, 2),
    rs AS (SELECT src, sum(w) AS r FROM l GROUP BY 1), cs AS (SELECT dst, sum(w) AS c FROM l GROUP BY 1), e AS MATERIALIZED (SELECT src, dst, w / (sqrt(r) * sqrt(c)) AS w FROM l JOIN rs USING (src) JOIN cs USING (dst)),
    y0 AS MATERIALIZED (SELECT node, seed AS v, true AS o FROM nd JOIN c USING (gene) UNION ALL SELECT gene, seed, false FROM c WHERE gene NOT IN (SELECT gene FROM nd)), y AS MATERIALIZED (SELECT node, o, v / (SELECT sum(v) FROM y0) AS v FROM y0),
    s AS (SELECT 0 AS i, node, o, CAST(0 AS DOUBLE) AS v, CAST(1 AS DOUBLE) AS d FROM y UNION ALL
      SELECT i, node, o, v, sum(abs(v - old)) OVER () AS d FROM (SELECT max(i) OVER () AS i, node, o, v / sum(v) OVER () AS v, old FROM (SELECT max(i) + 1 AS i, node, o, sum(v) AS v, sum(old) AS old FROM (
        SELECT i, node, o, v * 0.98 AS v, v AS old FROM s WHERE d >= {tolerance} AND i < {rounds} UNION ALL SELECT i, src, true, e.w * v * 0.018, 0 FROM e JOIN s ON node = dst AND o WHERE d >= {tolerance} AND i < {rounds}
        UNION ALL SELECT NULL, node, o, v * 0.02 * (1 - 0.9), 0 FROM y WHERE EXISTS (SELECT 1 FROM s WHERE d >= {tolerance} AND i < {rounds})) GROUP BY 2, 3))),
    f AS (SELECT coalesce(nd.gene, s.node) AS gene, max(v) AS v FROM s LEFT JOIN nd ON nd.node = s.node WHERE i = (SELECT max(i) FROM s) GROUP BY 1)
    SELECT coalesce(f.gene, c.gene) AS gene, round(coalesce(v, 0), 8) AS predicted_score, round(coalesce(seed, 0), 8) AS seed_score, coalesce(f.gene, c.gene) IN (SELECT p_brand FROM part WHERE p_size = 50) AS contain_known_pathogenic FROM f FULL JOIN c ON c.gene = f.gene"""


def _links(t: Tables):
    """Edges between suppliers and parts, both ways."""
    both = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.col("l_quantity").alias("w"))
    return both.union(both.select("dst", "src", "w"))


@query(_rank_sql(150, 1e-4))
def gene_ranking(t: Tables):
    """The plan's last step: both kinds of evidence combined, spread over a network until the stop rule holds, and ranked."""
    nodes = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"), F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("gene"))
    links = _links(t)
    known = t.part.where("p_size = 50").select(F.col("p_brand").alias("gene"))
    out = prioritize.rank(*_evidence(t), links, nodes, known)
    return out.select("gene", F.round("predicted_score", 8).alias("predicted_score"), F.round("seed_score", 8).alias("seed_score"), "contain_known_pathogenic")


@query()
def prioritize_end_to_end(t: Tables):
    """The whole run on proxies, most resources given: variants of all transcripts, a patient's terms, diseases, a network; ranked genes.

    Its steps have queries with SQL (enrichment: combined_evidence), and a test compares a run's scores with plain Python.
    """
    c = F.col
    tx = _transcripts(t)
    v = _variants(t).select("chrom", c("start").alias("pos"), "ref", "alt", F.array(F.lit("PASS")).alias("filter"), F.when(c("k") % 5 == 0, "1/1").otherwise("0/1").alias("gt")).where("ref <> alt AND ref <> '-' AND alt <> '-'")
    site = v.select("chrom", "pos", "ref", "alt").distinct()
    span = site.select("chrom", c("pos").alias("start"), (c("pos") + 40).alias("end"))
    r = prioritize.Resources(
        tx,
        frequencies=site.where("pos % 3 = 0").withColumns({"exac": (c("pos") % 7 / 100.0).cast("double"), "esp": F.lit(None).cast("double"), "kg": F.lit(None).cast("double")}),
        clinvar=site.where("pos % 50 = 1").withColumn("clnsig", F.when(c("pos") % 100 == 1, "5").otherwise("2")),
        cadd=site.withColumns({"cadd_raw": (c("pos") % 11).cast("double"), "cadd_aa": F.lit("K/R")}),
        conserved=span.withColumn("score", (c("start") % 9).cast("double")),
        pathogenic_genes=t.part.where("p_size = 50").select(c("p_brand").alias("gene")),
        splice_motifs=tx.select("chrom", (c("tx_start") + 7).alias("pos"), "accession", F.lit("ESE").alias("motif")),
        domains=t.part.select(c("p_partkey").alias("idx"), (c("p_partkey") % 22 + 1).cast("string").alias("dchrom"), (100 * c("p_partkey")).cast("int").alias("dstart"), (100 * c("p_partkey") + 30).cast("int").alias("dend"), c("p_brand").alias("gene"), c("p_type").alias("description")),
        density=t.part.select(c("p_partkey").alias("idx"), (c("p_size") % 7).alias("benign"), (c("p_size") % 5).alias("vus"), (c("p_size") % 11).alias("pathogenic")),
        fits=t.spark.createDataFrame([("cadd", 0, "K", 2.0, 5.0, -1.0, 13.0, 2.7), ("cadd", 1, "K", 4.0, 2.0, -1.0, 13.0, 7.7)], "model string, class int, aa string, a double, b double, loc double, scale double, mean double"),
    )
    is_a = t.supplier.where("s_suppkey > 0").select(c("s_suppkey").cast("string").alias("term"), F.floor(c("s_suppkey") / 3).cast("string").alias("parent"))
    dis = t.orders.join(t.lineitem, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").cast("string").alias("disease_id"), c("l_suppkey").cast("string").alias("term")).distinct()
    of = t.orders.join(t.lineitem, c("l_orderkey") == c("o_orderkey")).join(t.part, c("l_partkey") == c("p_partkey"))
    of = of.select(c("o_custkey").cast("string").alias("disease_id"), F.lit("").alias("description"), c("p_brand").alias("gene"), F.lit("recessive").alias("inherit")).distinct()
    p = prioritize.Phenotypes(t.supplier.where("s_acctbal > 8000").select(c("s_suppkey").cast("string").alias("term")), dis, is_a, of)
    nodes = t.supplier.select(F.concat(F.lit("s"), c("s_suppkey")).alias("node"), F.concat(F.lit("Brand#"), c("s_nationkey")).alias("gene"))
    return prioritize.prioritize(v, r, FilterConfig(), p, _links(t), nodes, "gt")["genes"].select("gene", "predicted_score", "seed_score", "gt_dmg_score", "pheno_score", "contain_known_pathogenic")


@query(f"""WITH RECURSIVE {_ontology(49)},
    il AS (SELECT term, ic FROM ic), ta AS (SELECT DISTINCT term FROM a), an AS (SELECT c.term, c.ancestor, il.ic FROM c JOIN ta USING (term) JOIN il ON il.term = c.ancestor WHERE il.ic > 0),
    tp AS (SELECT a1.term AS x, a2.term AS y, max(a1.ic) AS common FROM an a1 JOIN an a2 ON a1.ancestor = a2.ancestor GROUP BY 1, 2), lin AS (SELECT x, y, 2 * common / (i.ic + k.ic) AS lin FROM tp JOIN il i ON i.term = x JOIN il k ON k.term = y),
    dp AS (SELECT a1.disease AS d, a2.disease AS e, a1.term AS x, a2.term AS y, lin FROM a a1 JOIN lin ON lin.x = a1.term JOIN a a2 ON a2.term = lin.y WHERE a1.disease <> a2.disease),
    fw AS (SELECT d, e, sum(m) AS f FROM (SELECT d, e, x, max(lin) AS m FROM dp GROUP BY 1, 2, 3) GROUP BY 1, 2), sz AS (SELECT disease, count(*) AS n FROM a GROUP BY 1),
    sc AS (SELECT p.d, p.e, greatest(p.f / s1.n, q.f / s2.n) AS score FROM fw p JOIN fw q ON q.d = p.e AND q.e = p.d JOIN sz s1 ON s1.disease = p.d JOIN sz s2 ON s2.disease = p.e),
    rk AS (SELECT d, e, score, row_number() OVER (PARTITION BY d ORDER BY score DESC, e) AS place FROM sc WHERE score >= 0.6) SELECT d AS disease_id, e AS other, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM rk WHERE place <= 5""")
def similar_diseases(t: Tables):
    """For each disease its most similar other ones."""
    is_a = t.supplier.where("s_suppkey > 0").select(F.col("s_suppkey").alias("term"), F.floor(F.col("s_suppkey") / 3).alias("parent"))
    a = t.orders.join(t.lineitem.where("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("disease_id"), F.col("l_suppkey").alias("term")).distinct()
    return phenotype.similar_diseases(a, is_a, 5, 0.6).select("disease_id", "other", F.round("score", 6).alias("score"), "place")
