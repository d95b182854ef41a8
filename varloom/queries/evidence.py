"""Evidence for the damage model, masks, nearest genes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import damage
from varloom.operators import annotations, family
from varloom.plans import prioritize
from varloom.queries.base import Tables, query
from varloom.queries.models import _TRIO, _TX, _transcripts
from varloom.sources import sinks


@query("""WITH s AS (SELECT p_brand, min(p_retailprice) AS loc, max(p_retailprice) - min(p_retailprice) AS scale, avg(p_retailprice) AS mean, var_pop(p_retailprice) AS v FROM part GROUP BY 1), m AS (SELECT *, (mean - loc) / nullif(scale, 0) AS mu, v / nullif(scale * scale, 0) AS va FROM s)
    SELECT p_brand, round(mu * (mu * (1 - mu) / nullif(va, 0) - 1), 5) AS a, round((1 - mu) * (mu * (1 - mu) / nullif(va, 0) - 1), 5) AS b, loc, round(scale, 6) AS scale FROM m""")
def beta_fits(t: Tables):
    return damage.beta_moments(t.part, "p_brand", "p_retailprice").select("p_brand", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), "loc", F.round("scale", 6).alias("scale"))


_FITS = [("cadd", 0, "A", 2.0, 5.0, -2.0, 60.0, 10.0), ("cadd", 1, "A", 4.0, 2.0, -2.0, 60.0, 30.0), ("cadd", 0, "B", 3.0, 3.0, 0.0, 60.0, 40.0), ("cadd", 1, "B", 2.0, 2.0, 0.0, 60.0, 20.0), ("cadd", 1, "C", 2.0, 2.0, 0.0, 60.0, 30.0)]


@query("""WITH x AS (SELECT p_partkey, ['A', 'B', 'C', 'D'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS aa, p_size AS s, (p_size + 2) / 60.0 AS z FROM part),
    y AS (SELECT *, exp(1.0 * ln(z) + 4.0 * ln(1 - z) - (lgamma(2.0) + lgamma(5.0) - lgamma(7.0))) AS d0, exp(3.0 * ln(z) + 1.0 * ln(1 - z) - (lgamma(4.0) + lgamma(2.0) - lgamma(6.0))) AS d1 FROM x)
    SELECT p_partkey, round(CASE WHEN aa = 'A' THEN d1 / (d0 + d1) ELSE 0.5 END, 6) AS px FROM y""")
def conservation_probability(t: Tables):
    """Two-class probability of a score by amino acid; a half where a class has no fit or the benign one scores higher."""
    fits = t.spark.createDataFrame(_FITS, "model string, class int, aa string, a double, b double, loc double, scale double, mean double")
    d = t.part.select("p_partkey", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("aa"), F.col("p_size").cast("double").alias("s"))
    return damage.conservation_probability(d, fits, "cadd", "aa", "s", "px").select("p_partkey", F.round("px", 6).alias("px"))


@query("""WITH x AS (SELECT p_partkey, p_size % 7 AS b, p_size % 5 AS v, p_size % 11 AS p FROM part), y AS (SELECT *, b + v + p AS n, CASE WHEN b + v + p > 0 THEN p / (b + v + p) ELSE 0 END AS q FROM x)
    SELECT p_partkey, round(CASE WHEN n > 0 THEN (q + 1.15034938 * 1.15034938 / (2 * n) - 1.15034938 * sqrt((q * (1 - q) + 1.15034938 * 1.15034938 / (4 * n)) / n)) / (1 + 1.15034938 * 1.15034938 / n) ELSE 0 END, 6) AS pdom, log10(p + 1e-12) >= (SELECT median(log10(p + 1e-12)) FROM x) AS upper_half FROM y""")
def domain_evidence(t: Tables):
    """The bound of the pathogenic share; the fitted probability is over a half just where the count lies in the upper half."""
    c = F.col
    d = t.part.select("p_partkey", (c("p_size") % 7).alias("benign"), (c("p_size") % 5).alias("vus"), (c("p_size") % 11).alias("pathogenic"))
    d = d.withColumn("denominator", c("benign") + c("vus") + c("pathogenic"))
    out = damage.domain_evidence(d, "p_partkey")
    lowest = d.where(F.log10(c("pathogenic") + 1e-12) >= F.lit(d.agg(F.percentile(F.log10(c("pathogenic") + 1e-12), F.lit(0.5))).first()[0])).select("p_partkey").join(out, "p_partkey").agg(F.min("pdens")).first()[0]
    return out.select("p_partkey", F.round("pdom", 6).alias("pdom"), (c("pdens") >= F.lit(lowest)).alias("upper_half"))


@query(f"""WITH {_TX}, q AS (SELECT DISTINCT l_partkey * 100 + l_suppkey * 3 AS pos, CAST(l_partkey % 22 + 1 AS VARCHAR) AS c FROM lineitem)
    SELECT pos, c AS chrom, (SELECT max_by(gene, (e2, gene)) FROM m WHERE m.chrom = c AND e2 < pos AND e2 >= pos - 5000) AS previous_gene,
      (SELECT gene FROM m WHERE m.chrom = c AND a + 1 = (SELECT min(a + 1) FROM m m2 WHERE m2.chrom = c AND m2.a + 1 > pos AND m2.a + 1 <= pos + 5000)) AS next_gene FROM q""")
def nearest_genes(t: Tables):
    """The genes before and after intergenic variants, 5,000 bases away at most."""
    c = F.col
    d = t.lineitem.select((c("l_partkey") * 100 + c("l_suppkey") * 3).alias("pos"), (c("l_partkey") % 22 + 1).cast("string").alias("chrom")).distinct()
    d = d.select("pos", "chrom", c("pos").cast("int").alias("start"), F.concat_ws("_", "chrom", "pos").alias("variant"), F.lit("Intergenic").alias("region"))
    return prioritize.beside(d, _transcripts(t)).select("pos", "chrom", "previous_gene", "next_gene")


@query(f"""WITH {_TX}, v AS (SELECT p_partkey, CAST(p_partkey % 22 + 1 AS VARCHAR) AS c, 100 * p_partkey + p_size * 2 - 45 AS pos, p_size % 30 AS span FROM part)
    SELECT p_partkey FROM v WHERE EXISTS (SELECT 1 FROM ex WHERE ex.chrom = c AND (pos BETWEEN s0 + 1 - 5 AND e0 + 5 OR pos + span BETWEEN s0 + 1 - 5 AND e0 + 5))""")
def mask_deletions(t: Tables):
    """Variants near an exon by their first base, or by the last that they delete."""
    c = F.col
    v = t.part.select("p_partkey", (c("p_partkey") % 22 + 1).cast("string").alias("chrom"), (100 * c("p_partkey") + c("p_size") * 2 - 45).alias("pos"), (c("p_size") % 30).alias("span"))
    return prioritize.mask(v, _transcripts(t), 5, "span").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 40)")
def frequency_prefilter(t: Tables):
    v = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_partkey").alias("pos"))
    f = t.part.select(F.col("p_partkey").alias("pos"), (F.col("p_size") / 800).alias("af"))
    return annotations.prefilter(v, f, ["pos"], "af").drop("pos")


@query("""WITH RECURSIVE s AS (SELECT p_brand, min(p_retailprice) - 0.01 * (max(p_retailprice) - min(p_retailprice)) AS loc, 1.02 * (max(p_retailprice) - min(p_retailprice)) AS scale FROM part GROUP BY 1),
    z AS (SELECT p_brand, loc, scale, (p_retailprice - loc) / scale AS z FROM part JOIN s USING (p_brand) WHERE scale > 0), m AS (SELECT p_brand, any_value(loc) AS loc, any_value(scale) AS scale, avg(ln(z)) AS l0, avg(ln(1 - z)) AS l1, avg(z) AS mu, var_pop(z) AS v FROM z GROUP BY 1),
    n(p_brand, i, a, b) AS (SELECT p_brand, 0, mu * greatest(mu * (1 - mu) / v - 1, 0.1), (1 - mu) * greatest(mu * (1 - mu) / v - 1, 0.1) FROM m UNION ALL
      SELECT p_brand, i + 1, greatest(a - ((tb - tc) * ga + tc * gb) / ((ta - tc) * (tb - tc) - tc * tc), a / 2), greatest(b - ((ta - tc) * gb + tc * ga) / ((ta - tc) * (tb - tc) - tc * tc), b / 2) FROM (SELECT p_brand, i, a, b, pa - pc - l0 AS ga, pb - pc - l1 AS gb, ta, tb, tc FROM (SELECT n.*, l0, l1,
        (lgamma(a + 1e-4) - lgamma(a - 1e-4)) / 2e-4 AS pa, (lgamma(b + 1e-4) - lgamma(b - 1e-4)) / 2e-4 AS pb, (lgamma(a + b + 1e-4) - lgamma(a + b - 1e-4)) / 2e-4 AS pc,
        (lgamma(a + 1e-3) - 2 * lgamma(a) + lgamma(a - 1e-3)) / 1e-6 AS ta, (lgamma(b + 1e-3) - 2 * lgamma(b) + lgamma(b - 1e-3)) / 1e-6 AS tb, (lgamma(a + b + 1e-3) - 2 * lgamma(a + b) + lgamma(a + b - 1e-3)) / 1e-6 AS tc FROM n JOIN m USING (p_brand) WHERE i < 40)))
    SELECT p_brand, round(a, 3) AS a, round(b, 3) AS b, round(loc, 4) AS loc, round(scale, 4) AS scale FROM n JOIN m USING (p_brand) WHERE i = 40""")
def likelihood_fits(t: Tables):
    out = damage.beta_likelihood(t.part, ["p_brand"], "p_retailprice").where("a is not null")
    return out.select("p_brand", *[F.round(n, k).alias(n) for n, k in (("a", 3), ("b", 3), ("loc", 4), ("scale", 4))])


@query("""WITH n AS (SELECT s_nationkey AS id, min(s_name) AS p FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) SELECT 'P' || CAST(c_custkey AS VARCHAR) AS accession, 'G' || CAST(c_custkey AS VARCHAR) AS gene, c_nationkey AS mim_id, CASE WHEN p IS NOT NULL THEN 'of_' || p END AS phenotype FROM customer LEFT JOIN n ON id = c_nationkey""")
def mim_phenotypes(t: Tables):
    c = F.col
    g = t.customer.select(F.concat(F.lit("P"), c("c_custkey")).alias("accession"), F.concat(F.lit("G"), c("c_custkey")).alias("gene"), c("c_nationkey").alias("mim_id"))
    names = t.supplier.where("s_acctbal > 3000").select(c("s_nationkey").alias("mim_id"), F.concat(F.lit("{of}, "), "s_name").alias("phenotype"))
    return annotations.mim_phenotypes(g, names)


@query("SELECT DISTINCT o_custkey AS uniprot, o_orderpriority AS gene FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def genes_of_accessions(t: Tables):
    pairs = t.orders.select(F.col("o_custkey").alias("uniprot"), F.col("o_orderpriority").alias("gene")).distinct()
    return annotations.genes_of(t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("uniprot")), pairs)


@query("""WITH r AS (SELECT s_suppkey AS region, s_suppkey * 20 AS s, s_suppkey * 20 + s_nationkey AS e FROM supplier), v AS (SELECT l_partkey AS pos, l_linenumber % 3 - 1 AS v FROM lineitem)
    SELECT region, count(*) FILTER (v = -1) AS benign, count(*) FILTER (v = 0) AS vus, count(*) FILTER (v = 1) AS pathogenic FROM r LEFT JOIN v ON pos BETWEEN s AND e GROUP BY 1""")
def clinical_counts_in_regions(t: Tables):
    c = F.col
    r = t.supplier.select(c("s_suppkey").alias("region"), F.lit("1").alias("chrom"), (c("s_suppkey") * 20).alias("start"), (c("s_suppkey") * 20 + c("s_nationkey")).alias("end"))
    v = t.lineitem.select(F.lit("1").alias("schrom"), c("l_partkey").alias("pos"), (c("l_linenumber") % 3 - 1).alias("vote"))
    return annotations.counts_between(r, v, "vote").select("region", "benign", "vus", "pathogenic")


@query("""WITH x AS (SELECT p_partkey AS pos, CASE WHEN p_size > 10 THEN p_brand END AS g, CASE WHEN p_size > 5 THEN 'N1' END AS b, CASE WHEN p_size % 2 = 0 THEN 'N2' END AS n, p_type AS region FROM part), y AS (SELECT *, coalesce(g, '(' || coalesce(b, n) || ')', '.') AS gene FROM x)
    SELECT '7' AS chrom, pos, gene, region, '=HYPERLINK("https://www.ncbi.nlm.nih.gov/snp/?term=7:' || CAST(pos AS VARCHAR) || '")' AS site_link, CASE WHEN gene <> '.' THEN '=HYPERLINK("https://www.genenames.org/tools/search/#!/?query=' || replace(replace(gene, '(', ''), ')', '') || '")' END AS gene_link FROM y""")
def variant_report(t: Tables):
    c = F.col
    s = c("p_size")
    d = t.part.select(F.lit("7").alias("chrom"), c("p_partkey").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.when(s > 10, c("p_brand")).alias("gene"), F.when(s > 5, "N1").alias("previous_gene"), F.when(s % 2 == 0, "N2").alias("next_gene"), c("p_type").alias("region"), F.lit("Syn").alias("consequence"), F.lit("3e").alias("class_tag"), F.lit(0.5).alias("gene_score"))
    return sinks.report(d).select("chrom", "pos", "gene", "region", "site_link", "gene_link")


@query(f"WITH {_TRIO} SELECT gene, transcript, CAST(haplotype AS INTEGER) AS haplotype, count(*) AS n FROM g WHERE n > 1 AND z = 1 GROUP BY ALL")
def downstream_report(t: Tables):
    c = F.col
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), c("l_linenumber"))
    gt = lambda a, b: F.concat((a % 2).cast("string"), F.lit("/"), (b % 2).cast("string"))
    d = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    trio = d.select(c("p_brand").alias("gene"), c("l_suppkey").alias("transcript"), F.lit("CodingExonic").alias("region"), pick(["FrameShiftInsert", "NonSyn", "FrameShiftDelete", "StopGain", "Syn", "NonSyn", "Syn"]).alias("consequence"), c("l_partkey").alias("pos"), F.lit(1).cast("bigint").alias("size"), F.lit("PASS").alias("filter"),
                    gt(c("l_orderkey"), c("l_partkey")).alias("father"), gt(c("l_suppkey"), c("l_orderkey") + c("l_partkey")).alias("mother"), gt(c("l_linenumber"), c("l_suppkey") + c("l_linenumber")).alias("child"), "l_orderkey", "l_linenumber")
    return sinks.downstream_report(family.downstream(trio, tie=["l_orderkey", "l_linenumber"])).select("gene", "transcript", "haplotype", "n")


@query("""WITH c AS (SELECT count(*) AS n, count(*) - count(c_custkey) AS a, count(*) - count(c_name) AS b, count(*) - count(c_nationkey) AS c, count(*) - count(c_acctbal) AS d, count(*) - count(c_mktsegment) AS e FROM customer), o AS (SELECT count(*) AS n, count(*) - count(n_nationkey) AS a, count(*) - count(n_name) AS b, count(*) - count(n_regionkey) AS c FROM nation)
    SELECT 'customer' AS "table", CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS place, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "column", unnest(['bigint', 'string', 'int', 'double', 'string']) AS type, n AS rows, unnest([a, b, c, d, e]) AS nulls FROM c
    UNION ALL SELECT 'nation', unnest([0, 1, 2]), unnest(['n_nationkey', 'n_name', 'n_regionkey']), unnest(['int', 'string', 'int']), n, unnest([a, b, c]) FROM o""")
def table_schemas(t: Tables):
    return sinks.catalogue(t.spark, {n: f"{t.sf_dir}/{n}.parquet" for n in ("customer", "nation")})
