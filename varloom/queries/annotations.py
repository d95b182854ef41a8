"""Annotation joins on proxy columns: a part is a prediction or a clinical record, an order a variant.

All rows take part. Reference tables lack rows by a value (a size, an account balance), never by an id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import annotations
from varloom.queries.base import Tables, query


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice, p_type FROM part WHERE p_size <= 25), r AS (SELECT p_brand, p_size, max_by(p_type, p_retailprice) AS t FROM p GROUP BY 1, 2)
    SELECT o.p_partkey, o.p_brand, o.p_size, coalesce(p.p_type, r.t) AS pred FROM part o LEFT JOIN p ON p.p_partkey = o.p_partkey LEFT JOIN r ON r.p_brand = o.p_brand AND r.p_size = o.p_size""")
def effect_prediction_two_modes(t: Tables):
    p = t.part.where("p_size <= 25").withColumn("pred", F.col("p_type"))
    return annotations.effect_predictions(t.part.select("p_partkey", "p_brand", "p_size"), p, ["p_partkey"], ["p_brand", "p_size"], "p_retailprice", ["pred"]).select("p_partkey", "p_brand", "p_size", "pred")


@query("""WITH s AS (SELECT p_partkey AS pos, p_size % 2 AS r, p_size FROM part WHERE p_size <= 25), v AS (SELECT DISTINCT l_partkey FROM lineitem),
    b AS (SELECT l_partkey, unnest([0, 1, 2]) AS i FROM v), e AS (SELECT l_partkey, i, max(p_size) AS x FROM b LEFT JOIN s ON pos = l_partkey + i AND r = i % 2 GROUP BY 1, 2)
    SELECT l_partkey, string_agg(coalesce(CAST(x AS VARCHAR), '.'), ':' ORDER BY i) AS scores FROM e GROUP BY 1""")
def per_base_scores(t: Tables):
    s = t.part.where("p_size <= 25").select(F.lit("1").alias("chrom"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 2).cast("string").alias("ref"), F.lit("x").alias("alt"), F.col("p_size").alias("scores"))
    v = t.lineitem.select("l_partkey").distinct().withColumn("c", F.lit("1"))
    v = v.withColumn("bases", F.array(*[F.struct(F.lit(str(i % 2)).alias("ref"), F.lit("x").alias("alt")) for i in range(3)]))
    out = annotations.per_base_scores(v, s, "l_partkey", "c", "l_partkey", "bases", "scores")
    return out.select("l_partkey", F.array_join(F.transform("scores", lambda x: x.cast("string")), ":", ".").alias("scores"))


@query("""WITH a AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1, o_custkey + 2]) AS acc, unnest([0, 1, 2]) AS i FROM orders), s AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0),
    f AS (SELECT o_orderkey, arg_min(acc, i) AS accession, arg_min(s_nationkey, i) AS vid FROM a JOIN s ON s_suppkey = acc GROUP BY 1), u AS (SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) || '|' || n_name AS submitters FROM nation)
    SELECT o.o_orderkey, f.accession, CAST(f.vid AS INTEGER) AS variation_id, u.submitters FROM orders o LEFT JOIN f USING (o_orderkey) LEFT JOIN u ON n_nationkey = f.vid""")
def clinical_first_hit(t: Tables):
    rec = t.orders.select(F.col("o_orderkey").alias("row"), F.array(*[F.col("o_custkey") + i for i in range(3)]).alias("accessions"))
    every = rec.select(F.explode("accessions").alias("accession")).distinct().join(t.supplier.where("s_acctbal > 0"), F.col("accession") == F.col("s_suppkey"))
    summary = every.select("accession", F.col("s_nationkey").alias("variation_id"), F.lit("r").alias("review"))
    subs = t.nation.select(F.col("n_nationkey").alias("variation_id"), F.col("n_regionkey").cast("string").alias("submitter")).union(t.nation.select("n_nationkey", "n_name"))
    return annotations.clinical_records(rec, summary, subs).select(F.col("row").alias("o_orderkey"), "accession", "variation_id", "submitters")


@query("""SELECT c_custkey AS disease_id, n_name AS gene, max(s_acctbal) AS score FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey
    WHERE s_acctbal >= 3000 GROUP BY 1, 2""")
def disease_genes_by_mapping(t: Tables):
    d = t.customer.select(F.col("c_custkey").alias("disease_id"), F.col("c_nationkey").alias("concept"))
    a = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("concept"), F.col("n_name").alias("gene"), F.col("s_acctbal").alias("score"))
    return annotations.disease_genes(d, d, a, 3000).select("disease_id", "gene", "score")


@query("""SELECT c_custkey, p.phenotypes FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '__' ORDER BY o_orderpriority) AS phenotypes FROM orders GROUP BY 1) p ON o_custkey = c_custkey""")
def gene_phenotype_lookup(t: Tables):
    table = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("phenotypes"))
    return annotations.by_key(t.customer.select("c_custkey"), table, "c_custkey", "phenotypes")


@query("""WITH d AS (SELECT p_partkey AS idx, p_partkey % 24 AS c, p_partkey AS s, p_partkey + p_size AS e, p_brand AS gene, CAST(p_size % 2 AS BIGINT) AS b, CAST(p_size % 3 AS BIGINT) AS v, CAST(p_size % 5 AS BIGINT) AS p FROM part WHERE p_size < 30),
    q AS (SELECT DISTINCT l_partkey AS pos, l_partkey % 24 AS c FROM lineitem)
    SELECT pos, gene, CAST(sum(b) AS BIGINT) AS benign, CAST(sum(v) AS BIGINT) AS vus, CAST(sum(p) AS BIGINT) AS pathogenic FROM q JOIN d ON d.c = q.c AND pos <= e AND s <= pos + 2 GROUP BY 1, 2 HAVING sum(b) + sum(v) + sum(p) > 0""")
def domain_density(t: Tables):
    c = F.col
    p = t.part.where("p_size < 30")
    dom = p.select(c("p_partkey").alias("idx"), (c("p_partkey") % 24).alias("dchrom"), c("p_partkey").alias("dstart"), (c("p_partkey") + c("p_size")).alias("dend"), c("p_brand").alias("gene"), c("p_name").alias("description"))
    den = p.select(c("p_partkey").alias("idx"), *[(c("p_size") % m).cast("long").alias(n) for n, m in (("benign", 2), ("vus", 3), ("pathogenic", 5))])
    v = t.lineitem.select(c("l_partkey").alias("pos"), (c("l_partkey") % 24).alias("chrom"), c("l_partkey").alias("start"), (c("l_partkey") + 2).alias("end")).distinct()
    return annotations.domain_density(v, dom, den, "pos", "chrom", "start", "end").select("pos", "gene", "benign", "vus", "pathogenic")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 2")
def first_rows_per_key(t: Tables):
    return annotations.first_rows(t.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 2).select("o_orderkey", "o_custkey")


@query("""WITH g AS (SELECT l_orderkey, p_brand, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR) || ':' || p_type, '|' ORDER BY CAST(l_linenumber AS VARCHAR) || ':' || p_type) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT l_orderkey, string_agg(p_brand || '(' || t || ')', ';' ORDER BY p_brand || '(' || t || ')') AS transcripts FROM g GROUP BY 1""")
def packed_transcripts(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return annotations.pack_transcripts(d, ["l_orderkey"], "p_brand", ["l_linenumber", "p_type"])
