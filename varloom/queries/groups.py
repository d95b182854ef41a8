"""Aggregations, rankings and ordered folds. Proxies: a gene is a brand, a disease an order or a customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import clinical, damage
from varloom.operators import aggregates
from varloom.queries.base import Tables, query


@query("""SELECT n_name AS gene, round(max(s), 4) AS longest FROM (SELECT c_nationkey, c_custkey, sum(o_totalprice) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
    JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def nested_max_of_sum(t: Tables):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.nested_max_of_sum(d.withColumnRenamed("n_name", "gene"), ["gene"], ["c_custkey"], "o_totalprice", "longest").select("gene", F.round("longest", 4).alias("longest"))


@query("""SELECT p_brand, CAST(sum(greatest(0, least(p_partkey + p_size, 1500) - greatest(p_partkey, 40))) AS BIGINT) AS coding FROM part GROUP BY 1""")
def clipped_length_sum(t: Tables):
    size = aggregates.clipped_length(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), F.lit(40), F.lit(1500))
    return t.part.groupBy("p_brand").agg(F.sum(size).alias("coding"))


@query("SELECT l_suppkey, " + ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{r}' AND l_linestatus = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {r.lower()}_{s.lower()}" for r in "ANR" for s in "FO") + " FROM lineitem GROUP BY 1")
def class_by_type_pivot(t: Tables):
    return aggregates.pivot_counts(t.lineitem, ["l_suppkey"], "l_returnflag", list("ANR"), "l_linestatus", list("FO"))


@query("""WITH g AS (SELECT p_brand, sum(p_retailprice) AS v, sum(p_size) AS l FROM part GROUP BY 1)
    SELECT p_brand, round((v / l) / (sum(v) OVER () / sum(l) OVER ()), 6) AS density FROM g""")
def density_normalize(t: Tables):
    return aggregates.density(t.part, ["p_brand"], "p_retailprice", "p_size", "density").withColumn("density", F.round("density", 6))


@query("""WITH b AS (SELECT p_brand, l_linestatus, max(l_extendedprice) AS s FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, l_linestatus) AS r FROM b) SELECT p_brand, round(sum(s), 4) AS score FROM r WHERE r <= 2 GROUP BY 1""")
def top2_sum_per_group(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.top_sum(d, ["p_brand"], ["l_linestatus"], "l_extendedprice", 2, "score").withColumn("score", F.round("score", 4))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def argmax_per_group(t: Tables):
    return aggregates.argmax(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey", "o_totalprice"])


_SPEND = "WITH s AS (SELECT o_custkey AS gene, sum(o_totalprice) AS v FROM orders GROUP BY 1)"


def _spend(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("gene")).agg(F.sum("o_totalprice").alias("v"))


@query(f"{_SPEND} SELECT gene, round(v / (SELECT sum(v) FROM s), 8) AS score FROM s")
def normalize_by_sum(t: Tables):
    return aggregates.normalize(_spend(t), "v", "sum", "score").select("gene", F.round("score", 8).alias("score"))


@query(f"{_SPEND} SELECT gene, round(v / (SELECT max(v) FROM s), 8) AS score FROM s")
def normalize_by_max(t: Tables):
    return aggregates.normalize(_spend(t), "v", "max", "score").select("gene", F.round("score", 8).alias("score"))


@query("SELECT o_totalprice AS kth FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 100")
def kth_score(t: Tables):
    return aggregates.kth_largest(t.orders, "o_totalprice", 100, "kth")


@query("""WITH m AS (SELECT l_suppkey, l_returnflag, l_linestatus, avg(l_quantity) AS mean_score, count(*) AS denominator FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_suppkey, l_returnflag, l_linestatus, round(mean_score, 6) AS mean_score, denominator FROM
    (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY denominator > 1 DESC, mean_score DESC, l_linestatus) AS r FROM m) WHERE r = 1""")
def pair_best_pref_denom(t: Tables):
    return aggregates.best_pair(t.lineitem, "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").withColumn("mean_score", F.round("mean_score", 6))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '__' ORDER BY o_orderpriority) AS phenotypes FROM orders GROUP BY 1")
def concat_distinct(t: Tables):
    return aggregates.concat_distinct(t.orders, ["o_custkey"], "o_orderpriority", "__", "phenotypes")


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.15), 6) AS p15, round(quantile_cont(p_retailprice, 0.5), 6) AS p50 FROM part GROUP BY 1")
def exact_percentile(t: Tables):
    out = aggregates.percentiles(t.part, ["p_brand"], "p_retailprice", {"p15": 0.15, "p50": 0.5})
    return out.select("p_brand", F.round("p15", 6).alias("p15"), F.round("p50", 6).alias("p50"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.15), 6) AS p15, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1")
def percentile_by_refinement(t: Tables):
    """Percentiles of few keys that hold a third of all rows each."""
    out = aggregates.refined_percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p15": 0.15, "p50": 0.5, "p99": 0.99})
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p15", "p50", "p99")])


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS n_top, count(*) FILTER (l_returnflag = 'A') AS n_under,
    coalesce(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') / nullif(count(*) FILTER (l_returnflag = 'A'), 0) > 0.5, false) AS male FROM lineitem GROUP BY 1""")
def conditional_ratio(t: Tables):
    return aggregates.ratio_flag(t.lineitem, ["l_suppkey"], F.expr("l_returnflag = 'R' AND l_linestatus = 'O'"), F.expr("l_returnflag = 'A'"), 0.5, "male")


_TYPES = {"ECONOMY": "CodingExonic", "LARGE": "UTR5", "MEDIUM": "UTR3", "PROMO": "CodingIntronic", "SMALL": "NonCodingExonic", "STANDARD": "A_B_boundary"}
_TYPE_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


@query(f"""WITH p AS (SELECT p_brand, p_partkey, {_TYPE_CASE} AS region FROM part) SELECT p_brand, p_partkey, region FROM
    (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN region LIKE '%boundary%' THEN 0 WHEN region = 'CodingExonic' THEN 1 WHEN region = 'UTR5' THEN 2 WHEN region = 'UTR3' THEN 3 WHEN region = 'CodingIntronic' THEN 4 ELSE 5 END, p_partkey) AS r FROM p) WHERE r = 1""")
def severity_rank_first(t: Tables):
    d = t.part.select("p_brand", "p_partkey", F.expr(_TYPE_CASE).alias("region"))
    return aggregates.argmax(d, ["p_brand"], [clinical.region_rank(F.col("region")).asc(), F.asc("p_partkey")], ["p_partkey", "region"])


@query("""WITH s AS (SELECT event_id, user_id, ts, CAST(event_id % 5 - 2 AS BIGINT) AS size FROM events),
    r AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM s),
    b AS (SELECT *, coalesce(last_value(CASE WHEN total % 3 = 0 THEN total END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM r)
    SELECT event_id, user_id, CAST(total - base AS BIGINT) AS running FROM b""")
def island_state_fold(t: Tables):
    d = t.events.select("event_id", "user_id", "ts", (F.col("event_id") % 5 - 2).alias("size"))
    return aggregates.fold_until_restored(d, ["user_id"], ["ts", "event_id"], "size").select("event_id", "user_id", "running")


@query("SELECT p_brand, p_size, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS number FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def dense_number_distinct(t: Tables):
    return aggregates.dense_number(t.part, ["p_brand"], "p_size", "number")


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n FROM r GROUP BY user_id, run""")
def run_length_collapse(t: Tables):
    return aggregates.run_lengths(t.events, ["user_id"], ["event_id"], "event_type")


@query("SELECT p_brand, p_partkey, p_size FROM part WHERE p_size > 45 UNION ALL SELECT p_brand, p_partkey, p_size FROM part WHERE p_type = 'PROMO'")
def bag_union(t: Tables):
    cols = ["p_brand", "p_partkey", "p_size"]
    return aggregates.append(t.part.where("p_size > 45").select(cols), t.part.where("p_type = 'PROMO'").select(cols))


@query("SELECT DISTINCT p_brand, p_size FROM part WHERE p_type = 'PROMO' EXCEPT SELECT p_brand, p_size FROM part WHERE p_type = 'LARGE'")
def set_difference(t: Tables):
    cols = ["p_brand", "p_size"]
    return aggregates.set_difference(t.part.where("p_type = 'LARGE'").select(cols), t.part.where("p_type = 'PROMO'").select(cols))


@query("SELECT p_brand, p_size FROM part WHERE p_type = 'PROMO' INTERSECT SELECT p_brand, p_size FROM part WHERE p_type = 'LARGE'")
def set_intersection(t: Tables):
    cols = ["p_brand", "p_size"]
    return aggregates.set_intersection(t.part.where("p_type = 'PROMO'").select(cols), t.part.where("p_type = 'LARGE'").select(cols))


@query("SELECT p_brand, p_size FROM part WHERE p_type = 'PROMO' UNION SELECT p_brand, p_size FROM part WHERE p_type = 'LARGE'")
def set_union(t: Tables):
    cols = ["p_brand", "p_size"]
    return aggregates.set_union(t.part.where("p_type = 'PROMO'").select(cols), t.part.where("p_type = 'LARGE'").select(cols))


@query("SELECT o_totalprice AS kth FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET (SELECT CAST(floor(0.05 * count(*) + 0.5) AS BIGINT) FROM orders)")
def kth_score_by_fraction(t: Tables):
    return aggregates.kth_largest(t.orders, "o_totalprice", 0.05, "kth")


@query("SELECT DISTINCT p_brand AS gene FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 45")
def distinct_genes_of_class(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_brand", "gene")
    return aggregates.distinct_where(d, F.expr("l_returnflag = 'R' AND l_quantity > 45"), "gene")


@query("""WITH g AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), a AS (SELECT p_brand, arg_min(p_type, (n, p_type)) AS least FROM g GROUP BY 1), l AS (SELECT p_brand, n, max(p_type) AS t FROM g GROUP BY 1, 2)
    SELECT p_brand, least, string_agg(CAST(n AS VARCHAR) || '=' || t, ';' ORDER BY n) AS swapped FROM a JOIN l USING (p_brand) GROUP BY 1, 2""")
def map_helpers(t: Tables):
    g = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m"))
    pairs = F.array_sort(F.map_entries(aggregates.swapped(F.col("m"))))
    return g.select("p_brand", aggregates.first_key(F.col("m")).alias("least"), F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ";").alias("swapped"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('seed' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def sample_exact(t: Tables):
    return aggregates.sample_exact(t.orders, 500, "seed", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_genes, max(o_orderkey) AS max_id, count(*) AS n FROM orders GROUP BY 1")
def distinct_counts(t: Tables):
    return aggregates.key_counts(t.orders, ["o_orderstatus"], "o_custkey", "o_orderkey").withColumnRenamed("n_distinct", "n_genes")


@query("""WITH g AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_brand, n FROM
    (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r FROM g) WHERE r <= 3""")
def top_k_per_group(t: Tables):
    g = t.part.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.top_rows(g, ["p_type"], [F.desc("n"), F.asc("p_brand")], 3)


_L = "log10((l_discount + 0.001))"
_Y = f"(0.0125 * {_L} * {_L} - 0.093 * {_L} - 0.298)"
_RARE = "l_discount < 0.05 AND NOT (l_tax > 0.06)"
_SCORE = f"""(CASE WHEN l_returnflag = 'R' THEN 0.45 WHEN l_returnflag = 'A' THEN 0.35 ELSE 0.055 END + CASE WHEN {_Y} < 0 THEN 0.1 WHEN {_Y} > 0.8 THEN 0.8 ELSE {_Y} END) * 0.5 + 0.5 * 0.5"""


@query(f"""WITH v AS (SELECT p_brand AS gene, CASE WHEN l_linestatus = 'F' THEN 'hom' ELSE 'het' END AS zygosity,
      ({_SCORE}) * CASE WHEN l_linestatus = 'F' THEN 0.75 ELSE 0.1 END / log10(p_size + 10.0) AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_RARE}),
    b AS (SELECT gene, zygosity, max(s) AS s FROM v GROUP BY 1, 2), g AS (SELECT gene, sum(s) AS s FROM b GROUP BY 1)
    SELECT gene, round(s / (SELECT sum(s) FROM g), 8) AS score FROM g""")
def gene_damage_rank(t: Tables):
    """The flagship: rare sites, weighted by tag, zygosity and length, best per zygosity, summed and normalized per gene."""
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.greatest(*[F.when(clinical.frequency_class([F.col(c)], limit) == "frequent", 1).otherwise(0) for c, limit in (("l_discount", 0.0499999), ("l_tax", 0.06))])
    tag = F.when(F.col("l_returnflag") == "R", "3S").when(F.col("l_returnflag") == "A", "3e").otherwise("3i")
    zygosity = F.when(F.col("l_linestatus") == "F", "hom").otherwise("het")
    weight = damage.allele_weight(F.lit("rare"), zygosity, F.lit(False))
    score = damage.variant_score(tag, F.col("l_discount") + 0.001, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), weight, F.col("p_size") + 10)
    rows = d.where(kind == 0).select(F.col("p_brand").alias("gene"), zygosity.alias("zygosity"), score.alias("s"))
    genes = damage.gene_scores(rows, "gene", "zygosity", "s", "s")
    return aggregates.normalize(genes, "s", "sum", "score").select("gene", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "gene")
