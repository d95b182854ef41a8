"""Lookups and interval joins. Proxies: a site is a line item, a reference site or an interval is a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import aggregates, intervals, sites, store
from varloom.queries.base import Tables, query
from varloom.storage import fresh_path

_LINE = "l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus"


def _variants(t: Tables):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", (c("l_suppkey") % 24).alias("chrom"), c("l_partkey").alias("pos"), c("l_returnflag").alias("ref"), c("l_linestatus").alias("alt"), "l_quantity", "l_extendedprice")


def _reference(t: Tables):
    """Reference sites: one allele of small parts, both of those with an even key."""
    alts = F.when(F.col("p_partkey") % 2 == 0, "F,O").otherwise("F")
    ref = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.where("p_size <= 25").select(F.col("p_partkey").alias("pos"), ref.alias("ref"), alts.alias("alts"), F.col("p_retailprice").alias("value"), F.col("p_brand").alias("brand"))


_REF = """ref_sites AS (SELECT p_partkey AS pos, ['A', 'N', 'R'][p_partkey % 3 + 1] AS ref, unnest(string_split(CASE WHEN p_partkey % 2 = 0 THEN 'F,O' ELSE 'F' END, ',')) AS alt,
    p_retailprice AS value, p_brand AS brand FROM part WHERE p_size <= 25)"""
_VAR = "variants AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_suppkey % 24 AS chrom, l_partkey AS pos, l_returnflag AS ref, l_linestatus AS alt, l_quantity, l_extendedprice FROM lineitem)"


@query(f"WITH {_REF}, {_VAR} SELECT l_orderkey, l_linenumber, pos, ref, alt, value FROM variants LEFT JOIN ref_sites USING (pos, ref, alt)")
def site_lookup_exact(t: Tables):
    ref = sites.explode_alleles(_reference(t), "alts")
    return sites.lookup(_variants(t), ref, ["pos", "ref", "alt"], ["value"]).select("l_orderkey", "l_linenumber", "pos", "ref", "alt", "value")


@query(f"""WITH {_REF}, v AS (SELECT DISTINCT l_partkey AS pos, l_returnflag AS ref, l_linestatus AS alt FROM lineitem),
    parts AS (SELECT pos, ref, alt, k AS i, pos + k + 1 AS p2 FROM v, (SELECT unnest([0, 1]) AS k)),
    second AS (SELECT x.pos, x.ref, x.alt, string_agg(coalesce(CAST(CAST(r.value AS DECIMAL(12, 2)) AS VARCHAR), '.'), ':' ORDER BY i) AS s, bool_or(r.value IS NOT NULL) AS hit
        FROM parts x LEFT JOIN ref_sites r ON r.pos = x.p2 AND r.ref = x.ref AND r.alt = x.alt GROUP BY ALL)
    SELECT v.pos, v.ref, v.alt, coalesce(CAST(CAST(r.value AS DECIMAL(12, 2)) AS VARCHAR), CASE WHEN second.hit THEN second.s END) AS value
    FROM v LEFT JOIN ref_sites r USING (pos, ref, alt) LEFT JOIN second USING (pos, ref, alt)""")
def site_lookup_two_stage(t: Tables):
    v = _variants(t).select("pos", "ref", "alt").distinct().withColumn("row", F.concat_ws("_", "pos", "ref", "alt"))
    part = lambda k: F.struct((F.col("pos") + k + 1).alias("p"), F.col("ref").alias("r"), F.col("alt").alias("a"))
    v = v.withColumn("parts", F.array(part(0), part(1)))
    ref = sites.explode_alleles(_reference(t), "alts").withColumn("value", F.col("value").cast("decimal(12,2)"))
    return sites.two_stage(v, ref, ["pos", "ref", "alt"], "parts", ["p", "r", "a"], "value", "row").select("pos", "ref", "alt", "value")


@query(f"""WITH {_REF}, {_VAR} SELECT l_orderkey, l_linenumber, v.pos, v.ref, v.alt, value FROM variants v LEFT JOIN (SELECT pos, ref, alt, max(value) AS value FROM ref_sites GROUP BY ALL) USING (pos, ref, alt)""")
def site_store_lookup(t: Tables):
    """Lookups in a bucketed store, which is read where variants lie and never moved."""
    ref = sites.explode_alleles(_reference(t), "alts").select(F.lit("1").alias("chrom"), "pos", "ref", "alt", "value")
    made = store.SiteStore.write(ref, fresh_path(t.spark, "sites"), buckets=8, region=1024)
    v = _variants(t).withColumns({"chrom": F.lit("1")})
    return made.lookup(v, ["value"]).select("l_orderkey", "l_linenumber", "pos", "ref", "alt", "value")


@query(f"""WITH {_REF}, {_VAR}, known AS (SELECT DISTINCT brand FROM ref_sites), v AS (SELECT v.*, p_brand AS brand FROM variants v JOIN part ON p_partkey = pos)
    SELECT l_orderkey, l_linenumber, v.pos, v.ref, v.alt, v.brand, CAST(CASE WHEN r.alt = v.alt THEN 3 WHEN r.alt IS NOT NULL THEN 2 WHEN k.brand IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS level
    FROM v LEFT JOIN ref_sites r ON r.pos = v.pos AND r.ref = v.ref LEFT JOIN known k ON k.brand = v.brand""")
def site_match_level(t: Tables):
    v = _variants(t).join(t.part.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand")), "pos")
    ref = sites.explode_alleles(_reference(t), "alts")
    return sites.match_level(v, ref, ["pos", "ref"], "alt", "brand").select("l_orderkey", "l_linenumber", "pos", "ref", "alt", "brand", "level")


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, l_extendedprice"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)
    OVER (PARTITION BY l_orderkey ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM lineitem) WHERE seen = 0""")
def first_match_then_stop(t: Tables):
    return sites.until_first(t.lineitem, ["l_orderkey"], _ORDER.split(", "), F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


def _intervals(t: Tables):
    c = F.col
    return t.part.select((c("p_partkey") % 24).alias("ichrom"), c("p_partkey").alias("start"), (c("p_partkey") + c("p_size")).alias("end"), c("p_brand").alias("brand"), c("p_retailprice").alias("price"), c("p_size").alias("size"))


_IV = "iv AS (SELECT p_partkey % 24 AS ichrom, p_partkey AS start_, p_partkey + p_size AS end_, p_brand AS brand, p_retailprice AS price, p_size AS size FROM part)"
_HIT = "chrom = ichrom AND pos BETWEEN start_ AND end_"


@query(f'WITH {_IV}, {_VAR} SELECT l_orderkey, l_linenumber, pos, start_ AS "start", end_ AS "end", brand FROM variants JOIN iv ON {_HIT}')
def interval_containment(t: Tables):
    return intervals.point_join(_variants(t), _intervals(t), "chrom", "pos", "ichrom", "start", "end").select("l_orderkey", "l_linenumber", "pos", "start", "end", "brand")


@query(f"WITH {_IV}, {_VAR} SELECT l_orderkey, l_linenumber, chrom, pos FROM variants WHERE EXISTS (SELECT 1 FROM iv WHERE {_HIT})")
def interval_mask_semi(t: Tables):
    return intervals.point_join(_variants(t), _intervals(t), "chrom", "pos", "ichrom", "start", "end", how="left_semi").select("l_orderkey", "l_linenumber", "chrom", "pos")


@query(f"""WITH {_IV}, {_VAR}, {_REF} SELECT l_orderkey, l_linenumber, v.pos, v.ref, v.alt, value FROM variants v LEFT JOIN ref_sites USING (pos, ref, alt)
    WHERE EXISTS (SELECT 1 FROM iv WHERE size > 10 AND {_HIT.replace('pos', 'v.pos')})""")
def mask_then_lookup(t: Tables):
    v = intervals.point_join(_variants(t), _intervals(t).where("size > 10"), "chrom", "pos", "ichrom", "start", "end", how="left_semi")
    return sites.lookup(v, sites.explode_alleles(_reference(t), "alts"), ["pos", "ref", "alt"], ["value"]).select("l_orderkey", "l_linenumber", "pos", "ref", "alt", "value")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, event_type FROM events), g AS (SELECT user_id, s, event_id FROM e WHERE event_type = 'signup')
    SELECT e.event_id, e.user_id, e.s,
      (SELECT max_by(g.event_id, (g.s, g.event_id)) FROM g WHERE g.user_id = e.user_id AND g.s < e.s AND g.s >= e.s - 43200) AS previous_gene,
      (SELECT arg_min(g.event_id, (g.s, -g.event_id)) FROM g WHERE g.user_id = e.user_id AND g.s > e.s AND g.s <= e.s + 43200) AS next_gene FROM e""")
def nearest_neighbours(t: Tables):
    e = t.events.select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "event_type")
    g = e.where("event_type = 'signup'").select(F.col("user_id").alias("gu"), F.col("s").alias("gs"), F.col("event_id").alias("gene"))
    return intervals.nearest(e.drop("event_type"), g, "user_id", "s", "gu", "gs", "gene", 43200)


@query(f"WITH {_IV}, {_VAR} SELECT chrom, pos, max(price) AS price FROM variants JOIN iv ON {_HIT} GROUP BY ALL")
def interval_best_score(t: Tables):
    points = _variants(t).select("chrom", "pos").distinct()
    return intervals.best_score(points, _intervals(t), ["chrom", "pos"], "chrom", "pos", "ichrom", "start", "end", "price")


@query(f"""WITH {_IV}, v AS (SELECT DISTINCT l_suppkey % 24 AS chrom, l_partkey AS pos FROM lineitem)
    SELECT chrom, pos, start_ AS "start", end_ AS "end", CASE WHEN pos < start_ THEN '5p' WHEN pos > end_ THEN '3p' ELSE 'core' END AS place,
      CAST(CASE WHEN pos < start_ THEN start_ - pos WHEN pos > end_ THEN pos - end_ ELSE 0 END AS BIGINT) AS distance
    FROM v JOIN iv ON chrom = ichrom AND pos BETWEEN start_ - 7 AND end_ + 7""")
def interval_core_flank(t: Tables):
    points = _variants(t).select("chrom", "pos").distinct()
    return intervals.flanks(points, _intervals(t), "chrom", "pos", "ichrom", "start", "end", 7).select("chrom", "pos", "start", "end", "place", "distance")


@query(f"""WITH {_IV} SELECT a.brand, count(*) AS n, CAST(sum(b.size) AS BIGINT) AS size_sum FROM iv a JOIN iv b
    ON a.ichrom = b.ichrom AND a.start_ <= b.end_ AND b.start_ <= a.end_ AND a.start_ < b.start_ GROUP BY a.brand HAVING sum(b.size) > 0""")
def interval_overlap_groupsum(t: Tables):
    a = _intervals(t)
    b = a.select(*[F.col(c).alias(f"b_{c}") for c in a.columns])
    hit = intervals.overlap_join(a, b, "ichrom", "start", "end", "b_ichrom", "b_start", "b_end").where(F.col("start") < F.col("b_start"))
    return hit.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.sum("b_size").alias("size_sum")).where("size_sum > 0")


@query(f"""WITH {_IV}, o AS (SELECT *, max(end_) OVER (PARTITION BY ichrom ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ichrom ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT ichrom, min(start_) AS "start", max(end_) AS "end", count(*) AS n FROM g GROUP BY ichrom, island""")
def interval_merge(t: Tables):
    return intervals.merge(_intervals(t), "ichrom", "start", "end")


@query("""WITH p AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
    f AS (SELECT a.p_brand AS gene1, b.p_brand AS gene2, count(*) AS denominator FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY ALL),
    both_ AS (SELECT gene1 AS a, gene2 AS b, denominator FROM f UNION ALL SELECT gene2, gene1, denominator FROM f)
    SELECT a, b, max(denominator / 100.0) AS score FROM both_ WHERE denominator >= 2 AND denominator / 100.0 >= 0.02 AND a IN ('Brand#1', 'Brand#2', 'Brand#3') AND b NOT IN ('Brand#1', 'Brand#2', 'Brand#3')
    GROUP BY a, b ORDER BY score DESC, a, b LIMIT 50""")
def symmetric_pairs_topn(t: Tables):
    from varloom.operators import phenotype

    p = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    q = p.select(F.col("l_orderkey").alias("o2"), F.col("p_brand").alias("gene2"))
    f = p.join(q, (F.col("l_orderkey") == F.col("o2")) & (F.col("p_brand") < F.col("gene2"))).groupBy(F.col("p_brand").alias("gene1"), "gene2").agg(F.count(F.lit(1)).alias("denominator"))
    f = f.withColumn("score", F.col("denominator") / 100.0)
    brands, few = t.part.select(F.col("p_brand").alias("gene")), ["Brand#1", "Brand#2", "Brand#3"]
    out = phenotype.pairs_above(f, brands.where(F.col("gene").isin(few)), brands.where(~F.col("gene").isin(few)), 0.02, 2)
    return out.orderBy(F.desc("score"), "a", "b").limit(50)


@query("""WITH s AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT c_custkey, round(coalesce(total, (SELECT min(total) FROM s) * 1.25), 4) AS total FROM customer LEFT JOIN s USING (c_custkey)""")
def left_merge_fill_min(t: Tables):
    s = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return aggregates.left_fill_min(t.customer.select("c_custkey"), s, "c_custkey", "total", 1.25).select("c_custkey", F.round("total", 4).alias("total"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_insert(t: Tables):
    have = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return aggregates.insert_absent(t.customer.select("c_custkey", "c_name"), have, ["c_custkey"])


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def anti_delete(t: Tables):
    gone = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return aggregates.insert_absent(t.part.select("p_partkey", "p_brand"), gone, ["p_partkey"])


@query("""WITH m AS (SELECT DISTINCT o_custkey, extract(month FROM o_orderdate) AS item FROM orders), s AS (SELECT DISTINCT o_orderpriority AS prio, extract(month FROM o_orderdate) AS item FROM orders WHERE o_totalprice > 480000),
    z AS (SELECT o_custkey, count(*) AS n_items FROM m GROUP BY 1)
    SELECT m.o_custkey, s.prio, count(*) AS n_shared, any_value(z.n_items) AS n_items, round(count(*) / any_value(z.n_items), 6) AS ratio FROM m JOIN s USING (item) JOIN z ON z.o_custkey = m.o_custkey
    GROUP BY m.o_custkey, s.prio HAVING count(*) / any_value(z.n_items) > 0.8""")
def coverage_ratio_join(t: Tables):
    month = F.month("o_orderdate").alias("item")
    sets = t.orders.where("o_totalprice > 480000").select(F.col("o_orderpriority").alias("prio"), month)
    return aggregates.coverage(t.orders.select("o_custkey", month), sets, "o_custkey", "prio", "item", 0.8).withColumn("ratio", F.round("ratio", 6))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def all_pairs_lt(t: Tables):
    return aggregates.all_pairs(t.nation, "n_name", "a", "b")


@query("""WITH v AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), a AS (SELECT l_partkey, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS ids FROM (SELECT DISTINCT l_partkey, p_size AS o FROM v JOIN part ON p_partkey = l_partkey WHERE p_size <= 25) GROUP BY 1),
    b AS (SELECT l_partkey, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS ids FROM (SELECT DISTINCT v.l_partkey, l_orderkey AS o FROM v JOIN lineitem l ON l.l_partkey = v.l_partkey WHERE l_quantity > 40) GROUP BY 1)
    SELECT p.l_partkey, coalesce(a.ids, 'NULL') AS sizes, coalesce(b.ids, 'NULL') AS large_orders FROM (SELECT DISTINCT l_partkey FROM v) p LEFT JOIN a USING (l_partkey) LEFT JOIN b USING (l_partkey)""")
def dblink_pivot(t: Tables):
    v = t.lineitem.select("l_partkey").distinct()
    sizes = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("id"))
    large = t.lineitem.where("l_quantity > 40").select("l_partkey", F.col("l_orderkey").alias("id"))
    return sites.source_links(v, ["l_partkey"], {"sizes": sizes, "large_orders": large}, ["l_partkey"], "id")
