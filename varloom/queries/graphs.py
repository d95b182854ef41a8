"""Networks and disease tables. Proxies: suppliers and parts are the two sides of a graph, orders are diseases."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import network, phenotype
from varloom.queries.base import Tables, query
from varloom.storage import HELD_BYTES, partitions


def _edges(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w"))


_EDGES = """e AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT src, sum(w) AS r FROM e GROUP BY 1), c AS (SELECT dst, sum(w) AS c FROM e GROUP BY 1),
    n AS (SELECT src, dst, w / (sqrt(r) * sqrt(c)) AS w FROM e JOIN r USING (src) JOIN c USING (dst))"""


@query(f"WITH {_EDGES} SELECT src, dst, round(w, 8) AS w FROM n")
def edge_normalize(t: Tables):
    return network.normalize_edges(_edges(t)).select("src", "dst", F.round("w", 8).alias("w"))


def _square(t: Tables):
    """Edges from suppliers to parts and back, parts under negative numbers."""
    both = t.lineitem.select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"), F.col("l_quantity").alias("w"))
    return both.union(both.select("dst", "src", "w"))


def _heat_sql(k: int) -> str:
    out = """WITH l AS (SELECT l_suppkey AS s, -1 - l_partkey AS p, l_quantity AS q FROM lineitem), e AS (SELECT src, dst, sum(q) AS w FROM (SELECT s AS src, p AS dst, q FROM l UNION ALL SELECT p, s, q FROM l) GROUP BY 1, 2), r AS (SELECT src, sum(w) AS r FROM e GROUP BY 1), c AS (SELECT dst, sum(w) AS c FROM e GROUP BY 1),
    n AS (SELECT src, dst, w / (sqrt(r) * sqrt(c)) AS w FROM e JOIN r USING (src) JOIN c USING (dst)),
    y AS (SELECT node, v / sum(v) OVER () AS v FROM (SELECT s_suppkey AS node, sum(abs(s_acctbal)) AS v FROM supplier GROUP BY 1)), s0 AS (SELECT node, 0.0 AS v FROM y)"""
    for i in range(1, k + 1):
        out += f""", a{i} AS (SELECT node, sum(v) AS v FROM (SELECT node, v * 0.98 AS v FROM s{i - 1} UNION ALL SELECT src, w * v * 0.018 FROM n JOIN s{i - 1} ON node = dst UNION ALL SELECT node, v * 0.02 * (1 - 0.9) FROM y) GROUP BY 1),
    s{i} AS (SELECT node, v / (SELECT sum(v) FROM a{i}) AS v FROM a{i})"""
    return out + f" SELECT node, round(v, 8) AS value FROM s{k}"


@query(_heat_sql(3))
def heat_diffusion_k(t: Tables):
    y = t.supplier.groupBy(F.col("s_suppkey").alias("node")).agg(F.sum(F.abs("s_acctbal")).alias("value"))
    total = y.agg(F.sum("value").alias("t"))
    y = y.join(F.broadcast(total)).select("node", (F.col("value") / F.col("t")).alias("value"))
    return network.heat_diffusion(network.normalize_edges(_square(t)), y, rounds=3).select("node", F.round("value", 8).alias("value"))


_NATIONS = """l AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
    r AS (SELECT src, sum(w) AS r FROM l GROUP BY 1), c AS (SELECT dst, sum(w) AS c FROM l GROUP BY 1), n AS MATERIALIZED (SELECT src, dst, w / (sqrt(r) * sqrt(c)) AS w FROM l JOIN r USING (src) JOIN c USING (dst)),
    y AS MATERIALIZED (SELECT node, v / sum(v) OVER () AS v FROM (SELECT s_nationkey AS node, sum(abs(s_acctbal)) AS v FROM supplier GROUP BY 1))"""


def _nations(t: Tables):
    """Trade between nations: edges of the whole tables on few nodes, so that SQL can run many rounds."""
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    y = t.supplier.groupBy(F.col("s_nationkey").alias("node")).agg(F.sum(F.abs("s_acctbal")).alias("value"))
    total = y.agg(F.sum("value").alias("t"))
    return d.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("w")), y.join(F.broadcast(total)).select("node", (F.col("value") / F.col("t")).alias("value"))


def _first_still(k: int, last: str) -> str:
    """The rows of the first round under the tolerance, or of the last one."""
    rounds = " UNION ALL ".join(f"SELECT {i} AS i, node, v, (SELECT d FROM d{i}) AS d FROM {last}{i}" for i in range(1, k + 1))
    return f" , z AS ({rounds}) SELECT node, round(v, 7) AS value, CAST(i AS INTEGER) AS rounds FROM z WHERE i = (SELECT coalesce(min(i) FILTER (d < tol.t), {k}) FROM z, tol)"


def _heat_still_sql(k: int, tolerance: float) -> str:
    out = f"WITH tol AS (SELECT {tolerance} AS t), {_NATIONS}, s0 AS MATERIALIZED (SELECT node, 0.0 AS v FROM y)"
    for i in range(1, k + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT node, sum(v) AS v FROM (SELECT node, v * 0.7 AS v FROM s{i - 1} UNION ALL SELECT src, w * v * 0.27 FROM n JOIN s{i - 1} ON node = dst UNION ALL SELECT node, v * 0.3 * (1 - 0.9) FROM y) GROUP BY 1),
    s{i} AS MATERIALIZED (SELECT node, v / (SELECT sum(v) FROM a{i}) AS v FROM a{i}), d{i} AS MATERIALIZED (SELECT sum(abs(coalesce(p.v, 0) - coalesce(q.v, 0))) AS d FROM s{i} p FULL JOIN s{i - 1} q USING (node))"""
    return out + _first_still(k, "s")


@query(_heat_still_sql(30, 1e-3))
def heat_diffusion_still(t: Tables):
    """Diffusion until its stop rule holds, and the number of rounds it took."""
    edges, y = _nations(t)
    out = network.heat_diffusion(network.normalize_edges(edges), y, gamma=30, tolerance=1e-3, max_rounds=30)
    return out.select("node", F.round("value", 7).alias("value"), F.lit(out._varloom_rounds).alias("rounds"))


def _bipartite_still_sql(k: int, tolerance: float) -> str:
    out = f"WITH tol AS (SELECT {tolerance} AS t), {_NATIONS}, r0 AS MATERIALIZED (SELECT node, v FROM y), c0 AS MATERIALIZED (SELECT dst AS node, 0.0 AS v FROM c)"
    for i in range(1, k + 1):
        out += f""", r{i} AS MATERIALIZED (SELECT node, sum(v) AS v FROM (SELECT src AS node, n.w * x.v * 0.5 AS v FROM n JOIN c{i - 1} x ON x.node = n.dst UNION ALL SELECT node, v * 0.5 FROM y) GROUP BY 1),
    c{i} AS MATERIALIZED (SELECT dst AS node, sum(n.w * x.v * 0.5) AS v FROM n JOIN r{i - 1} x ON x.node = n.src GROUP BY 1),
    d{i} AS MATERIALIZED (SELECT greatest((SELECT max(abs(coalesce(p.v, 0) - coalesce(q.v, 0))) FROM r{i} p FULL JOIN r{i - 1} q USING (node)), (SELECT max(abs(coalesce(p.v, 0) - coalesce(q.v, 0))) FROM c{i} p FULL JOIN c{i - 1} q USING (node))) AS d)"""
    return out + _first_still(k, "r")


@query(_bipartite_still_sql(25, 1e-4))
def bipartite_diffusion_still(t: Tables):
    """Bipartite diffusion until no value moves any more, and the number of rounds it took."""
    edges, y = _nations(t)
    out = network.bipartite_diffusion(edges, y, a=0.5, tolerance=1e-4, max_rounds=25)
    return out.select("node", F.round("value", 7).alias("value"), F.lit(out._varloom_rounds).alias("rounds"))


def _bipartite_sql(k: int) -> str:
    out = f"WITH {_EDGES}, q AS (SELECT s_suppkey AS node, abs(s_acctbal) / (SELECT sum(abs(s_acctbal)) FROM supplier WHERE s_acctbal > 0) AS v FROM supplier WHERE s_acctbal > 0), r0 AS (SELECT node, v FROM q), c0 AS (SELECT dst AS node, 0.0 AS v FROM c)"
    for i in range(1, k + 1):
        out += f""", r{i} AS (SELECT node, sum(v) AS v FROM (SELECT src AS node, n.w * x.v * 0.75 AS v FROM n JOIN c{i - 1} x ON x.node = n.dst UNION ALL SELECT node, v * 0.25 FROM q) GROUP BY 1),
    c{i} AS (SELECT dst AS node, sum(n.w * x.v * 0.75) AS v FROM n JOIN r{i - 1} x ON x.node = n.src GROUP BY 1)"""
    return out + f" SELECT node, round(v, 8) AS value FROM r{k} ORDER BY v DESC, node LIMIT 25"


@query(_bipartite_sql(3))
def bipartite_diffusion_k(t: Tables):
    r0 = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"), F.abs("s_acctbal").alias("value"))
    out = network.bipartite_diffusion(_edges(t), r0, rounds=3)
    return out.orderBy(F.desc("value"), "node").limit(25).select("node", F.round("value", 8).alias("value"))


def _apart(d):
    """Distinct rows of diseases, in partitions as many as the input asks for."""
    return d.repartition(partitions(d.sparkSession, d, each=HELD_BYTES), "disease_id").distinct()


@query("""WITH g AS (SELECT p_brand AS gene, sum(p_retailprice) AS seed FROM part WHERE p_size > 45 GROUP BY 1), d AS (SELECT o_orderkey AS disease, o_totalprice AS score, p_brand AS gene FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
    u AS (SELECT DISTINCT disease, score, d.gene, seed FROM d LEFT JOIN g ON g.gene = d.gene)
    SELECT disease, score, count(DISTINCT gene) AS n_genes, count(DISTINCT CASE WHEN seed IS NOT NULL THEN gene END) AS n_mutated, round(avg(seed), 4) AS avg_seed, max(round(seed, 4)) AS max_seed,
      string_agg(gene || (CASE WHEN seed IS NOT NULL THEN '^' ELSE '' END), ',' ORDER BY gene) AS genes FROM u GROUP BY 1, 2""")
def disease_rank_table(t: Tables):
    d = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    d = _apart(d.select(F.col("o_orderkey").alias("disease_id"), F.lit("").alias("description"), F.col("p_brand").alias("gene"), F.col("o_totalprice").alias("score")))
    g = t.part.where("p_size > 45").groupBy(F.col("p_brand").alias("gene")).agg(F.sum("p_retailprice").alias("seed_score"))
    out = phenotype.disease_table(d, g.withColumns({"predicted_score": F.col("seed_score"), "pathogenic": F.lit(False)}))
    return out.select(F.col("disease_id").alias("disease"), "score", "n_genes", "n_mutated", F.round("avg_seed", 4).alias("avg_seed"), F.round("max_seed", 4).alias("max_seed"), "genes")


@query("""WITH g AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size > 45), d AS (SELECT DISTINCT o_orderkey AS disease, p_brand AS gene FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
    e AS (SELECT DISTINCT a.p_brand AS x, b.p_brand AS y FROM part a JOIN part b ON a.p_retailprice = b.p_retailprice AND a.p_brand <> b.p_brand), w AS (SELECT DISTINCT p_brand AS gene, p_type AS path FROM part WHERE p_size > 40),
    h AS (SELECT DISTINCT disease, y FROM d JOIN e ON x = d.gene JOIN g ON g.gene = y JOIN w wx ON wx.gene = x JOIN w wy ON wy.gene = y AND wy.path = wx.path WHERE d.gene NOT IN (SELECT gene FROM g)),
    o AS (SELECT disease, string_agg(y, ',' ORDER BY y) AS external_genes FROM h GROUP BY 1) SELECT t.disease, coalesce(external_genes, '') AS external_genes FROM (SELECT DISTINCT disease FROM d) t LEFT JOIN o ON o.disease = t.disease""")
def disease_external_genes(t: Tables):
    """Mutated network neighbours of a disease's unmutated genes, in a pathway that both share."""
    d = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    d = _apart(d.select(F.col("o_orderkey").alias("disease_id"), F.lit("").alias("description"), F.col("p_brand").alias("gene"), F.lit(1.0).alias("score")))
    g = t.part.where("p_size > 45").groupBy(F.col("p_brand").alias("gene")).agg(F.sum("p_retailprice").alias("seed_score")).withColumns({"predicted_score": F.lit(0.0), "pathogenic": F.lit(False)})
    price = t.part.select("p_brand", "p_retailprice").distinct()  # parts of one brand and price make the same pairs
    near = price.select(F.col("p_brand").alias("src"), "p_retailprice").join(price.select(F.col("p_brand").alias("dst"), "p_retailprice"), "p_retailprice").where("src <> dst").select("src", "dst").distinct()
    paths = t.part.where("p_size > 40").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("pathway")).distinct()
    return phenotype.disease_table(d, g, near, paths).select(F.col("disease_id").alias("disease"), "external_genes")


@query("""WITH d AS (SELECT DISTINCT o_orderkey AS disease, o_totalprice AS score, p_brand AS gene FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), m AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size > 25),
    h AS (SELECT d.* FROM d JOIN m USING (gene)), n AS (SELECT disease, count(DISTINCT gene) AS n FROM h GROUP BY 1), s AS (SELECT gene, disease, score / ln(n + 3) AS s FROM h JOIN n USING (disease))
    SELECT gene, disease AS disease_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY s DESC, disease) AS r FROM s) WHERE r = 1""")
def phenotype_gene_score(t: Tables):
    d = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    d = d.select(F.col("o_orderkey").alias("disease_id"), F.col("p_brand").alias("gene"), F.col("o_totalprice").alias("score")).distinct()
    out = phenotype.gene_scores(d, t.part.where("p_size > 25").select(F.col("p_brand").alias("gene")))
    return out.select("gene", "disease_id", F.round("score", 6).alias("score"))


@query("SELECT node, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS neighbours FROM (SELECT l_suppkey AS node, -1 - l_partkey AS o FROM lineitem UNION SELECT -1 - l_partkey, l_suppkey FROM lineitem) GROUP BY 1")
def adjacency_lists(t: Tables):
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))
    return network.adjacency(e).select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))
