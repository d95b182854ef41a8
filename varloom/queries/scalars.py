"""Scalar functions on proxy columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import clinical, damage, sequence, variant
from varloom.queries.base import Tables, query
from varloom.sources import vcf

_BASES = "translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', 'ACGTACGTACGTACGTACGTACGTACG')"


def _bases(c: str = "p_name"):
    return F.translate(F.upper(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "ACGTACGTACGTACGTACGTACGTACG")


def _case(values: dict, of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE 'X' END"


@query("""WITH i AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, l_returnflag AS flag, CAST(CAST(l_tax * 100 AS INTEGER) AS VARCHAR) AS t FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(q AS INTEGER) AS quantity, flag = 'R' AS has_r, CAST(t AS INTEGER) AS tax FROM i""")
def parse_info_map(t: Tables):
    text = F.concat(F.lit("Q="), F.col("l_quantity").cast("int").cast("string"), F.lit(";"), F.col("l_returnflag"), F.lit(";T="), F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", vcf.parse_info(text).alias("info"))
    get = lambda k: F.try_element_at("info", F.lit(k)).try_cast("int")
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", get("Q").alias("quantity"), F.map_contains_key("info", "R").alias("has_r"), get("T").alias("tax"))


_FREQ = "CASE WHEN l_discount = 0 AND l_tax = 0 THEN 'novel' WHEN nullif(l_discount, 0) > 0.05 OR nullif(l_tax, 0) > 0.05 THEN 'frequent' ELSE 'rare' END"


def _freq(limit: float):
    return clinical.frequency_class([F.nullif(F.col("l_discount"), F.lit(0.0)), F.nullif(F.col("l_tax"), F.lit(0.0))], limit)


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_FREQ} AS class FROM lineitem")
def frequency_class(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _freq(0.05).alias("class"))


_VOTE = """CASE WHEN list_contains(c, '2') THEN CASE WHEN list_contains(c, '5') THEN 0 ELSE -1 END WHEN list_contains(c, '5') THEN 1
    WHEN list_contains(c, '3') THEN CASE WHEN list_contains(c, '4') THEN 0 ELSE -1 END WHEN list_contains(c, '4') THEN 1 ELSE 0 END"""


@query(f"SELECT l_orderkey, CAST({_VOTE} AS INTEGER) AS vote FROM (SELECT l_orderkey, list(DISTINCT CAST(l_linenumber AS VARCHAR)) AS c FROM lineitem GROUP BY 1)")
def vote_classify(t: Tables):
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_set(F.col("l_linenumber").cast("string")), "|").alias("c"))
    return g.select("l_orderkey", clinical.clinvar_vote(clinical.significance_codes(F.col("c"))).alias("vote"))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag = 'N' AND l_linenumber = 7 AS excluded, CAST(l_suppkey % 3 - 1 AS INTEGER) AS cv, l_linenumber AS hg,
      CASE WHEN l_discount = 0 THEN 'novel' WHEN l_discount > 0.08 THEN 'frequent' ELSE 'rare' END AS fc, CASE WHEN l_discount = 0 THEN 'novel' WHEN l_discount > 0.04 THEN 'frequent' ELSE 'rare' END AS fn,
      CASE p_type WHEN 'ECONOMY' THEN 'CodingExonic' WHEN 'SMALL' THEN 'NonCodingExonic' WHEN 'PROMO' THEN 'CodingIntronic' END AS region,
      CASE l_linestatus WHEN 'F' THEN 'e' ELSE 'w' END AS mark, p_size > 40 AS patho, p_size < 5 AS lcr FROM lineitem JOIN part ON p_partkey = l_partkey),
    y AS (SELECT *, cv = 1 OR hg > 5 AS clinical FROM x), z AS (SELECT *, CASE WHEN clinical THEN fc ELSE fn END AS kind FROM y)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, NOT excluded AND NOT (cv = -1 OR hg = 2) AND kind <> 'frequent' AND region IS NOT NULL AND NOT (lcr AND NOT clinical) AS kept,
      CASE WHEN excluded THEN '1' WHEN cv = -1 OR hg = 2 THEN '1c' WHEN kind = 'frequent' THEN CASE WHEN clinical THEN '2c' ELSE '2' END WHEN region IS NULL THEN '2' WHEN lcr AND NOT clinical THEN 'b'
        ELSE (CASE WHEN clinical THEN 'c' ELSE '' END) || (CASE WHEN kind = 'novel' THEN '4' ELSE '3' END) || mark || (CASE WHEN region LIKE 'NonCoding%' THEN 'n' ELSE '' END) || (CASE WHEN NOT clinical AND patho THEN 'g' ELSE '' END) END AS tag FROM z""")
def tag_decision_ladder(t: Tables):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    c = F.col
    f = lambda limit: F.when(c("l_discount") == 0, "novel").otherwise(clinical.frequency_class([c("l_discount")], limit))
    kept, tag = clinical.decide(
        excluded=F.expr("l_returnflag = 'N' AND l_linenumber = 7"),
        clinvar=(c("l_suppkey") % 3 - 1).cast("int"),
        hgmd=c("l_linenumber") - 3,  # 2 is benign, 6 and 7 are damaging
        at_clinical=f(0.08),
        at_normal=f(0.04),
        region=F.expr("CASE p_type WHEN 'ECONOMY' THEN 'CodingExonic' WHEN 'SMALL' THEN 'NonCodingExonic' WHEN 'PROMO' THEN 'CodingIntronic' END"),
        consequence=F.when(c("l_linestatus") == "F", "hpm").otherwise("warn"),
        pathogenic_gene=c("p_size") > 40,
        low_complexity=c("p_size") < 5,
        passes=F.lit(True),
    )
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", kept.alias("kept"), tag.alias("tag"))


_G = {"f": ("l_linenumber % 3", "l_suppkey % 3"), "m": ("l_partkey % 3", "l_orderkey % 3"), "c": ("l_partkey % 3", "(l_suppkey + l_linenumber) % 3")}


@query(f"""WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(f'CAST({a} AS VARCHAR) AS {k}1, CAST({b} AS VARCHAR) AS {k}2' for k, (a, b) in _G.items())} FROM lineitem),
    s AS (SELECT *, c1 IN (f1, f2) AND c2 IN (m1, m2) AS straight, c2 IN (f1, f2) AND c1 IN (m1, m2) AS crossed FROM g)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN straight AND (c1 = c2 OR NOT crossed) THEN c1 || '|' || c2 WHEN crossed AND NOT straight THEN c2 || '|' || c1 ELSE c1 || '/' || c2 END AS phased FROM s""")
def genotype_phase(t: Tables):
    g = {k: F.expr(f"concat(cast({a} as string), '/', cast({b} as string))") for k, (a, b) in _G.items()}
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", variant.phase(g["f"], g["m"], g["c"]).alias("phased"))


_ALLELES = f"substr({_BASES}, 1, 1 + p_partkey % 3) AS r, CASE WHEN p_size % 2 = 0 THEN substr({_BASES}, 1, 1 + p_size % 4) ELSE substr({_BASES}, 2, 1 + p_size % 3) END AS a"


@query(f"""WITH x AS (SELECT p_partkey AS pos, {_ALLELES} FROM part) SELECT pos,
    CASE WHEN len(r) > len(a) THEN pos + len(a) WHEN len(r) < len(a) THEN pos + len(r) - 1 ELSE pos END AS start_at,
    CASE WHEN len(r) > len(a) THEN pos + len(r) - 1 WHEN len(r) < len(a) THEN pos + len(r) ELSE pos + len(r) - 1 END AS end_at,
    CASE WHEN len(r) > len(a) THEN substr(r, len(a) + 1) WHEN len(r) < len(a) THEN '-' ELSE r END AS ref_min,
    CASE WHEN len(r) > len(a) THEN '-' WHEN len(r) < len(a) THEN substr(a, len(r) + 1) ELSE a END AS alt_min,
    CASE WHEN len(r) = 1 AND len(a) = 1 THEN 'mismatch' WHEN len(r) = len(a) THEN 'mnp' WHEN len(r) > len(a) THEN 'del' ELSE 'ins' END AS kind,
    CASE WHEN len(r) = len(a) THEN CASE WHEN len(r) = 1 THEN 'SNP' ELSE list_aggregate(list_filter([CASE WHEN substr(r, i, 1) <> substr(a, i, 1) THEN 'SNP' END FOR i IN range(1, len(r) + 1)], lambda x: x IS NOT NULL), 'string_agg', ',') END
      WHEN len(r) > len(a) THEN CASE WHEN substr(r, 1, len(a)) = a THEN 'DEL' ELSE 'COMPLEX_DEL' END ELSE CASE WHEN substr(a, 1, len(r)) = r THEN 'INS' ELSE 'COMPLEX_INS' END END AS parts,
    CAST(greatest(0, len(r) - len(a)) AS INTEGER) AS span FROM x""")
def variant_decompose(t: Tables):
    b = _bases()
    d = t.part.select(F.col("p_partkey").alias("pos"), F.substr(b, F.lit(1), (1 + F.col("p_partkey") % 3).cast("int")).alias("r"), F.when(F.col("p_size") % 2 == 0, F.substr(b, F.lit(1), 1 + F.col("p_size") % 4)).otherwise(F.substr(b, F.lit(2), 1 + F.col("p_size") % 3)).alias("a"))
    low = variant.minimal_alleles(F.col("pos"), F.col("r"), F.col("a"))
    parts = F.transform(variant.decompose(F.col("pos"), F.col("r"), F.col("a")), lambda p: p["type"])
    return d.select("pos", low["start"].alias("start_at"), low["end"].alias("end_at"), low["ref"].alias("ref_min"), low["alt"].alias("alt_min"), variant.variant_type(F.col("r"), F.array("a")).alias("kind"), F.when(F.size(parts) > 0, F.array_join(parts, ",")).alias("parts"), variant.deletion_span(F.col("r"), F.array("a")).alias("span"))


@query(f"SELECT p_partkey, reverse(translate({_BASES}, 'ACGT', 'TGCA')) AS rc FROM part")
def reverse_complement(t: Tables):
    return t.part.select("p_partkey", sequence.reverse_complement(_bases()).alias("rc"))


@query(f"""WITH x AS (SELECT p_partkey, {_BASES} AS s, p_partkey % len(p_name) AS i FROM part), y AS (SELECT *, substr(s, CAST(3 * (i // 3) + 1 AS BIGINT), 3) AS codon FROM x)
    SELECT p_partkey, coalesce(list_aggregate(list_transform(range(0, len(s) // 3), lambda j: {_case(sequence.CODONS, "substr(s, CAST(3 * j + 1 AS BIGINT), 3)")}), 'string_agg', ''), '') AS peptide, codon, CAST(i // 3 + 1 AS INTEGER) AS aa_pos,
      {_case(sequence.CODONS, "codon")} AS aa, CAST(i % 3 + 1 AS INTEGER) AS codon_offset FROM y""")
def codon_translate(t: Tables):
    at = sequence.codon_at(_bases(), F.col("p_partkey") % F.length("p_name"))
    return t.part.select("p_partkey", sequence.translate(_bases()).alias("peptide"), at["codon"].alias("codon"), at["aa_pos"].alias("aa_pos"), at["aa"].alias("aa"), at["offset"].alias("codon_offset"))


@query(f"""WITH s AS (SELECT p_partkey, {_BASES} || {_BASES} AS s FROM part), m AS (SELECT unnest(['AAG', 'GAA', 'CAC', 'TCA']) AS motif),
    h AS (SELECT p_partkey, motif, unnest(list_filter(range(0, len(s) - 2), lambda i: substr(s, CAST(i + 1 AS BIGINT), 3) = motif)) AS i FROM s, m)
    SELECT p_partkey, motif, CAST(count(*) AS BIGINT) AS n, CAST(min(i) AS INTEGER) AS first_at FROM h GROUP BY 1, 2""")
def motif_positions(t: Tables):
    b = F.concat(_bases(), _bases())
    d = t.part.select("p_partkey", b.alias("s"), F.explode(F.array(*map(F.lit, ["AAG", "GAA", "CAC", "TCA"]))).alias("motif"))
    hits = sequence.motif_positions(F.col("s"), F.col("motif"))
    return d.select("p_partkey", "motif", F.size(hits).cast("bigint").alias("n"), F.get(hits, F.lit(0)).alias("first_at")).where("n > 0")


_OL = "log10(l_discount)"
_OY = f"(0.0125 * {_OL} * {_OL} - 0.093 * {_OL} - 0.298)"


@query(f"SELECT DISTINCT l_discount, round(CASE WHEN l_discount <= 0 THEN 0.8 WHEN {_OY} < 0 THEN 0.1 WHEN {_OY} > 0.8 THEN 0.8 ELSE {_OY} END, 8) AS y FROM (SELECT greatest(l_discount, 0.0) AS l_discount FROM lineitem WHERE l_discount > 0) UNION SELECT 0.0, 0.8 FROM lineitem WHERE l_discount = 0")
def maf_offset(t: Tables):
    return t.lineitem.select("l_discount").distinct().select("l_discount", F.round(damage.frequency_offset(F.col("l_discount")), 8).alias("y"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') / count(*) AS p FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round((p + 1.15034938 * 1.15034938 / (2 * n) - 1.15034938 * sqrt((p * (1 - p) + 1.15034938 * 1.15034938 / (4 * n)) / n)) / (1 + 1.15034938 * 1.15034938 / n), 8) AS low FROM g""")
def wilson_lower(t: Tables):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return g.select("l_suppkey", F.round(damage.wilson_lower(F.col("k") / F.col("n"), F.col("n")), 8).alias("low"))


@query("""WITH x AS (SELECT DISTINCT l_discount * 5 AS p, l_tax * 10 AS g FROM lineitem)
    SELECT round(p, 6) AS p, round(g, 6) AS g, round(CASE WHEN p = 0 OR g = 0 THEN 0.0 ELSE 0.5 * p * 0.5 * g / (0.5 * p * 0.5 * g + (1 - 0.5 * p) * (1 - 0.5 * g)) END, 8) AS seed FROM x""")
def bayes_combine(t: Tables):
    d = t.lineitem.select((F.col("l_discount") * 5).alias("p"), (F.col("l_tax") * 10).alias("g")).distinct()
    return d.select(F.round("p", 6).alias("p"), F.round("g", 6).alias("g"), F.round(damage.bayes(F.col("p"), F.col("g")), 8).alias("seed"))


@query("""WITH x AS (SELECT p_partkey, p_size / 51.0 AS z FROM part), d AS (SELECT p_partkey, exp(1.0 * ln(z) + 4.0 * ln(1 - z) - (lgamma(2.0) + lgamma(5.0) - lgamma(7.0))) AS benign, exp(3.0 * ln(z) + 1.0 * ln(1 - z) - (lgamma(4.0) + lgamma(2.0) - lgamma(6.0))) AS patho FROM x)
    SELECT p_partkey, round(patho / (patho + benign), 6) AS ratio FROM d""")
def beta_ratio(t: Tables):
    z, f = F.col("p_size") / 51.0, lambda x: F.lit(float(x))
    of = lambda a, b: damage.beta_density(z, f(a), f(b), f(0), f(1), damage.log_beta(f(a), f(b)))
    return t.part.select("p_partkey", F.round(damage.beta_ratio(of(4, 2), of(2, 5)), 6).alias("ratio"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce(l_discount / nullif(l_tax, 0), 0.0), 6) AS af FROM lineitem")
def population_frequency(t: Tables):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(clinical.population_frequency(F.col("l_discount"), F.col("l_tax")), 6).alias("af"))


@query("SELECT o_orderkey, coalesce(o_orderpriority, '.') || '|' || coalesce(nullif(o_orderstatus, 'P'), '.') || '|' || CAST(o_custkey AS VARCHAR) AS packed FROM orders")
def packed_fields(t: Tables):
    return t.orders.select("o_orderkey", clinical.packed(F.col("o_orderpriority"), F.nullif(F.col("o_orderstatus"), F.lit("P")), F.col("o_custkey")).alias("packed"))
