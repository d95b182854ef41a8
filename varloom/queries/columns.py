"""Further column functions on proxy columns: genotypes, names, frames, clinical texts, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import clinical, damage, sequence, variant
from varloom.operators import annotations, intervals
from varloom.queries.base import Tables, query
from varloom.queries.scalars import _BASES, _bases, _case
from varloom.sources import tables, vcf

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEYS = _KEY.split(", ")


def _genotype(a: str, b: str) -> str:
    """A genotype of two alleles out of three, every ninth not called."""
    return f"CASE WHEN ({a}) % 9 = 0 THEN './.' ELSE concat(CAST(({a}) % 3 AS STRING), CASE WHEN ({b}) % 2 = 0 THEN '/' ELSE '|' END, CAST(({b}) % 3 AS STRING)) END"


_GT = {"f": ("l_partkey", "l_orderkey"), "m": ("l_suppkey", "l_partkey + 1"), "c": ("l_linenumber + l_partkey", "l_suppkey + l_orderkey")}
_GT_SQL = ", ".join(f"{_genotype(a, b).replace('STRING', 'VARCHAR')} AS {k}" for k, (a, b) in _GT.items())
_ALLELES = ", ".join(f"split_part(replace({k}, '|', '/'), '/', 1) AS {k}1, split_part(replace({k}, '|', '/'), '/', 2) AS {k}2, {k} LIKE '%.%' AS {k}n" for k in "fmc")
_TRIO = f"g AS (SELECT {_KEY}, {_GT_SQL}, CAST(l_quantity AS INTEGER) AS gq, l_returnflag = 'R' AS male FROM lineitem), x AS (SELECT *, {_ALLELES} FROM g)"


def _trio(t: Tables):
    return t.lineitem.select(*_KEYS, *[F.expr(_genotype(a, b)).alias(k) for k, (a, b) in _GT.items()], F.col("l_quantity").cast("int").alias("gq"), (F.col("l_returnflag") == "R").alias("male"))


@query(f"""WITH {_TRIO} SELECT {_KEY}, cn AS no_call, NOT cn AND c1 <> c2 AS het, NOT cn AND c1 = '0' AND c2 = '0' AS hom_ref, NOT cn AND c1 = c2 AND c1 <> '0' AS hom_alt, NOT cn AND c1 <> c2 AND gq >= 20 AS sure_het,
    NOT cn AND NOT fn AND (c1 IN (f1, f2) OR c2 IN (f1, f2)) AND gq >= 30 AS from_father FROM x""")
def genotype_predicates(t: Tables):
    c, f = F.col("c"), F.col("f")
    return _trio(t).select(*_KEYS, variant.is_no_call(c).alias("no_call"), variant.is_het(c).alias("het"), variant.is_hom_ref(c).alias("hom_ref"), variant.is_hom_alt(c).alias("hom_alt"), variant.confident(variant.is_het(c), F.col("gq"), 20).alias("sure_het"), variant.parent_check(c, f, F.col("gq"), 30).alias("from_father"))


_ONE = "CASE WHEN NOT {p}n AND NOT cn AND ((c1 IN ({p}1, {p}2) AND c2 NOT IN ({p}1, {p}2)) OR (c1 = c2 AND c1 IN ({p}1, {p}2))) THEN {a} WHEN NOT {p}n AND NOT cn AND c2 IN ({p}1, {p}2) AND c1 NOT IN ({p}1, {p}2) THEN {b} ELSE c END"
_BOTH = "CASE WHEN NOT fn AND NOT mn AND NOT cn AND s AND (c1 = c2 OR NOT k) THEN c1 || '|' || c2 WHEN NOT fn AND NOT mn AND NOT cn AND k AND NOT s THEN c2 || '|' || c1 ELSE c END"


@query(f"""WITH {_TRIO}, y AS (SELECT *, c1 IN (f1, f2) AND c2 IN (m1, m2) AS s, c2 IN (f1, f2) AND c1 IN (m1, m2) AS k FROM x)
    SELECT {_KEY}, {_ONE.format(p='f', a="c1 || '|' || c2", b="c2 || '|' || c1")} AS by_father, {_ONE.format(p='m', a="c2 || '|' || c1", b="c1 || '|' || c2")} AS by_mother,
      CASE WHEN male THEN CASE WHEN NOT cn AND NOT mn AND c1 = c2 AND c1 IN (m1, m2) THEN c1 ELSE c END ELSE {_BOTH} END AS on_x, CASE WHEN NOT cn AND NOT fn AND c1 = c2 AND c1 IN (f1, f2) THEN c1 ELSE c END AS on_y FROM y""")
def phase_one_parent_and_sex(t: Tables):
    f, m, c = F.col("f"), F.col("m"), F.col("c")
    return _trio(t).select(*_KEYS, variant.phase_one_parent(f, c, True).alias("by_father"), variant.phase_one_parent(m, c, False).alias("by_mother"), variant.phase_x(f, m, c, F.col("male")).alias("on_x"), variant.phase_y(f, c).alias("on_y"))


_NAME = "CASE p_partkey % 26 WHEN 0 THEN 'chrM' WHEN 23 THEN 'chrX' WHEN 24 THEN 'y' WHEN 25 THEN 'MT' ELSE 'chr' || CAST(p_partkey % 26 AS {s}) END"


@query(f"""WITH x AS (SELECT p_partkey, {_NAME.format(s='VARCHAR')} AS c FROM part), y AS (SELECT *, CASE WHEN c IN ('chrM', 'MT') THEN 'MT' ELSE upper(replace(c, 'chr', '')) END AS bare FROM x)
    SELECT p_partkey, bare, CASE WHEN bare = 'MT' THEN 'chrM' ELSE 'chr' || bare END AS ucsc, bare || '_' || CAST(p_partkey AS VARCHAR) || '_A_T' AS site FROM y""")
def chromosome_names(t: Tables):
    c = F.expr(_NAME.format(s="STRING"))
    bare = variant.chrom_bare(c)
    return t.part.select("p_partkey", bare.alias("bare"), variant.chrom_ucsc(c).alias("ucsc"), variant.site_key(bare, F.col("p_partkey"), F.lit("A"), F.lit("T")).alias("site"))


_MODELS = "CASE p_size % 5 WHEN 0 THEN 'AR_hom|AD' WHEN 1 THEN 'AR_comp' WHEN 2 THEN 'AD_dn' WHEN 3 THEN '' ELSE 'XR' END"


@query(f"SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'h' WHEN 2 THEN 'd' ELSE '' END AS tag, p_brand IN ('Brand#1', 'Brand#2') AS listed, p_brand = 'XG' AS par FROM part WHERE {_MODELS} IS NOT NULL")
def inheritance_tags(t: Tables):
    return t.part.select("p_partkey", variant.inheritance_tag(F.expr(_MODELS)).alias("tag"), F.col("p_brand").isin("Brand#1", "Brand#2").alias("listed"), clinical.pseudoautosomal(F.col("p_brand")).alias("par"))


_CLASSES = ("R", "FP", "DP", "DFP", "DM?", "DM", "new")


@query(f"""WITH c AS (SELECT l_orderkey, list_position({list(_CLASSES)}, {list(_CLASSES)}[CAST(l_linenumber % 7 + 1 AS INTEGER)]) AS k FROM lineitem)
    SELECT l_orderkey, CAST(coalesce(max(k - 2) FILTER (k <= 6), 0) AS INTEGER) AS vote FROM c GROUP BY 1""")
def hgmd_votes(t: Tables):
    name = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    d = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(name).alias("classes"))
    return d.select("l_orderkey", clinical.hgmd_vote(F.col("classes")).alias("vote"))


@query(f"""SELECT {_KEY}, CASE WHEN l_linenumber = 7 THEN NULL ELSE least(l_discount, l_tax * 20, 1.0) END AS least_maf, l_discount <= 0.04 OR l_linenumber = 7 OR l_tax <= 0.02 AS low FROM lineitem""")
def least_frequencies(t: Tables):
    text = F.when(F.col("l_linenumber") == 7, ".").otherwise(F.concat_ws(":", F.col("l_discount").cast("string"), F.lit("."), (F.col("l_tax") * 20).cast("string")))
    sources = [F.when(F.col("l_linenumber") != 7, F.col("l_discount")), F.col("l_tax")]
    return t.lineitem.select(*_KEYS, clinical.least_frequency(text).alias("least_maf"), (clinical.any_source_low(sources[:1], 0.04) | clinical.any_source_low(sources[1:], 0.02)).alias("low"))


@query("""SELECT o_orderkey, 'rs' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_custkey <> o_orderkey THEN ',rs' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS rsids, 'ENSP' || CAST(o_custkey AS VARCHAR) AS ensembl,
    CAST(extract(month FROM o_orderdate) AS INTEGER) AS month FROM orders""")
def text_extraction(t: Tables):
    c = F.col
    text = F.concat(F.lit("snp rs"), c("o_custkey"), F.lit(" (also RS7); rs"), c("o_orderkey"), F.lit("/rs"), c("o_custkey"))
    month = F.date_format("o_orderdate", "MMMM")
    return t.orders.select("o_orderkey", F.array_join(clinical.rsids(text), ",").alias("rsids"), clinical.ensembl_id(F.concat(F.lit("9606.ENSP"), c("o_custkey"))).alias("ensembl"), annotations.month_number(month).alias("month"))


@query("""SELECT p_partkey, 'NM_' || CAST(p_partkey AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) AS transcript, 'c.' || CAST(p_size AS VARCHAR) || '+' || CAST(p_partkey % 9 + 1 AS VARCHAR) || 'A>G' AS cdna,
    CASE WHEN p_size % 2 = 0 THEN 'p.Lys' || CAST(p_size AS VARCHAR) || 'Arg' END AS protein, p_partkey % 9 + 1 < 3 AS near_splice, CAST(p_partkey % 9 + 1 AS INTEGER) AS offset_, 'c.1A>G|c.' || CAST(p_size AS VARCHAR) || 'del' AS changes FROM part""")
def hgvs_names(t: Tables):
    c = F.col
    cdna = F.concat(F.lit("c."), c("p_size"), F.lit("+"), c("p_partkey") % 9 + 1, F.lit("A>G"))
    name = F.concat(F.lit("NM_"), c("p_partkey"), F.lit("."), c("p_size"), F.lit("(GENE):"), cdna, F.when(c("p_size") % 2 == 0, F.concat(F.lit(" (p.Lys"), c("p_size"), F.lit("Arg)"))).otherwise(""))
    h = clinical.hgvs(name)
    changes = clinical.cdna_parts(F.concat(F.lit("c.1A>G; c."), c("p_size"), F.lit("del,")))
    return t.part.select("p_partkey", h["transcript"].alias("transcript"), h["cdna"].alias("cdna"), h["protein"].alias("protein"), clinical.near_splice_site(cdna).alias("near_splice"), clinical.cdna_offset(cdna).alias("offset_"), F.array_join(changes, "|").alias("changes"))


_AA = {v: k for k, v in sequence.AMINO3.items()}
_USAGE = {c: round(0.1 + (i * 37 % 64) / 64, 6) for i, c in enumerate(sorted(sequence.CODONS))}
_USED = "CASE {c} " + " ".join(f"WHEN '{c}' THEN {u}" for c, u in _USAGE.items()) + " END"


@query(f"""WITH x AS (SELECT p_partkey, p_size, {_BASES} AS s FROM part), y AS (SELECT *, substr(s, 1, 3) AS w, substr(s, 2, 3) AS m, CAST(p_size % 5 AS BIGINT) AS i FROM x),
    z AS (SELECT *, {_case(sequence.CODONS, 'w')} AS a, {_USED.format(c='w')} AS uw, {_USED.format(c='m')} AS um FROM y)
    SELECT p_partkey, CASE a {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in sequence.AMINO3.items())} END AS three, a AS one, CASE WHEN um > uw THEN 'up' WHEN um < uw THEN 'down' ELSE 'same' END AS usage,
      substr(s, 1, i) || 'TT' || substr(s, i + 2) AS mutated, reverse(translate('R' || s || 'n', 'ACGTRn', 'TGCAYn')) AS rc FROM z""")
def codon_helpers(t: Tables):
    s = _bases()
    w, m = F.substr(s, F.lit(1), F.lit(3)), F.substr(s, F.lit(2), F.lit(3))
    three = sequence.to_three(sequence.amino_acid(w))
    i = (F.col("p_size") % 5).cast("int")
    return t.part.select("p_partkey", three.alias("three"), sequence.to_one(F.upper(three)).alias("one"), sequence.codon_usage(w, m, _USAGE).alias("usage"), sequence.mutate(s, i, F.lit(1), F.lit("TT")).alias("mutated"), sequence.reverse_complement(F.concat(F.lit("R"), s, F.lit("n"))).alias("rc"))


@query("""WITH x AS (SELECT p_partkey, p_size % 4 AS a, p_size % 3 AS b FROM part)
    SELECT p_partkey, CASE WHEN a < 3 THEN CAST(a AS INTEGER) END AS first_coding, CAST(3 - a AS INTEGER) AS n_coding, array_to_string(list_slice([CAST(i AS VARCHAR) FOR i IN range(0, b + 1)] || ['.', '.', '.'], 1, 2), ',') AS padded FROM x""")
def coding_exon_frames(t: Tables):
    a, b = F.col("p_size") % 4, F.col("p_size") % 3
    frames = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < a, -1).otherwise(i))
    listed = F.transform(F.sequence(F.lit(0), b), lambda i: i.cast("string"))
    return t.part.select("p_partkey", sequence.first_coding_exon(frames).cast("int").alias("first_coding"), sequence.coding_exons(frames).alias("n_coding"), F.array_join(sequence.pad_or_clip(listed, 2), ",").alias("padded"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN 'chr' || CAST(p_size AS VARCHAR) END AS chrom, CASE WHEN p_size % 7 > 0 THEN CAST(1000 + p_size AS INTEGER) END AS start_at, CASE WHEN p_size % 7 > 0 THEN CAST(p_partkey + 2000 AS INTEGER) END AS end_at,
    CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS INTEGER) END AS red, CASE WHEN p_size <= 30 THEN 'HP_' || replace(p_name, ' ', '_') ELSE 'x_' || replace(p_name, ' ', '_') END AS phenotype FROM part""")
def field_parsing(t: Tables):
    c = F.col
    text = F.when(c("p_size") % 7 == 0, "nowhere").otherwise(F.concat(F.lit("chr"), c("p_size"), F.lit(":1,0"), F.lpad(c("p_size").cast("string"), 2, "0"), F.lit("-"), c("p_partkey") + 2000))
    r, colour = tables.region(text), tables.rgb(F.concat(c("p_size"), F.when(c("p_size") % 2 == 0, ",0,255").otherwise(",256,0")))
    name = F.concat(F.when(c("p_size") <= 30, "{HP}, ").otherwise("?x;  "), c("p_name"))
    return t.part.select("p_partkey", r["chrom"].alias("chrom"), r["start"].alias("start_at"), r["end"].alias("end_at"), colour["r"].alias("red"), clinical.phenotype_name(name).alias("phenotype"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey AS s1, l_partkey + l_linenumber AS e1, l_suppkey * 10 AS s2, l_suppkey * 10 + 50 AS e2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s1 <= e2 AND s2 <= e1 THEN greatest(s1, s2) END AS from_, CASE WHEN s1 <= e2 AND s2 <= e1 THEN least(e1, e2) END AS to_, s2 <= s1 AND e1 <= e2 AS held FROM x""")
def interval_algebra(t: Tables):
    c = F.col
    s1, e1, s2, e2 = c("l_partkey"), c("l_partkey") + c("l_linenumber"), c("l_suppkey") * 10, c("l_suppkey") * 10 + 50
    both = intervals.intersect(s1, e1, s2, e2)
    return t.lineitem.select(*_KEYS, both["start"].alias("from_"), both["end"].alias("to_"), intervals.contains(s2, e2, s1, e1).alias("held"))


@query(f"""SELECT {_KEY}, l_returnflag IN ('A', 'R') OR l_linestatus = 'F' AS filtered, NOT (l_linenumber = 3) AND l_quantity > 25 AS flagged, l_linenumber <= 4 AS functional, l_shipdate IS NOT NULL AND l_suppkey % 2 = 0 AS exonic, l_quantity >= 10 AND l_linenumber <> 5 AS sampled FROM lineitem""")
def record_filters(t: Tables):
    c = F.col
    info = F.map_from_entries(F.filter(F.array(F.struct(F.when(c("l_quantity") > 25, "KEEP").otherwise("NONE").alias("k"), F.lit(None).cast("string").alias("v")), F.struct(F.when(c("l_linenumber") == 3, "DROP").otherwise("OTHER").alias("k"), F.lit("1").alias("v"))), lambda e: e["k"].isNotNull()))
    names = F.element_at(F.array(*map(F.lit, ["StopGain", "NonSyn", "FrameShiftInsert", "StartLoss", "Syn", "NoCDSChange", "StartGain"])), c("l_linenumber"))
    d = t.lineitem.withColumn("gt", F.when(c("l_linenumber") == 5, "./.").otherwise("0/1")).withColumn("dp", c("l_quantity").cast("int"))
    kept = annotations.sample_filter(d, c("dp"), 10, c("gt")).select(*_KEYS, "l_quantity", "l_extendedprice", "l_shipdate", F.lit(True).alias("sampled"))
    d = d.join(kept, [*_KEYS, "l_quantity", "l_extendedprice", "l_shipdate"], "left").fillna({"sampled": False})
    return d.select(*_KEYS, clinical.overlaps(F.array("l_returnflag", "l_linestatus"), ("A", "R", "F")).alias("filtered"), clinical.flags_pass(info, ("KEEP", "PASS"), ("DROP",)).alias("flagged"), clinical.is_functional(names).alias("functional"),
                    clinical.is_exonic(F.when(c("l_suppkey") % 2 == 0, "CodingExonic").otherwise("UTR5")).alias("exonic"), "sampled")


_REGIONS = ["CodingExonic", "NonCodingExonic", "CodingIntronic", "UTR5", "UTR3", "NonCodingIntronic", "Intergenic"]
_CONS = ["StopGain", "NonSyn", "NonFrameShiftDelete", "Syn", "NoCDSChange"]


@query(f"""WITH x AS (SELECT {_KEY}, {_REGIONS}[l_linenumber] AS region, CASE l_partkey % 5 WHEN 0 THEN 'ESE' WHEN 1 THEN 'ESS' END AS motif, {_CONS}[CAST(l_suppkey % 5 + 1 AS INTEGER)] AS cons, CASE WHEN l_returnflag = 'R' THEN 'CDS_NOT_MULTIPLE_OF_3' END AS warning, l_quantity AS off FROM lineitem),
    y AS (SELECT *, cons IN ('StopGain', 'NonSyn', 'NonFrameShiftDelete') AS hit FROM x)
    SELECT {_KEY}, CASE WHEN region IN ('CodingExonic', 'NonCodingExonic') THEN CASE WHEN motif IS NOT NULL THEN CASE WHEN hit THEN 'splc_coding;hpm' ELSE 'splc_coding' END WHEN hit THEN 'hpm' WHEN warning IS NOT NULL THEN 'warn' END
      WHEN region <> 'Intergenic' AND off <= 20 THEN 'splc_ext_intron' END AS class FROM y""")
def consequence_classes(t: Tables):
    c = F.col
    region = F.element_at(F.array(*map(F.lit, _REGIONS)), c("l_linenumber"))
    cons = F.element_at(F.array(*map(F.lit, _CONS)), (c("l_suppkey") % 5 + 1).cast("int"))
    motif = F.when(c("l_partkey") % 5 == 0, "ESE").when(c("l_partkey") % 5 == 1, "ESS")
    return t.lineitem.select(*_KEYS, clinical.consequence_class(region, motif, cons, F.when(c("l_returnflag") == "R", clinical.CDS_WARNING), c("l_quantity"), 20).alias("class"))


@query(f"""WITH x AS (SELECT l_orderkey, {_REGIONS}[l_linenumber] AS region, ['hpm', 'warn', 'splc_coding', 'splc_coding;hpm', 'splc_ext_intron'][CAST(l_suppkey % 5 + 1 AS INTEGER)] AS cons, l_partkey, l_linenumber, l_suppkey FROM lineitem),
    s AS (SELECT *, CASE region WHEN 'CodingExonic' THEN 5 WHEN 'CodingIntronic' THEN 4 WHEN 'NonCodingExonic' THEN 3 WHEN 'UTR5' THEN 2 WHEN 'UTR3' THEN 2 WHEN 'NonCodingIntronic' THEN 1 ELSE 0 END AS r,
      CASE cons WHEN 'splc_coding;hpm' THEN 5 WHEN 'hpm' THEN 4 WHEN 'warn' THEN 3 WHEN 'splc_coding' THEN 2 ELSE 1 END AS k FROM x)
    SELECT l_orderkey, region, cons FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r DESC, k DESC, region DESC) AS n FROM s) WHERE n = 1""")
def most_damaging_hit(t: Tables):
    c = F.col
    region = F.element_at(F.array(*map(F.lit, _REGIONS)), c("l_linenumber"))
    cons = F.element_at(F.array(*map(F.lit, ["hpm", "warn", "splc_coding", "splc_coding;hpm", "splc_ext_intron"])), (c("l_suppkey") % 5 + 1).cast("int"))
    hits = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(region.alias("region"), cons.alias("consequence")))).alias("hits"))
    best = clinical.most_damaging(F.col("hits"))
    return hits.select("l_orderkey", best["region"].alias("region"), best["consequence"].alias("cons"))


@query("SELECT p_partkey, p_brand AS gene, CAST(p_size AS VARCHAR) AS exon, CASE WHEN p_size % 3 > 0 THEN p_type ELSE '' END AS kind FROM part")
def unpacked_transcripts(t: Tables):
    d = annotations.pack_transcripts(t.part.withColumn("kind", F.when(F.col("p_size") % 3 > 0, F.col("p_type"))), ["p_partkey"], "p_brand", ["p_size", "kind"])
    one = F.get(annotations.unpack_transcripts(F.col("transcripts"), ["exon", "kind"]), F.lit(0))
    tx = F.get(one["transcripts"], F.lit(0))
    return d.select("p_partkey", one["gene"].alias("gene"), F.try_element_at(tx, F.lit("exon")).alias("exon"), F.try_element_at(tx, F.lit("kind")).alias("kind"))


@query("""WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN 'A=' || p_brand ELSE 'FLAG' END AS e, p_type FROM part) SELECT p_partkey, array_to_string(list_sort([e, 'B=' || p_type, 'NEW=' || CAST(p_size AS VARCHAR)]), ';') AS info, p_size % 2 = 1 AS number_ok FROM x""")
def info_edits(t: Tables):
    c = F.col
    info = vcf.parse_info(F.concat(F.lit("B=old;"), F.when(c("p_size") % 2 == 0, F.concat(F.lit("A="), c("p_brand"))).otherwise("FLAG"), F.lit(";GONE=1;B="), c("p_type")))
    made = vcf.delete_info(vcf.add_info(info, "NEW", c("p_size")), ["GONE"])
    text = F.array_join(F.array_sort(F.transform(F.map_entries(made), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"])))), ";")
    return t.part.select("p_partkey", text.alias("info"), vcf.number_matches(F.when(c("p_size") % 2 == 1, "1,2").otherwise("1"), "A", F.lit(2)).alias("number_ok"))


@query("""WITH w AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'mismatch' WHEN 1 THEN 'del' ELSE 'mnp' END AS v, (CASE WHEN p_size % 2 = 0 THEN '3' ELSE '4' END) || (CASE p_size % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'h' WHEN 2 THEN 'c' ELSE '' END) AS tag,
      CASE p_partkey % 4 WHEN 0 THEN 'dominant' WHEN 1 THEN 'unknown' WHEN 2 THEN 'recessive' END AS inh FROM part),
    k AS (SELECT *, CASE WHEN tag LIKE '%c%' THEN 'novel_snp' WHEN v = 'mismatch' THEN CASE WHEN tag LIKE '4%' THEN 'novel_snp' ELSE 'rare' END WHEN tag LIKE '4%' THEN 'novel_indel_low' ELSE 'rare_indel_low' END AS kind,
      CASE WHEN tag LIKE '%H%' THEN 2 WHEN tag LIKE '%c%' THEN 0 WHEN inh = 'dominant' THEN 2 WHEN tag LIKE '%h%' OR inh = 'unknown' THEN 1 ELSE 0 END AS z FROM w)
    SELECT p_partkey, kind, round(CAST((CASE kind WHEN 'rare' THEN [0.1, 0.2, 0.75] WHEN 'novel_snp' THEN [0.4, 0.5, 0.85] WHEN 'novel_indel_low' THEN [0.1, 0.15, 0.25] ELSE [0.2, 0.25, 0.3] END)[z + 1] AS DOUBLE) * CASE WHEN v = 'mnp' THEN 0.5 ELSE 1 END, 6) AS weight FROM k""")
def allele_weights(t: Tables):
    c = F.col
    v = F.element_at(F.array(*map(F.lit, ["mismatch", "del", "mnp"])), (c("p_size") % 3 + 1).cast("int"))
    tag = F.concat(F.when(c("p_size") % 2 == 0, "3").otherwise("4"), F.element_at(F.array(*map(F.lit, ["H", "h", "c", "", ""])), (c("p_size") % 5 + 1).cast("int")))
    inherit = F.when(c("p_partkey") % 4 == 0, "dominant").when(c("p_partkey") % 4 == 1, "unknown").when(c("p_partkey") % 4 == 2, "recessive")
    kind = damage.weight_class(tag, v)
    return t.part.select("p_partkey", kind.alias("kind"), F.round(damage.allele_weight(kind, damage.weight_zygosity(tag, inherit), v.isin("complex", "mnp")), 6).alias("weight"))
