"""Clinical classification, frequency classes and the retain decision, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of the most severe consequences.
SEVERITY = {"StopGain": 1, "StartLoss": 1, "StopLoss": 1, "FrameShiftInsert": 2, "FrameShiftDelete": 2, "NonSyn": 3, "NonSynStart": 3, "SynStop": 3, "NonFrameShiftInsert": 4, "NonFrameShiftDelete": 4, "Syn": 5, "StartGain": 5, "NoCDSChange": 6}
# Order of regions, among the transcripts of a gene and among the genes of a variant.
TRANSCRIPT_ORDER = ("boundary", "CodingExonic", "UTR5", "UTR3", "CodingIntronic", "NonCodingExonic", "NonCodingIntronic")
GENE_ORDER = ("CodingExonic", "boundary", "CodingIntronic", "UTR5", "UTR3", "NonCodingExonic", "NonCodingIntronic", "Intergenic")
# Scores of regions and of consequence classes in the retain decision, and the tag of each class.
REGION_SCORE = {"CodingExonic": 5, "CodingIntronic": 4, "NonCodingExonic": 3, "UTR5": 2, "UTR3": 2, "NonCodingIntronic": 1}
CLASS_SCORE = {"splc_coding;hpm": 5, "hpm": 4, "warn": 3, "splc_coding": 2, "splc_ext_intron": 1}
CLASS_TAG = {"splc_coding;hpm": "S", "hpm": "e", "warn": "w", "splc_coding": "s", "splc_ext_intron": "i"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def severity(mutation: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SEVERITY), mutation), F.lit(6))


def region_rank(region: Column, order: tuple[str, ...] = TRANSCRIPT_ORDER) -> Column:
    """Place of a region in `order`; any `A_B_boundary` counts as boundary."""
    named = F.when(region.contains("boundary"), "boundary").otherwise(region)
    return F.coalesce(F.try_element_at(literal_map({r: i for i, r in enumerate(order)}), named), F.lit(len(order)))


def significance_codes(text: Column) -> Column:
    """The whole codes of a significance text such as 5|2,255, not their digits."""
    return F.array_distinct(F.split(text, r"[|,/;]"))


def clinvar_vote(codes: Column) -> Column:
    """1 pathogenic, 0 uncertain, -1 benign: 2 benign, 3 likely benign, 4 likely pathogenic, 5 pathogenic; contradictions are uncertain."""
    has = lambda c: F.array_contains(codes, c)
    return F.when(has("2"), F.when(has("5"), 0).otherwise(-1)).when(has("5"), 1).when(has("3"), F.when(has("4"), 0).otherwise(-1)).when(has("4"), 1).otherwise(0)


# Classes of a mutation database, worst last.
HGMD_RANK = {"R": -1, "FP": 0, "DP": 1, "DFP": 2, "DM?": 3, "DM": 4}


def hgmd_vote(classes: Column) -> Column:
    """The highest rank among a record's classes, 0 for none that is known."""
    ranks = literal_map(HGMD_RANK)
    return F.coalesce(F.array_max(F.filter(F.transform(classes, lambda c: F.try_element_at(ranks, c)), lambda r: r.isNotNull())), F.lit(0))


def least_frequency(text: Column) -> Column:
    """The least of colon-joined frequencies, 1.0 at most; '.' and other text don't count."""
    values = F.transform(F.split(text, ":"), lambda x: x.try_cast("double"))
    least = F.array_min(F.filter(values, lambda v: v.isNotNull()))
    return F.when(least.isNotNull(), F.least(least, F.lit(1.0)))


def frequency_class(sources: list[Column], limit: float) -> Column:
    """frequent if any source's frequency of any allele is over the limit, novel if no source has one, else rare. Null sources don't count."""
    known = F.filter(F.array(*sources), lambda f: f.isNotNull())
    return F.when(F.size(known) == 0, "novel").when(F.exists(known, lambda f: f > limit), "frequent").otherwise("rare")


def population_frequency(count: Column, number: Column) -> Column:
    """Allele count over allele number, 0 where the number is 0 or either is missing."""
    return F.coalesce(F.try_divide(count, number), F.lit(0.0))


@dataclass(frozen=True)
class FilterConfig:
    """What a filter file asks for; see config.filter_config()."""

    filter_include: tuple[str, ...] = ()
    filter_exclude: tuple[str, ...] = ()
    flag_include: tuple[str, ...] = ()
    flag_exclude: tuple[str, ...] = ()
    frequency: float = 0.01
    clinical_frequency: float = 0.05
    splice_distance: int = 20
    regions: tuple[str, ...] = ()
    variant_types: tuple[str, ...] = ("snp", "indel")
    genes: tuple[str, ...] = ()
    sources: dict[str, bool] = field(default_factory=dict)


def overlaps(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(x) for x in wanted])) if wanted else F.lit(False)


def has_flag(info: Column, flags: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.map_contains_key(info, f)
    return out


def decide(*, excluded: Column, clinvar: Column, hgmd: Column, at_clinical: Column, at_normal: Column, region: Column, consequence: Column, pathogenic_gene: Column, low_complexity: Column, passes: Column) -> tuple[Column, Column]:
    """(retained, tag) of a variant.

    at_clinical and at_normal: frequency classes at the two limits. region: its best region, null if no region asks for it.
    consequence: a key of CLASS_SCORE. passes: the FILTER, gene, type and flag conditions that come last.
    """
    benign = (clinvar == -1) | (hgmd == -1)
    clinical = (clinvar == 1) | (hgmd > 2)
    kind = F.when(clinical, at_clinical).otherwise(at_normal)
    grade = F.when(kind == "novel", "4").otherwise("3")
    mark = F.coalesce(F.try_element_at(literal_map(CLASS_TAG), consequence), F.lit(""))
    coding = F.when(region.startswith("NonCoding"), "n").otherwise("")
    known = F.when(clinical, "c").when(pathogenic_gene, "g").otherwise("")
    full = F.concat(F.when(clinical, "c").otherwise(""), grade, mark, coding, F.when(~clinical, known).otherwise(""))
    tag = (
        F.when(excluded, "1")
        .when(benign, "1c")
        .when(kind == "frequent", F.when(clinical, "2c").otherwise("2"))
        .when(region.isNull(), "2")
        .when(low_complexity & ~clinical, "b")
        .otherwise(full)
    )
    kept = ~excluded & ~benign & (kind != "frequent") & region.isNotNull() & ~(low_complexity & ~clinical) & passes
    return kept, tag


# Consequences that count as damaging, and the regions of either kind.
DAMAGING = ("StopGain", "StopLoss", "StartLoss", "NonSyn", "FrameShiftInsert", "FrameShiftDelete", "NonFrameShiftInsert", "NonFrameShiftDelete")
EXONIC, BESIDE = ("CodingExonic", "NonCodingExonic"), ("CodingIntronic", "NonCodingIntronic", "UTR5", "UTR3")
CDS_WARNING = "CDS_NOT_MULTIPLE_OF_3"


def consequence_class(region: Column, motif: Column, consequence: Column, warning: Column, offset: Column, splice_distance: int, regions: tuple[str, ...] = ()) -> Column:
    """A key of CLASS_SCORE for one transcript, null if the variant doesn't count there.

    motif: ESE or ESS where an exonic variant lies in a splice-regulatory site. offset: distance from the coding exons of
    a variant in an intron or UTR. regions: only these count; all, if empty.
    """
    wanted = region.isin(*regions) if regions else F.lit(True)
    hit = F.coalesce(consequence.isin(*DAMAGING), F.lit(False))
    exonic = F.when(motif.isin("ESE", "ESS"), F.when(hit, "splc_coding;hpm").otherwise("splc_coding")).when(hit, "hpm").when(warning == CDS_WARNING, "warn")
    beside = F.when((F.lit(splice_distance) > 0) & (offset <= splice_distance), "splc_ext_intron")
    return F.when(wanted & region.isin(*EXONIC), exonic).when(wanted & region.isin(*BESIDE), beside)


def cdna_offset(cdna: Column) -> Column:
    """Least offset from the coding exons in a cDNA name such as c.12+5_12+8, c.-14 or c.*3; null without one."""
    found = F.transform(F.regexp_extract_all(cdna, F.lit(r"(?:\d[+-]|c\.[-*]|_[-*])(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_min(found)


def flags_pass(info: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Whether INFO has one of the flags asked for, if any are, and none of those ruled out."""
    return (has_flag(info, include) if include else F.lit(True)) & ~has_flag(info, exclude)


def any_source_low(sources: list[Column], limit: float) -> Column:
    """The older frequency test: some source has the variant at `limit` or less, or not at all."""
    out = F.lit(False)
    for s in sources:
        out = out | s.isNull() | (s <= limit)
    return out


def is_functional(consequence: Column) -> Column:
    """The simple test of a consequence, without regions."""
    return F.coalesce(consequence.isin(*DAMAGING), F.lit(False))


def is_exonic(region: Column) -> Column:
    return F.coalesce(region.isin(*EXONIC) | region.contains("Exonic"), F.lit(False))


def is_clinical(significance: Column, classes: Column) -> Column:
    """Whether a clinical source calls the variant pathogenic."""
    return (clinvar_vote(significance_codes(F.coalesce(significance, F.lit("")))) == 1) | (hgmd_vote(F.coalesce(classes, F.array().cast("array<string>"))) > 2)


def phenotype_name(text: Column) -> Column:
    """A phenotype's name fit for INFO fields: braces, brackets and question marks go, what separates fields becomes an underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[{}\[\]?]", "")), r"[\s,;|:=]+", "_")


def cdna_parts(text: Column) -> Column:
    """The cDNA changes of a text that joins them by ; or ,"""
    return F.filter(F.transform(F.split(text, r"[;,]"), lambda p: F.trim(p)), lambda p: p != "")


# Genes in both sex chromosomes.
PSEUDOAUTOSOMAL = (
    "ASMT", "ASMTL", "CD99", "CRLF2", "CSF2RA", "SFRS17A", "DHRSXY", "GTPBP6", "IL3RA", "P2RY8", "PLCXD1", "PPP2R3B",
    "SHOX", "SLC25A6", "XG", "ZBED1", "SPRY3", "SYBL1", "IL9R", "PCDH11X", "PCDH11Y", "TGIF2LX", "TGIF2LY",
)


def pseudoautosomal(gene: Column) -> Column:
    return F.coalesce(gene.isin(*PSEUDOAUTOSOMAL), F.lit(False))


def most_damaging(hits: Column) -> Column:
    """Of an array<struct<region, consequence>> the one with the largest region score, then class score; the last of equals."""
    regions, classes = literal_map(REGION_SCORE), literal_map(CLASS_SCORE)
    scored = F.transform(hits, lambda h, i: F.struct(F.coalesce(F.try_element_at(regions, h["region"]), F.lit(0)).alias("r"), F.coalesce(F.try_element_at(classes, h["consequence"]), F.lit(0)).alias("c"), i.alias("i"), h["region"].alias("region"), h["consequence"].alias("consequence")))
    return F.array_max(scored)


def splice_distances(site: Column) -> Column:
    """struct<donor, acceptor> from Exon{n}_SpliceDonor_{d}__Exon{m}_SpliceAcceptor_{a}."""
    pick = lambda name: F.regexp_extract(site, rf"{name}_(\d+)", 1).try_cast("int")
    return F.struct(pick("SpliceDonor").alias("donor"), pick("SpliceAcceptor").alias("acceptor"))


def packed(*fields: Column) -> Column:
    """Fields joined by '|', '.' for missing ones."""
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit(".")) for f in fields])


def hgvs(text: Column) -> Column:
    """struct<transcript, cdna, protein> of a name such as NM_1.2(GENE):c.5A>G (p.Lys2Arg)."""
    pick = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.struct(pick(r"(N[MR]_\d+(?:\.\d+)?)").alias("transcript"), pick(r":(c\.[^ ()]+)").alias("cdna"), pick(r"\(?(p\.[A-Za-z0-9=*_]+)").alias("protein"))


def near_splice_site(cdna: Column, within: int = 3) -> Column:
    """Whether a cDNA name has an intronic offset of less than `within`."""
    return F.coalesce(F.regexp_extract(cdna, r"\d([+-]\d+)", 1).try_cast("int").between(1 - within, within - 1), F.lit(False))


def rsids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(rs\d+)"), F.lit(1)))


def ensembl_id(text: Column) -> Column:
    """An Ensembl id without its species prefix."""
    return F.regexp_extract(text, r"\d+\.(\w+)", 1)
