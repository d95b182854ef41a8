"""Annotation joins: predictions, signals, clinical records and phenotype catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators import intervals


def effect_predictions(variants: DataFrame, predictions: DataFrame, site: list[str], residue: list[str], score: str, values: list[str]) -> DataFrame:
    """Predictions by site, and where there is none those of the same residue change with the best score."""
    by_site = predictions.groupBy(*site).agg(F.max_by(F.struct(*values), score).alias("_site"))
    by_residue = predictions.groupBy(*residue).agg(F.max_by(F.struct(*values), score).alias("_residue"))
    d = variants.join(by_site, site, "left").join(by_residue, residue, "left")
    return d.withColumns({v: F.coalesce(F.col(f"_site.{v}"), F.col(f"_residue.{v}")) for v in values}).drop("_site", "_residue")


def per_base_scores(variants: DataFrame, scores: DataFrame, row: str, chrom: str, start: str, alleles: str, score: str) -> DataFrame:
    """variants with `score`: an array of each base's score in order, null where a base has none. alleles: array<struct<ref, alt>>, one for each base."""
    s = scores.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("ref").alias("_r"), F.col("alt").alias("_a"), F.col(score).alias("_s"))
    s = s.groupBy("_c", "_p", "_r", "_a").agg(F.max("_s").alias("_s"))
    e = variants.select(row, F.col(chrom).alias("_ec"), F.col(start).alias("_es"), F.posexplode(alleles).alias("_i", "_b"))
    hit = e.join(s, (F.col("_ec") == F.col("_c")) & (F.col("_es") + F.col("_i") == F.col("_p")) & (F.col("_b.ref") == F.col("_r")) & (F.col("_b.alt") == F.col("_a")), "left")
    ordered = hit.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias(score))
    return variants.join(ordered, row, "left")


def transcript_signals(variants: DataFrame, signals: DataFrame, chrom: str, pos: str, transcript: str) -> DataFrame:
    """variants with signals (schrom, start, end, accession, site) of the same transcript that cover them."""
    hit = intervals.point_join(variants, signals, chrom, pos, "schrom", "start", "end")
    return hit.where(F.col(transcript) == F.col("accession"))


def binding_sites(variants: DataFrame, mirnas: DataFrame, transcript: str, pos: str) -> DataFrame:
    """variants inside of a binding site: mirnas (mirna, refseq_acc, align, coords array<int>) pair an upper-case base of the alignment with a position."""
    bases = F.arrays_zip(F.split("align", "").alias("base"), F.col("coords").alias("at"))
    bound = F.transform(F.filter(bases, lambda b: b["base"].rlike("^[ACGTU]$") & b["at"].isNotNull()), lambda b: b["at"])
    at = mirnas.select("mirna", F.col("refseq_acc").alias("_t"), F.explode(bound).alias("_at")).distinct()
    return variants.join(at, (F.col(transcript) == F.col("_t")) & (F.col(pos) == F.col("_at"))).drop("_t", "_at")


def domain_density(variants: DataFrame, domains: DataFrame, density: DataFrame, row: str, chrom: str, start: str, end: str) -> DataFrame:
    """Per variant and gene the summed counts of the domains that it overlaps, where any is over 0.

    domains: (idx, dchrom, dstart, dend, gene, description); density: (idx, benign, vus, pathogenic).
    """
    hit = intervals.overlap_join(variants, domains, chrom, start, end, "dchrom", "dstart", "dend").join(density, "idx")
    sums = hit.groupBy(row, "gene").agg(*[F.sum(c).alias(c) for c in ("benign", "vus", "pathogenic")], F.array_sort(F.collect_set("description")).alias("domains"))
    total = F.col("benign") + F.col("vus") + F.col("pathogenic")
    return sums.withColumn("denominator", total).where("denominator > 0")


def clinical_records(records: DataFrame, summary: DataFrame, submissions: DataFrame) -> DataFrame:
    """records (row, accessions array) with the first accession that the summary knows and its submissions.

    summary: (accession, variation_id, review); submissions: (variation_id, submitter).
    """
    a = records.select("row", F.posexplode("accessions").alias("_i", "accession"))
    s = summary.groupBy("accession").agg(F.min(F.struct("variation_id", "review")).alias("_s"))
    first = a.join(s, "accession").groupBy("row").agg(F.min_by(F.struct("accession", F.col("_s.variation_id").alias("variation_id"), F.col("_s.review").alias("review")), "_i").alias("_f"))
    subs = submissions.groupBy("variation_id").agg(F.array_join(F.array_sort(F.collect_set("submitter")), "|").alias("submitters"))
    d = first.select("row", "_f.*").join(subs, "variation_id", "left")
    return records.join(d, "row", "left")


def by_key(d: DataFrame, table: DataFrame, key: str, value: str, sep: str = "__") -> DataFrame:
    """d with a table's distinct values of its key, sorted and joined: aggregated first, so that the join adds no rows."""
    per = table.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(value))
    return d.join(per, key, "left")


def disease_genes(diseases: DataFrame, mapping: DataFrame, associations: DataFrame, least: float = 0.1) -> DataFrame:
    """(disease_id, gene, score) through a mapping (disease_id, concept) to associations (concept, gene, score).

    Of a concept's associations with a gene the best counts and is all that the join sees, however many there are.
    """
    best = associations.where(F.col("score") >= least).groupBy("concept", "gene").agg(F.max("score").alias("score"))
    d = diseases.select("disease_id").distinct().join(mapping.select("disease_id", "concept").distinct(), "disease_id").join(best, "concept")
    return d.groupBy("disease_id", "gene").agg(F.max("score").alias("score"))


def first_rows(d: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def pack_transcripts(d: DataFrame, key: list[str], gene: str, fields: list[str]) -> DataFrame:
    """(key, transcripts): gene(field:field:...) of each transcript, '|' between transcripts and ';' between genes; missing fields are empty."""
    one = F.concat_ws(":", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    per = d.groupBy(*key, gene).agg(F.array_join(F.array_sort(F.collect_set(one)), "|").alias("_t"))
    each = F.concat(F.col(gene), F.lit("("), F.col("_t"), F.lit(")"))
    return per.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(each)), ";").alias("transcripts"))


def unpack_transcripts(text: Column, fields: list[str]) -> Column:
    """array<struct<gene, transcripts array<map>>> of pack_transcripts()'s text; only the outermost parentheses count."""
    gene = lambda g: F.substring_index(g, "(", 1)
    body = lambda g: F.regexp_replace(F.regexp_replace(g, r"^[^(]*\(", ""), r"\)$", "")
    named = lambda t: F.map_from_arrays(F.array(*map(F.lit, fields)), F.slice(F.concat(F.split(t, ":"), F.array_repeat(F.lit(""), len(fields))), 1, len(fields)))
    return F.transform(F.split(text, ";"), lambda g: F.struct(gene(g).alias("gene"), F.transform(F.split(body(g), r"\|"), named).alias("transcripts")))


def sample_filter(d: DataFrame, depth: Column, least: int, genotype: Column) -> DataFrame:
    """Rows whose sample is called and has enough depth."""
    return d.where(F.coalesce(depth >= least, F.lit(False)) & genotype.isNotNull() & ~genotype.contains("."))


def novel(ids: Column) -> Column:
    return F.coalesce(F.size(ids) == 0, F.lit(True))


def month_number(text: Column) -> Column:
    """1 to 12 from a month's English name or its first three letters."""
    names = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(F.substr(text, F.lit(1), F.lit(3)))), F.lit(0)).cast("int")


def feature_table(lines: DataFrame) -> DataFrame:
    """(record, type, start, end, qualifiers) of FT lines: a key line opens a feature, /name="value" lines belong to it."""
    d = lines.select("record", F.posexplode("lines").alias("n", "line")).where(F.col("line").startswith("FT"))
    head = F.regexp_extract("line", r"^FT\s{3}(\S+)\s+", 1)
    up = Window.partitionBy("record").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("feature", F.sum((head != "").cast("int")).over(up)).where("feature > 0")
    span = F.regexp_extract("line", r"(\d+)\.\.>?(\d+)", 1), F.regexp_extract("line", r"(\d+)\.\.>?(\d+)", 2)
    pair = F.struct(F.regexp_extract("line", r'/(\w+)="?', 1).alias("k"), F.regexp_extract("line", r'/\w+="?([^"]*)"?', 1).alias("v"))
    out = d.groupBy("record", "feature").agg(F.max(head).alias("type"), F.max(span[0]).try_cast("int").alias("start"), F.max(span[1]).try_cast("int").alias("end"), F.array_sort(F.collect_set(F.when(F.col("line").contains("/"), pair))).alias("qualifiers"))
    return out


def clinvar_summary(d: DataFrame, names: str) -> DataFrame:
    """d with transcript, cdna, protein and near_splice from a names column."""
    from varloom.functions import clinical

    h = clinical.hgvs(F.col(names))
    return d.withColumns({"transcript": h["transcript"], "cdna": h["cdna"], "protein": h["protein"], "near_splice": clinical.near_splice_site(h["cdna"])})


def concept_mapping(records: DataFrame) -> DataFrame:
    """(disease_id, concept) of a turtle file's records (lines): a subject line, and lines that name its exact matches."""
    subject = F.regexp_extract(F.get("lines", F.lit(0)), r"^<[^>]*/(\w+)>", 1)
    concepts = F.regexp_extract_all(F.array_join("lines", "\n"), F.lit(r"exactMatch\s+<[^>]*/(C\d+)>"), F.lit(1))
    return records.select(subject.alias("disease_id"), F.explode(concepts).alias("concept")).distinct()


def proband_ped(spark, sample: str, male: bool | None = None) -> DataFrame:
    """A pedigree of one affected member."""
    return spark.createDataFrame([(sample, sample, "0", "0", 0 if male is None else 1 if male else 2, 2)], "fam_id string, ind_id string, pat_id string, mat_id string, sex int, phenotype int")


def proband_peds(samples: DataFrame) -> DataFrame:
    """A pedigree of one affected member for each row of samples (sample, male: null if unknown)."""
    sex = F.when(F.col("male").isNull(), 0).when(F.col("male"), 1).otherwise(2)
    return samples.select(F.col("sample").alias("fam_id"), F.col("sample").alias("ind_id"), F.lit("0").alias("pat_id"), F.lit("0").alias("mat_id"), sex.alias("sex"), F.lit(2).alias("phenotype"))


def mim_phenotypes(genes: DataFrame, names: DataFrame) -> DataFrame:
    """(accession, gene, mim_id, phenotype) of genes (accession, gene, mim_id) by an offline table of names (mim_id, phenotype)."""
    from varloom.functions.clinical import phenotype_name

    own = names.groupBy("mim_id").agg(F.min("phenotype").alias("phenotype"))
    return genes.join(own, "mim_id", "left").select("accession", "gene", "mim_id", phenotype_name(F.col("phenotype")).alias("phenotype"))


def genes_of(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uniprot, gene) of the accessions that are asked for."""
    return pairs.join(queries.select("uniprot").distinct(), "uniprot", "left_semi")


def prefilter(variants: DataFrame, frequencies: DataFrame, keys: list[str], frequency: str, largest: float = 0.05) -> DataFrame:
    """variants without those that a population has more often than `largest`; the largest frequency of a site counts."""
    own = frequencies.groupBy(*keys).agg(F.max(frequency).alias("_f")).where(F.col("_f") > largest)
    return variants.join(own, keys, "left_anti")


def counts_between(regions: DataFrame, sites: DataFrame, vote: str) -> DataFrame:
    """regions (region, chrom, start, end) with how many sites (schrom, pos, vote) of each vote lie in them."""
    t = regions.select("region", F.col("chrom").alias("_rc"), F.col("start").alias("_rs"), F.col("end").alias("_re"))
    hit = intervals.point_join(sites, t, "schrom", "pos", "_rc", "_rs", "_re")
    n = hit.groupBy("region").agg(*[F.count_if(F.col(vote) == v).alias(name) for name, v in (("benign", -1), ("vus", 0), ("pathogenic", 1))])
    return regions.join(n, "region", "left").fillna(0, ["benign", "vus", "pathogenic"])
