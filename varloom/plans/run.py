"""The whole run from files: a VCF, a patient's terms and a folder of reference tables in, an annotated VCF and ranked tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.config import filter_config
from varloom.functions import variant
from varloom.functions.clinical import FilterConfig
from varloom.operators import phenotype
from varloom.plans import prioritize
from varloom.sources import sinks, tables, vcf
from varloom.storage import listed, materialize

#: INFO fields that the annotated VCF bears, by column: id, Number, Type, Description.
FIELDS = {
    "gene": ("GENE", "1", "String", "Gene of the worst transcript"),
    "accession": ("TRANSCRIPT", "1", "String", "Worst transcript"),
    "region": ("REGION", "1", "String", "Region of the transcript"),
    "consequence": ("CONSEQUENCE", "1", "String", "Consequence in the transcript"),
    "class_tag": ("CLASS_TAG", "1", "String", "Why the variant was retained"),
    "exac": ("EXAC_AF", "1", "Float", "Allele frequency, ExAC"),
    "esp": ("ESP_AF", "1", "Float", "Allele frequency, ESP"),
    "kg": ("KG_AF", "1", "Float", "Allele frequency, 1000 genomes"),
    "clnsig": ("CLNSIG", "1", "String", "Clinical significance"),
    "cadd_raw": ("CADD_RAW", "1", "Float", "CADD score, the sum of several bases"),
    "gerp": ("GERP", "1", "Float", "Conservation score"),
    "capture": ("CAPTURE", "1", "String", "Place near a capture target"),
}
_TABLES = ("transcripts", "frequencies", "clinvar", "hgmd", "low_complexity", "capture", "conserved", "cadd", "pathogenic_genes", "splice_motifs", "domains", "density", "fits", "predictions", "rsids", "associations")


def resources(spark: SparkSession, folder: str) -> tuple[prioritize.Resources, dict[str, DataFrame]]:
    """Reference tables of a folder by their names, those that it has; and its other tables."""
    found = {name.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{name}") for name in listed(spark, folder)}
    return prioritize.Resources(**{n: found[n] for n in _TABLES if n in found}), {n: d for n, d in found.items() if n not in _TABLES}


def _of_allele(genotype: Column, number: Column) -> Column:
    """A genotype of several alleles as one of a single allele: 1 for it, 0 for the others."""
    each = F.transform(F.split(genotype, "[/|]"), lambda a: F.when(a == number.cast("string"), "1").when(a == ".", ".").otherwise("0"))
    return F.when(genotype.contains("|"), F.array_join(each, "|")).otherwise(F.array_join(each, "/"))


def _annotated_vcf(records: DataFrame, out: dict[str, DataFrame], header: vcf.Header, path: str) -> None:
    """Retained variants with FIELDS in INFO: one record each, of several genes the first by name."""
    tags = out["retained"].groupBy("chrom", "pos", "ref", "alt").agg(F.min(F.struct(F.coalesce("gene", F.lit("~")).alias("_g"), *FIELDS)).alias("_t"))
    entries = F.array(*[F.struct(F.lit(name).alias("key"), F.col(f"_t.{c}").cast("string").alias("value")) for c, (name, _, _, _) in FIELDS.items()])
    more = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    d = records.join(tags.withColumn("_more", more), ["chrom", "pos", "ref", "alt"])
    ids = [name for name, _, _, _ in FIELDS.values()]
    info = F.map_concat(vcf.delete_info(F.col("info"), ids), "_more")
    for name, number, kind, text in FIELDS.values():
        header.add("INFO", name, number, kind, text)
    vcf.write_vcf(d.withColumns({"info": info, "alt": F.array("alt")}), header, path)


def run(spark: SparkSession, vcf_path: str, folder: str, out_dir: str, terms: str | None = None, sample: str | None = None, father: str | None = None, mother: str | None = None, config: str | None = None, **settings) -> dict[str, str]:
    """Paths of what is written to out_dir: vcf (retained variants), variants (a report), genes and, with terms, diseases, best first.

    folder: Parquet tables by name: those of prioritize.Resources, links (src, dst, w), nodes (node, gene) and, with terms, annotations, is_a, disease_genes and
    possibly funsim and pathways. sample, father, mother: samples of the VCF; without a sample the first one.
    """
    r, more = resources(spark, folder)
    records, header = vcf.read_vcf(spark, vcf_path)
    sample = sample or (header.samples[0] if header.samples else None)
    keys = {"gt": sample, "gt_father": father, "gt_mother": mother}
    columns = {c: _of_allele(F.try_element_at(F.try_element_at("genotypes", F.lit(s)), F.lit("GT")), F.col("alt_no")) for c, s in keys.items() if s}
    d = vcf.explode_alts(records.withColumn("chrom", variant.chrom_bare(F.col("chrom")))).withColumns(columns)
    d = d.where(F.col("gt").contains("1")) if sample else d  # alleles that the sample has
    records = materialize(d.drop("alt_no").dropDuplicates(["chrom", "pos", "ref", "alt"]), "records")
    v = records.select("chrom", "pos", "ref", "alt", "filter", "info", *columns)
    p = None
    if terms:
        patient = tables.listing(spark, terms, "term")
        p = prioritize.Phenotypes(patient, more["annotations"], more["is_a"], more["disease_genes"], more.get("funsim"), more.get("pathways"))
    chosen = filter_config(config) if config else FilterConfig()
    out = prioritize.prioritize(v, r, chosen, p, more["links"], more["nodes"], "gt" if sample else None, father="gt_father" if father else None, mother="gt_mother" if mother else None, **settings)
    paths = {name: f"{out_dir.rstrip('/')}/{name}" for name in ("vcf", "variants", "genes", "diseases") if name != "diseases" or p is not None}
    _annotated_vcf(records, out, header, paths["vcf"])
    scores = out["genes"].select("gene", F.col("predicted_score").alias("score"))
    report = sinks.report(phenotype.report_scores(out["retained"], scores))
    sinks.ranked_tsv(report, [F.desc("gene_score"), F.asc("chrom"), F.asc("pos"), F.asc("ref"), F.asc("alt")], paths["variants"])
    sinks.ranked_tsv(out["genes"], [F.desc("predicted_score"), F.asc("gene")], paths["genes"])
    if p is not None:
        sinks.ranked_tsv(out["diseases"], [F.desc("score"), F.asc("disease_id")], paths["diseases"])
    return paths
