"""The training run: from sites with votes to the parameters that the damage model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import damage, variant
from varloom.operators import sites
from varloom.plans.prioritize import Resources, annotate
from varloom.storage import materialize


def fits(export: DataFrame, votes: Column, r: Resources, least: int = 10) -> DataFrame:
    """(model, class, aa, a, b, loc, scale, mean): beta distributions of scores of benign (0) and pathogenic (1) variants, as Resources.fits takes them.

    export: (chrom, pos, ref, alt) and what `votes` (-1 benign, 1 pathogenic) reads; several rows of a variant count once, contradicting ones not at all.
    The models: cadd and gerp by the reference residue, or by the kind of the variant where there is none, and mnp by the number of scored bases. Keys with
    fewer than `least` variants have no fit.
    """
    labelled = sites.labelled(export, votes).where("label <> 'vus'")
    v = annotate(labelled, Resources(r.transcripts, conserved=r.conserved, cadd=r.cadd))
    v = materialize(v.dropDuplicates(["variant"]), "training")
    kind = variant.variant_type(F.col("ref"), F.array("alt"))
    part = F.get(variant.decompose(F.col("pos"), F.col("ref"), F.col("alt")), F.lit(0))["type"]
    residue = F.coalesce(F.substr(F.when(F.col("cadd_aa") != "./.", F.col("cadd_aa")), F.lit(1), F.lit(1)), part)
    rows = F.array(
        F.struct(F.lit("cadd").alias("model"), residue.alias("aa"), F.when(kind != "mnp", F.col("cadd_raw")).alias("score")),
        F.struct(F.lit("mnp").alias("model"), F.col("cadd_bases").cast("string").alias("aa"), F.when(kind == "mnp", F.col("cadd_raw")).alias("score")),
        F.struct(F.lit("gerp").alias("model"), residue.alias("aa"), F.col("gerp").alias("score")),
    )
    d = v.select((F.col("label") == "pathogenic").cast("int").alias("class"), F.explode(rows).alias("_r")).select("class", "_r.*").where("score is not null")
    out = damage.beta_likelihood(d, ["model", "class", "aa"], "score")
    return out.where((F.col("n") >= least) & F.col("a").isNotNull()).drop("n")
