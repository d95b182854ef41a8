"""Family operators: haplotypes of a gene's variants, sex from genotypes, downstream mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import variant
from varloom.operators.aggregates import fold_until_restored, ratio_flag
from varloom.storage import HELD_BYTES, partitions

PASSING = ("PASS", "VQSRTrancheSNP99.00to99.90")


def sex(genotypes: DataFrame, sample: str, chrom: str, genotype: str, limit: float = 0.01) -> DataFrame:
    """(sample, n_top, n_under, male): called Y sites over X sites."""
    called = ~variant.is_no_call(F.col(genotype))
    bare = variant.chrom_bare(F.col(chrom))
    return ratio_flag(genotypes, [sample], called & (bare == "Y"), called & (bare == "X"), limit, "male")


def haplotypes(trio: DataFrame) -> DataFrame:
    """One row per variant, transcript and chromatid that carries it.

    trio: gene, transcript, region, consequence, pos, size (bases inserted less bases deleted), filter, father, mother, child.
    Unphased variants must be homozygous to be placed on both.
    """
    d = trio.where(F.col("filter").isin(*PASSING) & (F.col("region") == "CodingExonic"))
    d = d.withColumn("_g", variant.alleles(variant.phase(F.col("father"), F.col("mother"), F.col("child"))))
    both = F.array(F.struct(F.lit(1).alias("h"), F.col("_g.a1").alias("a")), F.struct(F.lit(2).alias("h"), F.col("_g.a2").alias("a")))
    sure = F.col("_g.phased") | (F.col("_g.a1") == F.col("_g.a2"))
    d = d.where(sure).withColumn("_h", F.explode(both)).where(~F.col("_h.a").isin("0", "."))
    return d.withColumn("haplotype", F.col("_h.h")).drop("_g", "_h")


def downstream(trio: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Rows of haplotypes with more than one variant, a frame shift or stop gain among them, and the running frame until it is restored.

    tie: columns that order variants of one position and consequence.
    """
    d = haplotypes(trio)
    group = ["gene", "transcript", "haplotype"]
    order = ["pos", "consequence", *(tie or [])]
    # All of a group's frame in the order that the running frame needs too: one sort serves both.
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.repartition(partitions(d.sparkSession, trio, each=HELD_BYTES), *group)
    shifts = F.col("consequence").isin("FrameShiftInsert", "FrameShiftDelete", "StopGain")
    d = d.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_s", F.max(shifts.cast("int")).over(w)).where("_n > 1 and _s = 1").drop("_n", "_s")
    return fold_until_restored(d, group, order, "size")
