"""Writers of tables and reports."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path_time(spark: SparkSession, path: str) -> int:
    """Modification time of a path in ms through Hadoop's file systems, -1 where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(place).getModificationTime() if files.exists(place) else -1


def stale(spark: SparkSession, inputs: list[str], output: str) -> bool:
    """Whether any input is newer than the output."""
    return max((path_time(spark, p) for p in inputs), default=0) > path_time(spark, f"{output}/_SUCCESS")


def build(spark: SparkSession, make, inputs: list[str], output: str, sort: list[str], force: bool = False) -> DataFrame:
    """A table sorted by its lookup keys within files, so that min-max statistics serve as an index; made again only if stale."""
    if force or stale(spark, inputs, output):
        make().repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)


def set_versions(rows: DataFrame, path: str) -> None:
    """Rows (dbname, file_date, version, entry_count) of release_info, the sources' former rows replaced: nothing is rewritten, and release_info() takes the last of each source."""
    kept = rows.select("dbname", "file_date", "version", F.col("entry_count").cast("long").alias("entry_count"), F.lit(int(time.time() * 1e6)).alias("written"))
    kept.write.mode("append").parquet(path)


def set_version(spark: SparkSession, path: str, name: str, date: str, version: str, count: int) -> None:
    """One source's version."""
    set_versions(spark.createDataFrame([(name, date, version, count)], "dbname string, file_date string, version string, entry_count long").coalesce(1), path)


def release_info(spark: SparkSession, path: str) -> DataFrame:
    """(dbname, file_date, version, entry_count): the last version of each source."""
    d = spark.read.parquet(path)
    kept = [c for c in d.columns if c not in ("dbname", "written")]
    return d.groupBy("dbname").agg(F.max_by(F.struct(*kept), "written").alias("_v")).select("dbname", "_v.*")


def general(c: Column) -> Column:
    """Six significant digits, as %g prints them."""
    return F.format_string("%.6g", c.cast("double"))


def ranked_tsv(d: DataFrame, order: list[Column], path: str) -> None:
    d.orderBy(*order).write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def version_key(c: Column) -> Column:
    """What sorts text in version order: runs of digits count as numbers."""
    return F.transform(F.split(c, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p))


def sort_columns(d: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Sort by columns with modes V (version), n or g (number), r (reversed text)."""
    made = {"V": lambda c: version_key(F.col(c)), "n": lambda c: F.col(c).try_cast("double"), "g": lambda c: F.col(c).try_cast("double"), "r": lambda c: F.col(c).desc()}
    return d.orderBy(*[made.get(mode, F.col)(c) for c, mode in keys])


def books(d: DataFrame, order: list[str], rows: int = 60_001) -> DataFrame:
    """Report rows with the number of their book, of `rows` rows each, in order."""
    from varloom.operators.scan import numbered

    return numbered(d, order, "_i").withColumn("book", F.floor((F.col("_i") - 1) / rows)).drop("_i")


def table_to_vcf_rows(d: DataFrame) -> DataFrame:
    """Mutation-table rows (chrom, pos, ref, alt, strand, base before) as VCF alleles: '-' is padded by the base before, '-' strands are flipped."""
    from varloom.functions.sequence import reverse_complement

    fwd = lambda c: F.when(F.col("strand") == "-", reverse_complement(F.col(c))).otherwise(F.col(c))
    gap = (F.col("ref") == "-") | (F.col("alt") == "-")
    bare = lambda c: F.when(F.col(c) == "-", "").otherwise(fwd(c))
    padded = lambda c: F.when(gap, F.concat("base_before", bare(c))).otherwise(fwd(c))
    return d.select("chrom", F.when(gap & (F.col("alt") == "-"), F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), padded("ref").alias("ref"), padded("alt").alias("alt"))


def coding_exons_bed(tx: DataFrame, pad: int = 0) -> DataFrame:
    """(chrom, start, end, name) of the coding exons of NM_ transcripts, clipped to the CDS, distinct."""
    from varloom.functions.sequence import coding

    d = tx.where(F.col("accession").startswith("NM_")).select("chrom", "gene", F.explode(coding(F.col("exons"), F.col("cds_start"), F.col("cds_end"))).alias("e"))
    return d.select("chrom", (F.col("e.start") - pad).alias("start"), (F.col("e.end") + pad).alias("end"), F.col("gene").alias("name")).distinct()


def clinvitae_to_vcf(d: DataFrame, longest: int = 100) -> DataFrame:
    """VCF alleles of submitted variants (chrom, pos, ref, alt, ...) whose alleles are at most `longest` bases, in order of site."""
    bases = F.col("ref").rlike("^[ACGTN]+$") & F.col("alt").rlike("^[ACGTN]+$")
    short = (F.length("ref") <= longest) & (F.length("alt") <= longest)
    return d.where(bases & short).distinct().orderBy("chrom", "pos", "ref", "alt")


def split_rows(d: DataFrame, n: int, key: list[str]) -> DataFrame:
    """d with `part` 0 to n - 1 by a hash of the key, to be written partitioned by it; concat_files() reads them as one again."""
    return d.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))


def concat_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of several Parquet folders with equal columns."""
    return spark.read.parquet(*paths)


def collapse_sites(d: DataFrame, key: list[str], ident: str) -> DataFrame:
    """One row per site with its ids, comma-joined."""
    return d.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(ident)), ",").alias(ident))


# Columns of the variant report, in order.
REPORT = ("chrom", "pos", "ref", "alt", "gene", "region", "consequence", "class_tag", "gene_score", "site_link", "gene_link")
LINKS = {"site": "https://www.ncbi.nlm.nih.gov/snp/?term=", "gene": "https://www.genenames.org/tools/search/#!/?query="}


def report(d: DataFrame) -> DataFrame:
    """The report's columns: links as formulas of spreadsheets; intergenic variants bear the nearest gene in parentheses."""
    near = F.coalesce("previous_gene", "next_gene")
    gene = F.coalesce("gene", F.when(near.isNotNull(), F.concat(F.lit("("), near, F.lit(")"))), F.lit("."))
    link = lambda base, text: F.concat(F.lit('=HYPERLINK("' + base), text, F.lit('")'))
    site = F.concat_ws(":", "chrom", F.col("pos").cast("string"))
    bare = F.regexp_replace(gene, r"[()]", "")
    return d.withColumns({"gene": gene, "site_link": link(LINKS["site"], site), "gene_link": F.when(bare != ".", link(LINKS["gene"], bare))}).select(*REPORT)


def downstream_report(d: DataFrame) -> DataFrame:
    """Rows of family.downstream() as they are reported: one per gene, transcript and haplotype, its variants in order."""
    row = F.struct("pos", F.concat_ws(":", F.col("pos").cast("string"), "consequence", F.col("running").cast("string")).alias("t"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), ";")
    return d.groupBy("gene", "transcript", "haplotype").agg(F.count(F.lit(1)).alias("n"), listed.alias("variants"))


def catalogue(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, place, column, type, rows, nulls) of Parquet tables by name; one pass over each counts its rows and nulls."""
    out = None
    for name, path in paths.items():
        d = spark.read.parquet(path)
        counted = d.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f.name).isNull()).alias(f"_n{i}") for i, f in enumerate(d.schema.fields)])
        told = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("nulls")) for i, f in enumerate(d.schema.fields)]
        one = counted.select(F.lit(name).alias("table"), F.explode(F.array(*told)).alias("_t")).select("table", "_t.*")
        out = one if out is None else out.unionByName(one)
    return out
