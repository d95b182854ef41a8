"""Scans of the reference tables' raw formats. All are declarative reads with fixed schemas and null-safe casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources import lines as splits
from varloom.storage import materialize, sorted_partitions

# Column layouts of public formats.
GENEPRED = "bin int, name string, chrom string, strand string, tx_start int, tx_end int, cds_start int, cds_end int, exon_count int, exon_starts string, exon_ends string, score int, name2 string, cds_start_stat string, cds_end_stat string, exon_frames string"
DISEASE_GENE = "disease_id string, gene string, gene_id string, hpo_id string, hpo_desc string"
PED = "fam_id string, ind_id string, pat_id string, mat_id string, sex int, phenotype int"
MIRNA = "mirbase_acc string, mirna string, gene_id string, gene string, transcript string, refseq_acc string, mirna_align string, gene_align string, coord_info string, energy double, score double"
HPO = "database string, db_object string, db_name string, qualifier string, hpo_id string, reference string, evidence string, onset string, frequency string, modifier string, aspect string, synonyms string, updated string, assigned string"
INTERPRO = "chrom string, start int, end int, gene string, transcript string, uniprot string, domain_id string, description string"
FUNSIM = "uniprot1 string, uniprot2 string, category string, score double"
CLINVITAE = "gene string, cdna string, protein string, other string, transcript string, region string, reported string, classification string, evaluated string, source string, updated string, url string, comment string, accession string"
REGULOME = "chrom string, pos int, snpid string, exp_info string, score string"


def tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False, sep: str = "\t", comment: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
    reader = reader.option("comment", comment) if comment else reader
    return (reader.schema(schema) if schema else reader).csv(path)


def text(spark: SparkSession, path: str, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """(value), a row for each line; files of any compression, told by their first bytes. Plain ones are read by Spark's own reader."""
    files = splits.listed_files(spark, path)
    if splits.kinds(files) <= {"plain"}:
        return spark.read.text([uri for uri, _ in files]) if files else spark.createDataFrame([], "value string")
    return splits.lines(spark, path, split_bytes).select("value")


def listing(spark: SparkSession, path: str, name: str = "item") -> DataFrame:
    """One item a line; lines that begin with # and empty ones are left out."""
    d = text(spark, path).select(F.trim("value").alias(name))
    return d.where((F.col(name) != "") & ~F.col(name).startswith("#"))


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(mode, gene) of files with #incl and #excl sections; genes before any section are included. A section goes over splits by scan.running()."""
    from varloom.operators import scan

    line = F.trim("value")
    d = scan.dealt(splits.lines(spark, path), ["file"], ["pos"])
    d = scan.running(d, ["file"], ["pos"], "_mode", F.when(line.startswith("#"), F.trim(F.regexp_replace(line, "#", ""))), "last")
    return d.where((line != "") & ~line.startswith("#")).select(F.coalesce("_mode", F.lit("incl")).alias("mode"), line.alias("gene"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name, score, strand), 0-based half-open; track and comment lines and rows without a usable interval drop out."""
    f = F.split("value", r"\s+")
    part = lambda i: F.get(f, F.lit(i))
    d = text(spark, path).select(
        part(0).alias("chrom"), part(1).try_cast("int").alias("start"), part(2).try_cast("int").alias("end"), part(3).alias("name"), part(4).try_cast("double").alias("score"), F.when(part(5).isin("+", "-"), part(5)).alias("strand")
    )
    return d.where(F.col("chrom").rlike(r"^(chr)?([0-9]{1,2}|X|Y|M|MT)([_A-Za-z0-9]*)$") & (F.col("start") <= F.col("end")))


def region(text_: Column) -> Column:
    """struct<chrom, start, end> of chr:start-end; thousands may be parted by commas."""
    pick = lambda i: F.regexp_extract(text_, r"^([^:]+):([0-9,]+)-([0-9,]+)$", i)
    number = lambda i: F.regexp_replace(pick(i), ",", "").try_cast("int")
    return F.struct(F.nullif(pick(1), F.lit("")).alias("chrom"), number(2).alias("start"), number(3).alias("end"))


def numbers(text_: Column) -> Column:
    return F.transform(F.filter(F.split(text_, ","), lambda x: x != ""), lambda x: x.try_cast("int"))


def genepred(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts with exons array<struct<start, end, frame, number>>; numbers follow the strand."""
    d = tsv(spark, path, GENEPRED).where(F.col("bin").isNotNull())
    zipped = F.arrays_zip(numbers(F.col("exon_starts")).alias("start"), numbers(F.col("exon_ends")).alias("end"), numbers(F.col("exon_frames")).alias("frame"))
    n = F.size(zipped)
    exons = F.transform(zipped, lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["frame"].alias("frame"), F.when(F.col("strand") == "-", n - i).otherwise(i + 1).alias("number")))
    return d.select("name", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "exon_count", "score", F.col("name2").alias("gene"), "cds_start_stat", "cds_end_stat", exons.alias("exons"))


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(chrom, chunk, offset, sequence): sequences in upper case, cut into chunks so that no row grows with a chromosome; see varloom.sources.fasta."""
    from varloom.sources import fasta as indexed

    return indexed.chunks(spark, path, chunk)


def bases(wanted: DataFrame, chunks: DataFrame, chrom: str, start: str, length: str, chunk: int = 1 << 20, row: str = "row") -> DataFrame:
    """wanted (row, chrom, 0-based start, length) with `bases`, from the chunks that it touches.

    Chunks should be a written table: they are counted, as are the pieces asked for, and joined in as many partitions as these rows need. Spark's estimate leaves
    out what exploding adds, so no side is left to it to be sent whole.
    """
    touched = F.explode(F.sequence(F.floor(F.col(start) / chunk).cast("int"), F.floor((F.col(start) + F.col(length) - 1) / chunk).cast("int")))
    d = materialize(wanted.select(row, chrom, start, length, touched.alias("_k")), "touched")
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("sequence")), F.lit(0)).alias("text")).first()
    n = sorted_partitions(wanted.sparkSession, d.count() + size["n"], size["text"])
    d = d.repartition(n, chrom, "_k")
    c = chunks.select(F.col("chrom").alias("_c"), F.col("chunk").alias("_kc"), "offset", "sequence").repartition(n, "_c", "_kc")
    d = d.join(c.hint("merge"), (F.col(chrom) == F.col("_c")) & (F.col("_k") == F.col("_kc")))
    first = F.greatest(F.col(start), F.col("offset"))
    part = F.substr("sequence", (first - F.col("offset") + 1).cast("int"), (F.least(F.col(start) + F.col(length), F.col("offset") + chunk) - first).cast("int"))
    d = d.select(row, F.struct("_k", part.alias("p")).alias("_p")).repartition(n, row)
    parts = d.groupBy(row).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda x: x["p"]), "").alias("bases"))
    return wanted.repartition(n, row).join(parts.hint("merge"), row, "left")


# Start and end lines of multi-line formats, and lines of a record where lines don't tell (FASTQ's qualities may begin with @).
RECORD_FORMATS = {
    "embl": ("^ID ", "^//", None),
    "swissprot": ("^ID ", "^//", None),
    "genbank": ("^LOCUS ", "^//", None),
    "genpept": ("^LOCUS ", "^//", None),
    "fasta": ("^>", None, None),
    "fastq": ("^@", None, 4),
    "obo": (r"^\[Term\]", None, None),
    "omim": (r"^\*RECORD\*", None, None),
    "unigene": ("^ID ", "^//", None),
    "kegg": ("^ENTRY", "^///", None),
    "pfam": ("^# STOCKHOLM", "^//", None),
    "prosite": ("^ID ", "^//", None),
    "medline": ("^PMID-", None, None),
    "transfac": ("^AC ", "^//", None),
    "utr": ("^ID ", "^//", None),
    "enzyme": ("^ID ", "^//", None),
    "interpro": ("<interpro ", "</interpro>", None),
    "pdb": ("^HEADER", r"^END\s*$", None),
    "sdf": (None, r"^\$\$\$\$", None),
}


def record_scan(spark: SparkSession, path: str, format_: str, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """(file, record, lines) of a known multi-line format; record is the place of its first line in the file."""
    return splits.records(spark, path, *RECORD_FORMATS[format_], split_bytes=split_bytes).withColumnRenamed("pos", "record")


def uniprot(recs: DataFrame) -> DataFrame:
    """(accession, gene, mim_id) of swissprot records, a row for each MIM phenotype."""
    joined = F.array_join("lines", "\n")
    acc = F.regexp_extract(joined, r"(?m)^AC\s+(\w+);", 1)
    gene = F.regexp_extract(joined, r"(?m)^GN\s+Name=([^; {]+)", 1)
    mims = F.regexp_extract_all(joined, F.lit(r"DR\s+MIM; (\d+); phenotype"), F.lit(1))
    return recs.select(acc.alias("accession"), gene.alias("gene"), F.explode(mims).alias("mim_id"))


def nsfp(d: DataFrame) -> DataFrame:
    """Rows of a functional-prediction table exploded over ';'-parted transcripts, best scores per residue: least SIFT, largest PolyPhen."""
    parts = lambda c: F.split(c, ";")
    z = F.arrays_zip(parts("transcript").alias("transcript"), parts("aapos").alias("aapos"), parts("sift_score").alias("sift"), parts("pp2_score").alias("pp2"))
    d = d.withColumn("_z", F.explode(z)).withColumns({"tx": F.col("_z.transcript"), "pos_aa": F.col("_z.aapos").try_cast("int"), "sift": F.col("_z.sift").try_cast("double"), "pp2": F.col("_z.pp2").try_cast("double")})
    return d.groupBy("chrom", "pos", "ref", "alt", "gene", "pos_aa").agg(F.min("sift").alias("sift_score"), F.max("pp2").alias("pp2_score"), F.min_by("tx", F.struct(F.coalesce("sift", F.lit(9.0)), "tx")).alias("transcript"))


def catalogue(d: DataFrame, snps: str, genes: str, source: str) -> DataFrame:
    """Association rows exploded by SNP and gene, whatever separates them; rows without rs id drop out."""
    d = d.withColumn("snp", F.explode(F.regexp_extract_all(F.col(snps), F.lit(r"(rs\d+)"), F.lit(1))))
    return d.withColumn("gene_", F.explode(F.split(genes, r"\s*[,;/]\s*"))).withColumn("refdb", F.lit(source)).drop(genes).withColumnRenamed("gene_", "gene")


def goa(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (uniprot, gene) of an annotation file with ! comments."""
    d = tsv(spark, path, comment="!")
    return d.select(F.col("_c1").alias("uniprot"), F.col("_c2").alias("gene")).distinct()


def last_of(d: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the last row of each key in file order."""
    return d.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_of(d: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return d.groupBy(key).agg(F.min_by(value, order).alias(value))


def string_links(spark: SparkSession, path: str, least: float = 350) -> DataFrame:
    """(src, dst, w) of a protein network, species prefixes taken off."""
    d = tsv(spark, path, "protein1 string, protein2 string, combined_score double", header=True, sep=" ")
    bare = lambda c: F.regexp_extract(c, r"\d+\.(\w+)", 1)
    return d.where(F.col("combined_score") >= least).select(bare("protein1").alias("src"), bare("protein2").alias("dst"), F.col("combined_score").alias("w"))


def pathways(spark: SparkSession, path: str) -> DataFrame:
    """(src gene, dst pathway, w = 1, description)."""
    d = tsv(spark, path, "hsa_id string, pathway_desc string, genes string", header=True)
    return d.select(F.explode(F.split("genes", ",")).alias("src"), F.col("hsa_id").alias("dst"), F.lit(1.0).alias("w"), F.col("pathway_desc").alias("description"))


def pathway_json(text_: Column) -> Column:
    """Genes of a web service's answer, [{"name": ...}, ...]."""
    return F.transform(F.from_json(text_, "array<map<string,string>>"), lambda m: F.try_element_at(m, F.lit("name")))


def hpo(spark: SparkSession, path: str) -> DataFrame:
    """(disease_id, hpo_id) of an annotation file, rows with the qualifier NOT left out."""
    d = tsv(spark, path, HPO, comment="#").where(~F.coalesce(F.col("qualifier") == "NOT", F.lit(False)))
    return d.select(F.concat_ws(":", "database", "db_object").alias("disease_id"), "hpo_id").where("hpo_id is not null").distinct()


def clinvitae(spark: SparkSession, path: str) -> DataFrame:
    """Submitted variants: lines of 14 fields that may_pass()."""
    d = text(spark, path).where((F.size(F.split("value", "\t")) == 14) & ~F.col("value").startswith("Gene\t"))
    f = F.split("value", "\t")
    return d.select(*[F.nullif(F.trim(F.get(f, F.lit(i))), F.lit("")).alias(c.split()[0]) for i, c in enumerate(CLINVITAE.split(", "))]).where(may_pass(F.col("cdna"), F.col("classification")))


def may_pass(cdna: Column, classification: Column) -> Column:
    """Rows with a cDNA change and a class that says something."""
    unclear = F.lower(F.coalesce(classification, F.lit(""))).isin("", "not provided", "other", "unknown")
    return F.coalesce(cdna.contains("c."), F.lit(False)) & ~unclear


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A table of a relational database, for moving it to Parquet; read in `parts` ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def rgb(text_: Column) -> Column:
    """struct<r, g, b> of a colour field, null if it isn't three numbers up to 255."""
    part = F.transform(F.split(text_, ","), lambda x: F.trim(x).try_cast("int"))
    good = (F.size(part) == 3) & F.forall(part, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    return F.when(good, F.struct(F.get(part, F.lit(0)).alias("r"), F.get(part, F.lit(1)).alias("g"), F.get(part, F.lit(2)).alias("b")))


def gerp_elements(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, score, pvalue): the chromosome is in the file's name."""
    f = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"(chr[0-9XYMT]+)", 1).alias("chrom"), f.alias("f"))
    return d.select("chrom", F.get("f", F.lit(0)).try_cast("int").alias("start"), F.get("f", F.lit(1)).try_cast("int").alias("end"), F.get("f", F.lit(3)).try_cast("double").alias("score"), F.get("f", F.lit(4)).alias("pvalue")).where("start is not null")


def diseases(spark: SparkSession, path: str, annotations: str | None = None) -> DataFrame:
    """(disease_id, description, genes, hpos) of the disease-gene-phenotype file, with descriptions from the annotation file."""
    d = tsv(spark, path, DISEASE_GENE, comment="#").groupBy("disease_id").agg(F.array_sort(F.collect_set("gene")).alias("genes"), F.array_sort(F.collect_set("hpo_id")).alias("hpos"))
    if not annotations:
        return d.withColumn("description", F.lit(None).cast("string"))
    a = tsv(spark, annotations).select(F.concat_ws(":", "_c0", "_c1").alias("disease_id"), F.col("_c2").alias("description"))
    return d.join(a.groupBy("disease_id").agg(F.min("description").alias("description")), "disease_id", "left")


def without_genes(annotated: DataFrame, with_genes: DataFrame) -> DataFrame:
    return annotated.select("disease_id").distinct().join(with_genes.select("disease_id"), "disease_id", "left_anti")


def ped(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, PED, comment="#")


def ped_missing(pedigree: DataFrame, samples: list[str]) -> DataFrame:
    """Members of the pedigree that the variant file lacks."""
    return pedigree.where(~F.col("ind_id").isin(samples))
