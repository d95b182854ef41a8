"""Gene models: exon tables, lengths, sequences, counts per gene."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import sequence


def exon_table(tx: DataFrame) -> DataFrame:
    """(gid, name, number, start, end, frame), a row for each exon."""
    return tx.select("gid", "name", F.explode("exons").alias("e")).select("gid", "name", F.col("e.number").alias("number"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.frame").alias("frame"))


def defects(tx: DataFrame) -> DataFrame:
    """(gid, name, remark) of transcripts whose CDS isn't a multiple of three."""
    length = sequence.length_of(sequence.coding(F.col("exons"), F.col("cds_start"), F.col("cds_end")))
    return tx.select("gid", "name", sequence.cds_defect(length).alias("remark")).where("remark is not null")


def cds_length(tx: DataFrame) -> DataFrame:
    """(gid, name, gene, length): exons clipped to the CDS."""
    return tx.select("gid", "name", "gene", sequence.length_of(sequence.coding(F.col("exons"), F.col("cds_start"), F.col("cds_end"))).alias("length"))


def max_cds_length(tx: DataFrame, default: int = 480) -> DataFrame:
    """(gene, protein_len): a third of the longest CDS of a gene."""
    return cds_length(tx).groupBy("gene").agg(F.max("length").alias("l")).select("gene", F.when(F.col("l") > 0, F.floor(F.col("l") / 3)).otherwise(default).cast("int").alias("protein_len"))


def union_length(tx: DataFrame) -> DataFrame:
    """(gene, length) of the union of a gene's coding exons."""
    parts = F.explode(sequence.coding(F.col("exons"), F.col("cds_start"), F.col("cds_end")))
    d = tx.select("gene", "chrom", parts.alias("p")).select("gene", "chrom", F.col("p.start").alias("s"), F.col("p.end").alias("e")).distinct()
    w = Window.partitionBy("gene", "chrom").orderBy("s", "e")
    reach = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    d = d.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reach)))
    return d.groupBy("gene").agg(F.sum("new").alias("length"))


def gene_exons(tx: DataFrame) -> DataFrame:
    """Distinct exons of each gene, numbered by start."""
    d = tx.select("gene", "chrom", F.explode("exons").alias("e")).select("gene", "chrom", F.col("e.start").alias("start"), F.col("e.end").alias("end")).distinct()
    return d.withColumn("number", F.row_number().over(Window.partitionBy("gene").orderBy("start", "end")))


def mrna(tx: DataFrame, chunks: DataFrame | None = None, chunk: int = 1 << 20, indexed: DataFrame | None = None) -> DataFrame:
    """(gid, name, seq_len, sequence) from the chunks of the chromosomes that exons touch, or from byte ranges of an indexed FASTA file."""
    from varloom.sources.fasta import substrings
    from varloom.sources.tables import bases

    e = tx.select("gid", "name", "strand", "chrom", F.posexplode("exons").alias("i", "e")).withColumns({"row": F.concat_ws(":", "gid", "i"), "start": F.col("e.start"), "n": F.col("e.end") - F.col("e.start")})
    e = e.select("row", "chrom", "start", "n", "gid", "name", "strand", "i")
    b = bases(e, chunks, "chrom", "start", "n", chunk) if indexed is None else substrings(e, indexed, "chrom", "start", "n")
    d = b.groupBy("gid", "name", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "bases"))), lambda x: x["bases"]), "").alias("s"))
    seq = F.when(F.col("strand") == "-", sequence.reverse_complement(F.col("s"))).otherwise(F.col("s"))
    return d.select("gid", "name", F.length("s").alias("seq_len"), seq.alias("sequence"))


def motif_counts(mrnas: DataFrame, motifs: DataFrame, name: str, size: int = 6) -> DataFrame:
    """(name, count) of motif hits, non-overlapping per motif: windows of `size` bases meet the motif list by an equi-join first.

    The list has 4**size motifs at most and is the side that is sent to all tasks; of exploded sequences Spark's estimate knows one window each.
    """
    d = mrnas.withColumn("_w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("sequence") - size + 1, F.lit(1))), lambda i: F.substr("sequence", i, F.lit(size))))))
    d = d.join(F.broadcast(motifs.select(F.col("motif").alias("_w")).distinct()), "_w")
    return d.groupBy("name").agg(F.sum(F.size(sequence.motif_positions(F.col("sequence"), F.col("_w")))).alias(name))


def variants_per_gene(d: DataFrame, gene: str, site: list[str]) -> DataFrame:
    return d.groupBy(gene).agg(F.count_distinct(*site).alias("n_variants"))


def polymorphism(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(gene, n_variants, length, score), most variants per base first."""
    d = counts.join(lengths, "gene").withColumn("score", F.try_divide("n_variants", "length"))
    return d.orderBy(F.desc("score"), "gene")


def consequence_counts(d: DataFrame, gene: str = "gene") -> DataFrame:
    """Counts by loss of function or missense and by benign, uncertain or pathogenic vote (-1, 0, 1), one pass."""
    lof = F.col("consequence").isin("StopGain", "StopLoss", "StartLoss", "FrameShiftInsert", "FrameShiftDelete")
    kinds, votes = {"lof": lof, "nsm": F.col("consequence").isin("NonSyn", "NonSynStart")}, {"benign": -1, "vus": 0, "pathogenic": 1}
    return d.groupBy(gene).agg(*[F.count_if(k & (F.col("vote") == v)).alias(f"{vn}_{kn}") for kn, k in kinds.items() for vn, v in votes.items()])


def codon_map(tx: DataFrame) -> DataFrame:
    """(name, codon number, positions): the three genomic positions of each codon, in transcript direction."""
    parts = sequence.coding(F.col("exons"), F.col("cds_start"), F.col("cds_end"))
    d = tx.select("name", "strand", F.explode(parts).alias("p")).select("name", "strand", F.explode(F.sequence(F.col("p.start"), F.col("p.end") - 1)).alias("pos"))
    order = F.when(F.col("strand") == "-", -F.col("pos")).otherwise(F.col("pos"))
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy(order)) - 1)
    return d.groupBy("name", (F.floor(F.col("i") / 3) + 1).alias("codon")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pos"))), lambda x: x["pos"]).alias("positions"))


def relabel(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """tx with refseq: by versioned id, else by the id without version (its highest version)."""
    exact = ids.select(F.col("ensembl").alias("name"), F.col("refseq").alias("_r1"))
    bare = ids.withColumns({"_b": F.substring_index("ensembl", ".", 1), "_v": F.coalesce(F.split_part("ensembl", F.lit("."), F.lit(2)).try_cast("int"), F.lit(0))})
    bare = bare.groupBy("_b").agg(F.max_by("refseq", F.struct("_v", "refseq")).alias("_r2"))
    d = tx.join(exact, "name", "left").withColumn("_b", F.substring_index("name", ".", 1)).join(bare, "_b", "left")
    return d.withColumn("refseq", F.coalesce("_r1", "_r2")).drop("_r1", "_r2", "_b")


def gene_lookup(tx: DataFrame, **by) -> DataFrame:
    """Transcripts by gene, accession, gid, chrom or strand, whichever are given."""
    d = tx
    for name, value in by.items():
        d = d.where(F.col(name) == value)
    return d


def genes_at(points: DataFrame, tx: DataFrame, chrom: str, pos: str) -> DataFrame:
    """points (1-based pos) with gid, accession, gene and strand of the transcripts that hold them."""
    from varloom.operators import intervals

    t = tx.select(F.col("chrom").alias("_tc"), (F.col("tx_start") + 1).alias("_ts"), F.col("tx_end").alias("_te"), "gid", "accession", "gene", "strand")
    return intervals.point_join(points, t, chrom, pos, "_tc", "_ts", "_te").drop("_tc", "_ts", "_te")


def mrna_lookup(d: DataFrame, mrnas: DataFrame) -> DataFrame:
    """d (gid, accession) with the transcript's sequence; mrnas: (gid, name, sequence)."""
    return d.join(mrnas.select("gid", F.col("name").alias("accession"), "sequence"), ["gid", "accession"], "left")


def pathogenic_profile(d: DataFrame, tx: DataFrame) -> DataFrame:
    """(gene, counts by consequence and vote, length) of each gene that has variants."""
    return consequence_counts(d).join(union_length(tx), "gene", "left")
