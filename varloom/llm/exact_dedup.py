"""Exact dedup over a persistent digest index.

The index is a Parquet table of (digest, keep_id, batch), bucketed and sorted by digest. A batch of
documents is reduced to one row per digest, sort-merge joined with the index to learn what is known, and
what a second, anti, join finds new is appended; neither join shuffles the index. Buckets follow from the size of the index: an
index of too many files or too large buckets is rewritten as a new generation beside the old one,
and readers take the last one that was finished.

Every row bears its batch. Rows of the batch at hand count as new, so a batch that is run again under its name after
a lost job has the same result and appends nothing twice.

Texts are equal when identical after lower-casing A-Z. Of equal texts in one batch the row with
the largest doc_id stays; a text that an earlier batch put into the index is a copy of the
indexed document. Null text counts as empty, a null doc_id is smaller than any other, of
rows repeated in full exactly one stays, and an empty batch appends nothing. Columns beyond
the id and the text are never looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.text import ascii_lower, id_and_text, quoted
from varloom.storage import fresh_path, listed, materialize

#: A bucket of the index is made for so many bytes (some 40 each digest), and rewritten beyond four times as many or so many files.
BUCKET_BYTES, BUCKET_FILES = 64 << 20, 16
_GENERATION = re.compile(r"g(\d+)-b(\d+)$")


class DigestIndex:
    """Digests of all documents kept so far, in the folder `path`; `rows`: how many are expected, for the first generation."""

    def __init__(self, spark: SparkSession, path: str | None = None, rows: int = 0, buckets: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "digest-index")
        found = [(int(m[1]), int(m[2])) for name in listed(spark, self.path) if (m := _GENERATION.search(name)) and f"{name}.done" in listed(spark, self.path)]
        self.table = ""
        self._open(*max(found, default=(0, buckets or self._buckets(40 * rows))))

    @staticmethod
    def _buckets(size: int) -> int:
        return 1 << max(4, (-(-size // BUCKET_BYTES) - 1).bit_length())

    def _open(self, generation: int, buckets: int) -> None:
        self.close()
        self.generation, self.buckets, self.place = generation, buckets, f"{self.path}/g{generation}-b{buckets}"
        self.table = "digest_index_" + hashlib.md5(self.place.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.place}'"
        )
        if not generation:
            self._done()

    def _done(self) -> None:
        """Readers may use this generation from now on."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.place}.done")
        mark.getFileSystem(conf).mkdirs(mark)

    def close(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.place)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def append(self, rows: DataFrame, batch: str) -> None:
        """rows: (digest, keep_id), none of them in the index yet."""
        self._write(rows.withColumn("batch", F.lit(batch)))
        files = listed(self.spark, self.place, with_size=True)
        if len(files) > BUCKET_FILES * self.buckets or sum(files.values()) > 4 * BUCKET_BYTES * self.buckets:
            old = self.read()
            name = self.table
            self.table = ""  # stays in the catalog while it is read
            self._open(self.generation + 1, self._buckets(sum(files.values())))
            self._write(old)
            self._done()
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest): row tells repeated rows apart and is fixed once this is written."""
    d = id_and_text(docs)
    return d.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"))


def _groups(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """(digest, n, keep_id, keep_row) of a batch's rows; keep_row is null where an earlier batch has the text. New digests go into the index."""
    # Partial aggregation leaves one row per digest and task, so a text that fills a third of the table moves as a few rows.
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    known = index.read().where(F.col("batch") != batch).select(F.col("digest").alias("seen"), F.col("keep_id").alias("seen_id"))
    groups = groups.hint("merge").join(known.hint("merge"), F.col("digest") == F.col("seen"), "left")
    new = F.col("seen").isNull()
    groups = groups.select("digest", "n", F.when(new, F.col("best.doc_id")).otherwise(F.col("seen_id")).alias("keep_id"), F.when(new, F.col("best.row")).alias("keep_row"))
    groups = materialize(groups, "digest-groups")
    index.append(groups.hint("merge").join(index.read().select("digest").hint("merge"), "digest", "left_anti"), batch)
    return groups


def _told(rows: DataFrame, groups: DataFrame) -> DataFrame:
    # Both sides are written tables: adaptive execution may split the hot digest's partition.
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
    return rows.join(groups, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), kept, "digest")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (within this batch), kept, digest; new digests go into the index.

    batch: the batch's name, by which it may be run again; without one it counts as a batch of its own each time.
    """
    rows = materialize(digests(docs), "digests")
    return _told(rows, _groups(rows, index, batch or uuid.uuid4().hex))


def deduplicate_by_parts(docs: DataFrame, index: DigestIndex, parts: int = 2) -> DataFrame:
    """What deduplicate() returns, with the documents put in as `parts` batches of falling doc_id, so that the largest stays; group_size counts all."""
    rows = materialize(digests(docs), "digests")
    at = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100)).first()[0] if parts > 1 else None
    cuts = sorted(set(at or []), reverse=True)
    high, found = None, None
    for cut in [*cuts, None]:
        low = F.lit(True) if cut is None else F.col("doc_id") >= cut
        part = rows.where((low if high is None else low & (F.col("doc_id") < high)) | (F.col("doc_id").isNull() if cut is None else F.lit(False)))
        more = _groups(part, index, f"from {cut}")
        found, high = more if found is None else found.union(more), cut
    groups = found.groupBy("digest").agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"))
    return _told(rows, materialize(groups, "digest-groups"))


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; joined by document, so that no text meets its copies in one task.

    Of rows with one id and equal texts the least by the MD5 of the text as it is, then by a hash of all columns stays.
    """
    kept = deduplicate(docs, index, batch).where("kept").select(F.col("doc_id").alias("__dedup_id"), F.col("digest").alias("__dedup_digest"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = quoted(f.name for f in docs.schema.fields if not re.search("map<|variant|void", f.dataType.simpleString()))
    d = docs.select("*", F.unhex(F.sha2(ascii_lower(text), 256)).alias("__dedup_of"), F.col("doc_id").cast("long").alias("__dedup_doc"), F.md5(text.cast("binary")).alias("__dedup_own"), F.xxhash64(*every).alias("__dedup_all"))
    d = d.join(kept, F.col("__dedup_doc").eqNullSafe(F.col("__dedup_id")) & (F.col("__dedup_of") == F.col("__dedup_digest")), "left_semi")
    once = Window.partitionBy("__dedup_doc", "__dedup_of").orderBy("__dedup_own", "__dedup_all")
    return d.withColumn("__dedup_n", F.row_number().over(once)).where("__dedup_n = 1").select(*quoted(docs.columns))
