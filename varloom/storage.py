"""Tables and files in the folder that the driver and every executor share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where a local session names none (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="varloom-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/varloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._varloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a table that materialize() made and that no later plan reads."""
    path = getattr(df, "_varloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def listed(spark: SparkSession, folder: str, with_size: bool = False) -> dict[str, int] | list[str]:
    """Names in a folder, none if there is no such folder; hidden files are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {x.getPath().getName(): x.getLen() for x in files.listStatus(place)} if files.exists(place) else {}
    found = {name: size for name, size in found.items() if name[0] not in "._"}
    return found if with_size else list(found)


#: Bytes of input for each partition of an exchange whose number of partitions is fixed, at most; and where a task holds its rows in a hash table or sorts them.
PARTITION_BYTES, HELD_BYTES = 128 << 20, 8 << 20


#: Bytes of rows that a task sorts, at most, and what a row takes besides its text.
SORTED_BYTES, ROW_BYTES = 64 << 20, 100


def sorted_partitions(spark: SparkSession, rows: int, text: int = 0) -> int:
    """Partitions for sorting counted rows with so many bytes of text in all: compressed files say little of rows that are alike."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows * ROW_BYTES + text) // SORTED_BYTES))


def partitions(spark: SparkSession, *tables: DataFrame, each: int = PARTITION_BYTES) -> int:
    """Partitions for an exchange of a fixed number: spark.sql.shuffle.partitions, and more where the files under `tables` are large."""
    size = 0
    for t in tables:
        leaves = t._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < 1 << 60)  # sources that can't tell claim a size beyond all
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
