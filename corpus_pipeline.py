"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's result as Parquet to the shared folder and reads it as
the next one's docs.

In every stage null texts are empty texts, a null doc_id stays null and is the smallest, long texts are
read whole, an empty table gives an empty one, and columns beyond those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import exact_dedup, mixing, sentencepiece, simhash, toxicity
from varloom.llm.ship import shipped
from varloom.llm.text import quoted
from varloom.storage import materialize

#: A score, a hash that no DuckDB function gives and a vocabulary file decide, so SQL can't express the pipeline.
ORACLE_SQL = None
#: Segmentations that are searched for each text, as op3_sentencepiece does.
N_BEST = 2


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the machine is fitted on labelled rows that aren't held out.

    Without usable labels all stay unless the share of toxic ones reaches the threshold; repeated rows are each scored.
    """
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, machine)


@shipped
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id; of rows repeated in full one. Empty texts are equal to one another."""
    index = exact_dedup.DigestIndex(spark)
    out = exact_dedup.keep_first(docs, index)
    index.close()
    return out


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that a chain of similarities of 0.8 or more over five-word shingles joins, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weight of their source asks for, in global random order; a null source is one of its own."""
    return mixing.mix(docs).select(*quoted(docs.columns))


@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and score of the best of N_BEST segmentations of each text, the SHA-256 of what they decode to and whether all decode alike."""
    out = sentencepiece.round_trip(docs, n_best=N_BEST)
    return out.selectExpr("doc_id", "nbest[0].score AS score", "nbest[0].ids AS ids", "sha2(texts[0], 256) AS text_sha256", "size(array_distinct(texts)) = 1 AS same_text")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
    return docs
