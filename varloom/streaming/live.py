"""Streams: new variant records looked up as they come, and windowed counts of events.

An addition: batch plans need neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.sources.vcf import explode_alts, parse_records


def lookup_stream(lines: DataFrame, sites: DataFrame, keys: list[str], values: list[str], samples: list[str] | None = None) -> DataFrame:
    """Streamed VCF lines, one row per allele, left-joined to a static reference table: a stateless stream-static join."""
    body = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return explode_alts(parse_records(body, samples or [])).join(sites.select(*keys, *values), keys, "left")


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts and sums with a watermark; partial aggregation keeps a hot kind small."""
    d = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind)
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
