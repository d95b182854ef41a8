"""Mixing sources to target weights by Poisson replication.

Each source has a target rate, the mean number of times that its documents repeat: its share of
the target weight times the size of the mixture, over its own size in characters. A document's
count is the inverse of the Poisson distribution with that mean at a point that a seeded hash of
its doc_id gives, so a run can be repeated anywhere with equal results. Documents are exploded by
their count and dealt out by another hash, which shuffles globally.

Null sources count as the source ''. Null texts are empty; a source without characters has rate
1. A null doc_id is replaced by the text's MD5 in both hashes. Rows that repeat in full are drawn alike. Sources that `weights`
does not name have weight zero. An empty table gives an empty result. Extra columns are kept, whatever their
names; rate_mix, copy_mix and key_mix get underscores behind where docs has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.storage import materialize, partitions

#: A source table of more rows than this isn't broadcast.
BROADCAST_SOURCES = 20_000
#: Up to this rate the distribution is summed from zero, beyond it over the counts around the rate.
FROM_ZERO = 64.0


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of seed:key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k whose cumulative Poisson probability is over u."""
    return F.when(rate <= FROM_ZERO, _from_zero(u, rate)).when(u <= 0, F.lit(0)).otherwise(_around_rate(u, rate))


def _from_zero(u: Column, rate: Column) -> Column:
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(at: Column, i: Column) -> Column:
        p = at["p"] * rate / i
        over = u >= at["cdf"]
        return F.struct(p.alias("p"), F.when(over, at["cdf"] + p).otherwise(at["cdf"]).alias("cdf"), F.when(over, i).otherwise(at["k"]).alias("k"))

    return F.aggregate(steps, start, step, lambda at: at["k"])


def _around_rate(u: Column, rate: Column) -> Column:
    """For large rates, where exp(-rate) underflows: weights relative to that of the least count looked at, over their sum.

    What lies outside of 12 standard deviations has less than 1e-30 of the probability, and u is a multiple of 2^-52.
    """
    low = F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 20).cast("int"), F.lit(0))
    steps = F.sequence(low + 1, F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    one = F.lit(1.0)

    def add(at: Column, i: Column) -> Column:
        p = at["p"] * rate / i
        return F.struct(p.alias("p"), (at["sum"] + p).alias("sum"))

    goal = u * F.aggregate(steps, F.struct(one.alias("p"), one.alias("sum")), add, lambda at: at["sum"])

    def step(at: Column, i: Column) -> Column:
        p = at["p"] * rate / i
        over = at["goal"] >= at["cdf"]
        return F.struct(p.alias("p"), F.when(over, at["cdf"] + p).otherwise(at["cdf"]).alias("cdf"), F.when(over, i).otherwise(at["k"]).alias("k"), at["goal"].alias("goal"))

    return F.aggregate(steps, F.struct(one.alias("p"), one.alias("cdf"), low.alias("k"), goal.alias("goal")), step, lambda at: at["k"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source_mix, rate_mix). Without weights a source weighs its characters to the power `temperature`."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    per = docs.groupBy(source.alias("source_mix")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        per = per.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None)
        per = per.withColumn("weight", F.coalesce(F.element_at(named, F.col("source_mix")) if weights else named, F.lit(0.0)).cast("double"))
    per = materialize(per, "sources")
    total = per.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    goal, weight = float(total["size"] or 0) * epochs, float(total["weight"] or 0)
    rate = F.when((F.col("size") > 0) & F.lit(weight > 0), F.col("weight") / F.lit(weight or 1.0) * F.lit(goal) / F.col("size")).otherwise(F.lit(1.0))
    return per.select("source_mix", rate.alias("rate_mix"))


def own_names(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the rate, the number of the copy and the order that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in ("rate_mix", "copy_mix", "key_mix"):
        while name in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """docs' rows, each as often as drawn, in global random order, with rate_mix, copy_mix (from 1) and key_mix (the order)."""
    rates = source_rates(docs, weights, temperature, epochs)
    small = rates.count() <= BROADCAST_SOURCES
    rate, copy, order = own_names(docs)
    # Names are set aside while others come in.
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = list(d.columns)
    d = d.withColumn("source_mix", F.coalesce(F.col(at["source"]).cast("string"), F.lit("")))
    d = d.join(F.broadcast(rates) if small else rates, "source_mix")
    key = F.coalesce(F.col(at["doc_id"]).cast("string"), F.md5(F.coalesce(F.col(at["text"]).cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("count_mix", poisson_count(uniform(key, seed), F.col("rate_mix"))).where("count_mix > 0")
    d = d.select(*own, "rate_mix", F.explode(F.sequence(F.lit(1), F.col("count_mix"))).alias("copy_mix"))
    d = d.withColumn("key_mix", F.md5(F.concat(F.lit(f"{seed}:order:"), key, F.lit(":"), F.col("copy_mix").cast("string")).cast("binary")))
    d = d.repartition(partitions(docs.sparkSession, docs), "key_mix").sortWithinPartitions("key_mix")
    return d.toDF(*docs.columns, rate, copy, order)
