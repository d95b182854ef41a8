"""Grouped aggregation, ranking and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.storage import discard, materialize


def nested_max_of_sum(d: DataFrame, outer: list[str], inner: list[str], value: str, name: str) -> DataFrame:
    return d.groupBy(*outer, *inner).agg(F.sum(value).alias("_s")).groupBy(*outer).agg(F.max("_s").alias(name))


def clipped_length(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Length of [start, end) inside [low, high), 0 if they don't meet."""
    return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))


def pivot_counts(d: DataFrame, key: list[str], rows: str, row_values: list, columns: str, column_values: list) -> DataFrame:
    """A column <row>_<column> for each pair of values, counted in one pass."""
    cells = [F.sum(F.when((F.col(rows) == r) & (F.col(columns) == c), 1).otherwise(0)).alias(f"{r}_{c}".lower()) for r in row_values for c in column_values]
    return d.groupBy(*key).agg(*cells)


def density(d: DataFrame, key: list[str], value: str, length: str, name: str) -> DataFrame:
    """value / length of each key over the total value / length. The totals are one row, whose size is proven."""
    per = d.groupBy(*key).agg(F.sum(value).alias("_v"), F.sum(length).alias("_l"))
    total = per.agg(F.sum("_v").alias("_tv"), F.sum("_l").alias("_tl"))
    return per.join(F.broadcast(total)).select(*key, F.try_divide(F.try_divide("_v", "_l"), F.try_divide("_tv", "_tl")).alias(name))


def top_sum(d: DataFrame, key: list[str], within: list[str], score: str, n: int, name: str) -> DataFrame:
    """Per key the sum of the n largest of the per-(key, within) maxima."""
    best = d.groupBy(*key, *within).agg(F.max(score).alias("_s"))
    ranked = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_s"), *within))
    return best.withColumn("_r", ranked).where(F.col("_r") <= n).groupBy(*key).agg(F.sum("_s").alias(name))


def argmax(d: DataFrame, key: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The first row of each key by `order` (a full tie-break keeps it deterministic)."""
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").select(*key, *values)


def normalize(d: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """value over the sum or the max of all values, which travels as one broadcast row."""
    total = d.agg((F.sum if by == "sum" else F.max)(value).alias("_t"))
    return d.join(F.broadcast(total)).withColumn(name, F.try_divide(F.col(value), F.col("_t"))).drop("_t")


def kth_largest(d: DataFrame, value: str, k: float, name: str) -> DataFrame:
    """The value at 0-based rank k, or under 1 at that fraction of the rows; the smallest where there are fewer."""
    if 0 < k < 1:
        k = int(k * d.where(F.col(value).isNotNull()).count() + 0.5)
    return d.select(value).orderBy(F.desc(value)).limit(int(k) + 1).agg(F.min(value).alias(name))


def best_pair(d: DataFrame, a: str, b: str, category: str, score: str) -> DataFrame:
    """Mean score and number of rows for each category of a pair, then per pair the best, those of more than one row first."""
    mean = d.groupBy(a, b, category).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("denominator"))
    return argmax(mean, [a, b], [(F.col("denominator") > 1).desc(), F.desc("mean_score"), F.asc(category)], [category, "mean_score", "denominator"])


def concat_distinct(d: DataFrame, key: list[str], value: str, sep: str, name: str) -> DataFrame:
    return d.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), sep).alias(name))


def percentiles(d: DataFrame, key: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return d.groupBy(*key).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in at.items()])


def refined_percentiles(d: DataFrame, key: list[str], value: str, at: dict[str, float], buckets: int = 1024) -> DataFrame:
    """percentiles(), where a key may hold more values than one task can: (key, and a column for each fraction).

    For all keys at once, values between the bounds of what is still sought are counted in `buckets` buckets, and the bounds become the least and the
    largest value of the bucket that holds the rank, until they are equal. Each round reads d once and moves counts alone: `buckets` rows for each key and rank
    from a task at most. Nulls and NaN take no part.
    """
    d = d.select(*key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    place = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in at.items()}
    sizes = materialize(d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "percentile-sizes")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place.values()])))
    sought = materialize(sizes.select(*key, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below")), "percentile-ranks")
    same = lambda: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], F.lit(True))
    renamed = lambda t: t.withColumnsRenamed({k: f"_k_{k}" for k in key})
    while not (open_ := sought.where("_lo < _hi")).isEmpty():
        cells = renamed(open_.select(*key, "_lo", "_hi", "_below").distinct())
        # Halves, as the difference of two large numbers may be infinite.
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        inside = d.join(cells, same() & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = inside.groupBy(*[f"_k_{k}" for k in key], "_lo", "_below", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"))
        upto = Window.partitionBy(*[f"_k_{k}" for k in key], "_lo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(upto), F.lit(0))).withColumnsRenamed({"_lo": "_cell"}).drop("_below")
        hit = open_.join(counts, same() & (F.col("_lo") == F.col("_cell")) & (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        step = hit.select(*key, "_rank", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), F.col("_before").alias("_below"))
        was, sought = sought, materialize(sought.where("_lo = _hi").unionByName(step), "percentile-ranks")
        discard(was)
    found = renamed(sought.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at")))
    d = sizes.join(found, same())
    value_at = lambda p: (F.ceil(p) - p) * F.try_element_at("_at", F.floor(p)) + (p - F.floor(p)) * F.try_element_at("_at", F.ceil(p))
    return d.select(*key, *[F.when(F.floor(p) == F.ceil(p), F.try_element_at("_at", F.floor(p))).otherwise(value_at(p)).alias(name) for name, p in place.items()])


def ratio_flag(d: DataFrame, key: list[str], top: Column, under: Column, limit: float, name: str) -> DataFrame:
    """Whether rows with `top` exceed `limit` times the rows with `under`."""
    n, m = F.count_if(top), F.count_if(under)
    return d.groupBy(*key).agg(n.alias("n_top"), m.alias("n_under"), F.coalesce(F.try_divide(n.cast("double"), m) > limit, F.lit(False)).alias(name))


def run_lengths(d: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: key, run (from 1), value, first and last of the first order column, n."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    d = d.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count(F.lit(1)).alias("n"))


def fold_until_restored(d: DataFrame, key: list[str], order: list[str], size: str, modulus: int = 3) -> DataFrame:
    """Running sum of sizes that starts anew after it is a multiple of `modulus`: key, order columns, running.

    A multiple of the modulus at a row leaves remainder 0, so a segment ends where the running remainder of the whole key is 0
    and the restarted sum is the whole sum less that at the last such row.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    d = d.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    restored = F.when(F.col("_sum") % modulus == 0, F.col("_sum"))
    base = F.coalesce(F.last(restored, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("running", F.col("_sum") - base).drop("_sum")


def dense_number(d: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """Distinct values of each key, numbered in order."""
    distinct = d.select(*key, value).distinct()
    return distinct.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(value)))


def coverage(members: DataFrame, sets: DataFrame, owner: str, set_id: str, item: str, over: float) -> DataFrame:
    """Owners and sets where the owner's items cover more than `over` of the owner's distinct items."""
    own = members.select(owner, item).distinct()
    size = own.groupBy(owner).agg(F.count(F.lit(1)).alias("n_items"))
    shared = own.join(sets.select(set_id, item).distinct(), item).groupBy(owner, set_id).agg(F.count(F.lit(1)).alias("n_shared"))
    out = shared.join(size, owner).withColumn("ratio", F.col("n_shared") / F.col("n_items"))
    return out.where(F.col("ratio") > over).select(owner, set_id, "n_shared", "n_items", "ratio")


def left_fill_min(d: DataFrame, values: DataFrame, key: str, value: str, factor: float) -> DataFrame:
    """d with `value` by key, the least value times `factor` where it is missing."""
    least = values.agg(F.min(value).alias("_m"))
    return d.join(values, key, "left").join(F.broadcast(least)).withColumn(value, F.coalesce(F.col(value), F.col("_m") * factor)).drop("_m")


def sample_exact(d: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """Exactly n rows (or all), chosen by a seeded hash of the key, alike on every run."""
    return d.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")


def all_pairs(d: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Unordered pairs a < b of a key's distinct values; meant for small catalogues, which is what asks for all pairs."""
    left, right = d.select(F.col(key).alias(a)).distinct(), d.select(F.col(key).alias(b)).distinct()
    return left.join(right, F.col(a) < F.col(b))


def insert_absent(new: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key the table lacks."""
    return new.join(table.select(*key).distinct(), key, "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of b that a lacks."""
    return b.subtract(a)


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return a.intersect(b)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either."""
    return a.unionByName(b).distinct()


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, repeats included."""
    return a.unionByName(b)


def key_counts(d: DataFrame, key: list[str], counted: str, ident: str) -> DataFrame:
    """(key, n_distinct, max_id, n)."""
    return d.groupBy(*key).agg(F.count_distinct(counted).alias("n_distinct"), F.max(ident).alias("max_id"), F.count(F.lit(1)).alias("n"))


def distinct_where(d: DataFrame, keep: Column, value: str) -> DataFrame:
    """Distinct values of the rows that satisfy `keep`."""
    return d.where(keep).select(value).distinct()


def top_rows(d: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by `order`."""
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def first_key(values: Column) -> Column:
    """The key of the least value of a map, ties to the smaller key."""
    return F.array_min(F.transform(F.map_entries(values), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))["key"]


def swapped(values: Column) -> Column:
    """A map with keys and values exchanged; of keys with one value the largest stays."""
    pairs = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["k"] != p["k"], F.lit(True)))
    return F.map_from_entries(last)
