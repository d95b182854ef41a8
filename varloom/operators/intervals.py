"""Interval joins and interval algebra.

Every join has an equi key: the sequence name, a level and a bin of the coordinate, so a range never becomes a Cartesian product.
An interval lives on the level whose bins are the smallest that are as long as itself, where it touches two bins at most, however long it
is; a point looks up one bin on each level that has intervals. Two intervals meet on the level of the longer one, where both touch
two bins at most, and a pair is emitted only in the bin of the later start. Rows with nested columns (exons, maps) stay out of the binned
tables: those hold coordinates alone, and the rows are joined to the matches. Coordinates are inclusive at both ends unless `bounds` says otherwise.
Joins are merge joins: Spark's estimate leaves out what bins, arrays and sequences add, so that a side it would send whole to the driver can be of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators import scan

#: Widths of the levels' bins; only intervals beyond the widest touch more than two.
WIDTHS = tuple(512 * 8**k for k in range(8))
_NESTED = ("array", "map", "struct", "binary", "variant")


def _bin(c: Column, size: int | Column) -> Column:
    return F.floor(c / (F.lit(size) if isinstance(size, int) else size)).cast("long")


def _level(start: Column, end: Column) -> Column:
    """The first level whose bins are as long as the interval."""
    return F.least(F.size(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w < end - start + 1)), F.lit(len(WIDTHS) - 1))


def _width(level: Column) -> Column:
    return F.get(F.array(*map(F.lit, WIDTHS)), level)


def _touched(start: Column, end: Column, level: Column) -> Column:
    return F.explode(F.sequence(_bin(start, _width(level)), _bin(end, _width(level))))


def binned(intervals: DataFrame, start: str, end: str, pad: int = 0) -> DataFrame:
    """Rows with _level and _bin, two for an interval at most; `pad` wider on both sides. Intervals that end before they start drop out."""
    lo, hi = F.col(start) - pad, F.col(end) + pad
    return intervals.where(F.col(start) <= F.col(end)).withColumn("_level", _level(lo, hi)).withColumn("_bin", _touched(lo, hi, F.col("_level")))


def levels(intervals: DataFrame, start: str, end: str, pad: int = 0) -> list[int]:
    """The levels that have intervals: as many values as there are widths, at most."""
    d = intervals.where(F.col(start) <= F.col(end)).select(_level(F.col(start) - pad, F.col(end) + pad).alias("level")).distinct()
    return sorted(r["level"] for r in d.collect() if r["level"] is not None)


def _wide(d: DataFrame) -> bool:
    return any(f.dataType.typeName() in _NESTED for f in d.schema.fields)


def _equal(columns: list[str], others: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(a) == F.col(b) for a, b in zip(columns, others, strict=True)))


def inside(pos: Column, start: Column, end: Column, bounds: str = "[]") -> Column:
    low = pos >= start if bounds[0] == "[" else pos > start
    return low & (pos <= end if bounds[1] == "]" else pos < end)


def _matches(points: DataFrame, intervals: DataFrame, chrom: str, pos: str, ichrom: str, start: str, end: str, bounds: str, pad: int, used: list[int], how: str = "inner") -> DataFrame:
    """Points joined to the intervals that hold them; other joins than inner ones take a single level, on which a point is one row."""
    if not used:
        used = [0]
    places = F.array(*[F.struct(F.lit(k).alias("level"), _bin(F.col(pos), WIDTHS[k]).alias("bin")) for k in used])
    left = points.withColumn("_rung", F.explode(places) if len(used) > 1 else F.get(places, F.lit(0)))
    right = binned(intervals, start, end, pad)
    held = inside(F.col(pos), F.col(start) - pad, F.col(end) + pad, bounds)
    meet = (F.col(chrom) == F.col(ichrom)) & (F.col("_rung.level") == F.col("_level")) & (F.col("_rung.bin") == F.col("_bin")) & held
    return left.join(right.hint("merge"), meet, how).drop("_rung", "_level", "_bin")


def point_join(points: DataFrame, intervals: DataFrame, chrom: str, pos: str, ichrom: str, start: str, end: str, bounds: str = "[]", how: str = "inner", pad: int = 0) -> DataFrame:
    """Points with the intervals that hold them (inner, left, left_semi, left_anti). Column names of the two sides must differ."""
    key, place = [ichrom, start, end], [chrom, pos]
    named = lambda columns: [f"_k{i}" for i, _ in enumerate(columns)]
    renamed = lambda d, columns: d.select(*[F.col(c).alias(n) for c, n in zip(columns, named(columns), strict=True)], *[c for c in d.columns if c not in columns])
    used = levels(intervals, start, end, pad)
    if not _wide(intervals) and len(used) < 2:
        return _matches(points, intervals, chrom, pos, ichrom, start, end, bounds, pad, used, how)
    if how == "inner" and not _wide(points):
        if not _wide(intervals):
            return _matches(points, intervals, chrom, pos, ichrom, start, end, bounds, pad, used)
        hit = renamed(_matches(points, intervals.select(*key).distinct(), chrom, pos, ichrom, start, end, bounds, pad, used), key)
        return hit.join(intervals.hint("merge"), _equal(named(key), key)).select(*points.columns, *intervals.columns)
    # What a point meets follows from its place, so that only distinct places are binned.
    places = points.select(*place).distinct()
    slim = intervals.select(*key).distinct() if _wide(intervals) or how in ("left_semi", "left_anti") else intervals
    hit = _matches(places, slim, chrom, pos, ichrom, start, end, bounds, pad, used)
    if how in ("left_semi", "left_anti"):
        hit = renamed(hit.select(*place).distinct(), place)
        return points.join(hit.hint("merge"), _equal(place, named(place)), how)
    if _wide(intervals):
        hit = renamed(hit, key).join(intervals.hint("merge"), _equal(named(key), key)).select(*place, *intervals.columns)
    return points.join(renamed(hit, place).hint("merge"), _equal(place, named(place)), how).select(*points.columns, *intervals.columns)


def overlap_join(a: DataFrame, b: DataFrame, achrom: str, astart: str, aend: str, bchrom: str, bstart: str, bend: str) -> DataFrame:
    """Pairs of intervals that share a position, each pair once."""
    akey, bkey = [achrom, astart, aend], [bchrom, bstart, bend]
    slim_a, slim_b = (d.select(*key).distinct() if _wide(d) else d for d, key in ((a, akey), (b, bkey)))
    used_a, used_b = levels(slim_a, astart, aend), levels(slim_b, bstart, bend)

    def seen(d: DataFrame, start: str, end: str, own: str, others: list[int]) -> DataFrame:
        """On its own level and on the wider ones where the other side has intervals."""
        at = _level(F.col(start), F.col(end))
        on = F.array_distinct(F.concat(F.array(at), F.filter(F.array(*map(F.lit, others)), lambda k: k > at)) if others else F.array(at))
        d = d.where(F.col(start) <= F.col(end)).withColumn(own, at).withColumn("_level", F.explode(on))
        return d.withColumn("_bin", _touched(F.col(start), F.col(end), F.col("_level"))).withColumnsRenamed({"_level": f"{own}_level", "_bin": f"{own}_bin"})

    left, right = seen(slim_a, astart, aend, "_a", used_b), seen(slim_b, bstart, bend, "_b", used_a)
    meet = (F.col(achrom) == F.col(bchrom)) & (F.col("_a_level") == F.col("_b_level")) & (F.col("_a_bin") == F.col("_b_bin"))
    once = F.col("_a_bin") == _bin(F.greatest(F.col(astart), F.col(bstart)), _width(F.col("_a_level")))
    both = meet & once & (F.col(astart) <= F.col(bend)) & (F.col(bstart) <= F.col(aend))
    # Rows that are only visiting a level never meet one another there.
    hit = left.where("_a = _a_level").join(right.hint("merge"), both)
    if used_a and used_b and used_a[0] < used_b[-1]:  # some of a are shorter than some of b
        hit = hit.unionByName(left.where("_a < _a_level").join(right.where("_b = _b_level").hint("merge"), both))
    hit = hit.drop("_a", "_b", "_a_level", "_b_level", "_a_bin", "_b_bin")
    for d, key, wide in ((a, akey, _wide(a)), (b, bkey, _wide(b))):
        if wide:
            names = [f"_k{i}" for i, _ in enumerate(key)]
            hit = hit.withColumnsRenamed(dict(zip(key, names, strict=True))).join(d.hint("merge"), _equal(names, key)).drop(*names)
    return hit.select(*a.columns, *b.columns)


def nearest(points: DataFrame, sites: DataFrame, chrom: str, pos: str, schrom: str, spos: str, label: str, within: int) -> DataFrame:
    """points with previous_<label> (largest spos before pos) and next_<label> (smallest after it), `within` at most, ties to the largest label.

    Sites are shared with both neighbouring bins of `within` width, so that a window holds one bin and not a whole sequence.
    """
    keys = [F.col(schrom).alias("_c"), F.col(spos).alias("_p"), F.col(label).alias("_l")]
    around = sites.select(*keys).withColumn("_b", F.explode(F.array(*[_bin(F.col("_p"), within) + d for d in (-1, 0, 1)])))
    rows = points.withColumn("_row", F.struct(*[F.col(c) for c in points.columns]))
    rows = rows.select(F.col(chrom).alias("_c"), F.col(pos).alias("_p"), _bin(F.col(pos), within).alias("_b"), "_row")
    site = F.struct(F.col("_p").alias("p"), F.col("_l").alias("l"))
    both = rows.withColumn("_s", F.lit(None).cast(around.select(site.alias("s")).schema[0].dataType)).unionByName(around.select("_c", "_p", "_b", site.alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy("_c", "_b").orderBy("_p")
    before = F.max("_s").over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s.p").alias("p")))).over(w.rangeBetween(1, Window.unboundedFollowing))
    found = both.withColumn("_before", before).withColumn("_after", after).where(F.col("_row").isNotNull())
    at_next = sites.groupBy(F.col(schrom).alias("_nc"), F.col(spos).alias("_np")).agg(F.max(label).alias("_nl"))
    found = found.join(at_next.hint("merge"), (F.col("_c") == F.col("_nc")) & (F.col("_after.p") == F.col("_np")), "left")
    near = lambda p, v: F.when(F.abs(p - F.col("_p")) <= within, v)
    return found.select("_row.*", near(F.col("_before.p"), F.col("_before.l")).alias(f"previous_{label}"), near(F.col("_after.p"), F.col("_nl")).alias(f"next_{label}"))


def best_score(points: DataFrame, intervals: DataFrame, key: list[str], chrom: str, pos: str, ichrom: str, start: str, end: str, score: str) -> DataFrame:
    """Per point the largest positive score of the intervals over it; points without one drop out."""
    hit = point_join(points, intervals.where(F.col(score) > 0), chrom, pos, ichrom, start, end)
    return hit.groupBy(*key).agg(F.max(score).alias(score))


def flanks(points: DataFrame, targets: DataFrame, chrom: str, pos: str, ichrom: str, start: str, end: str, pad: int) -> DataFrame:
    """Points near padded targets, with place (core, 5p, 3p) and distance (0 in the core)."""
    hit = point_join(points, targets, chrom, pos, ichrom, start, end, pad=pad)
    before, after = F.col(pos) < F.col(start), F.col(pos) > F.col(end)
    hit = hit.withColumn("place", F.when(before, "5p").when(after, "3p").otherwise("core"))
    return hit.withColumn("distance", F.when(before, F.col(start) - F.col(pos)).when(after, F.col(pos) - F.col(end)).otherwise(0).cast("long"))


def merge(intervals: DataFrame, chrom: str, start: str, end: str, parts: int | None = None) -> DataFrame:
    """Islands (chrom, start, end, n) of intervals that touch: the next start is at most the running end.

    Equal intervals are counted first; the running end goes over partitions by scan.running(), so no task sees a whole sequence. An island bears its first start.
    """
    d = intervals.groupBy(chrom, start, end).agg(F.count(F.lit(1)).alias("n"))
    d = scan.dealt(d, [chrom], [start, end], parts)
    d = scan.running(d, [chrom], [start, end], "_reach", F.col(end), "max", inclusive=False)
    new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    d = scan.running(d, [chrom], [start, end], "_first", new, "max")
    return d.groupBy(chrom, "_first").agg(F.max(end).alias(end), F.sum("n").alias("n")).select(chrom, F.col("_first").alias(start), end, "n")


def intersect(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct<start, end> that two intervals share, null if none."""
    return F.when((s1 <= e2) & (s2 <= e1), F.struct(F.greatest(s1, s2).alias("start"), F.least(e1, e2).alias("end")))


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e2 <= e1)


def has_region(points: DataFrame, regions: DataFrame, chrom: str, pos: str, name: str = "has_region") -> DataFrame:
    """points with whether any region (rchrom, rstart, rend) holds them."""
    key = [c for c in points.columns]
    hit = point_join(points, regions, chrom, pos, "rchrom", "rstart", "rend", how="left_semi").select(*key, F.lit(True).alias(name)).distinct()
    return points.join(hit, key, "left").fillna({name: False})


def domain_texts(variants: DataFrame, domains: DataFrame, row: str, chrom: str, start: str, end: str) -> DataFrame:
    """(row, descriptions): the distinct descriptions, sorted, of the domains (dchrom, dstart, dend, description) that a variant overlaps."""
    hit = overlap_join(variants, domains, chrom, start, end, "dchrom", "dstart", "dend")
    return hit.groupBy(row).agg(F.array_sort(F.collect_set("description")).alias("descriptions"))


def liftover(points: DataFrame, chain: DataFrame, chrom: str, pos: str) -> DataFrame:
    """points moved through chain blocks (from_chrom, from_start, from_end, to_chrom, to_start, to_strand): to_chrom, to_pos.

    Blocks are inclusive; on '-' blocks to_start is the target of from_end. Points outside of all blocks get nulls.
    """
    hit = point_join(points, chain, chrom, pos, "from_chrom", "from_start", "from_end", how="left")
    ahead, back = F.col(pos) - F.col("from_start"), F.col("from_end") - F.col(pos)
    moved = F.col("to_start") + F.when(F.col("to_strand") == "-", back).otherwise(ahead)
    return hit.select(*points.columns, "to_chrom", moved.alias("to_pos"))
