r"""Quality rules with native functions only, and cutoffs whose false rejections are bounded.

Words are what ASCII white space parts, lines what \n parts. Two base rules are fixed: BASE_WORDS words at least, and
BASE_REPEATED percent of the words at most in windows of WINDOW words that the text holds twice or more. All other rules compare
a share with a cutoff that labelled documents choose, for each stratum (language) by itself:

1. Each distinct labelled text that passes the base rules is one trial; the first hex digit of its MD5 puts it into the
   design half or the holdout, so that copies never stand on both sides. A text with any label 0 counts as bad.
2. In the design half, each rule and level (margin, share) of LEVELS takes, among the grid's cutoffs whose `margin`th stricter neighbour
   rejects at most that share of good texts, the one whose rejected share of bad texts exceeds that of good ones most (none, if none
   does). Levels are nested: a higher one rejects all that a lower one does.
3. In the holdout, level by level, the good texts that any rule rejects are k of n. A level holds while the exact binomial tail
   P(Bin(n, ALPHA) <= k) is at most DELTA / strata: a fixed sequence of tests within a stratum, Bonferroni over strata. The
   highest level reached gives the stratum's cutoffs; where not even the lowest holds (too few labels), the rules reject nothing.

So with probability 1 - DELTA at least, in every stratum at once, the rules reject at most a share of ALPHA of the good
texts that pass the base rules. The largest k that holds is worked out once for a stratum: the binomial's terms are
summed from 12 standard deviations below the mean, under which less than 1e-30 lies, in double precision.

Windows are compared by 64-bit hashes within their text: of n windows n^2 / 2^65 pairs are expected to agree by chance.

Null text has no words; null languages are a stratum of their own. Texts without a word have shares of 0. Labels that are neither 0 nor 1,
or that have a null doc_id, are not used. Repeated rows are each judged, a null doc_id stays, other columns are never looked at, an empty
table gives an empty result. Only numbers about texts are shuffled or written; a long text is one row where it is read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.storage import materialize

#: Fixed values.
BASE_WORDS, BASE_REPEATED, WINDOW = 20, 30, 8
SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

ALPHA, DELTA = 0.05, 0.05
LEVELS = ((2, 0.0), (1, 0.0), (0, 0.0), (0, 0.0025), (0, 0.005), (0, 0.01))
#: Rules: a name, numerator and denominator of a share that is high in bad texts, and cutoffs from the loosest to the strictest;
#: a text is rejected at a cutoff that its share reaches.
RULES = (
    ("symbols", "n_symbols", "n_words", (2.0, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)),
    ("marks", "n_marks", "n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05)),
    ("capitals", "n_capitals", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("repeats", "n_repeat_words", "n_words", (0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)),
    ("lines", "n_dup_lines", "n_lines", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("long_words", "word_chars", "n_words", (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
    ("short_words", "n_words", "word_chars", (0.9, 0.7, 0.5, 0.4, 0.35, 0.3, 0.28, 0.26)),
)
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")


def _matched(text: Column, pattern: str) -> Column:
    """Characters in matches of a pattern of ASCII characters."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern + "+", ""))).cast("long")


def _bound(value: Column, f) -> Column:
    """f(value), worked out once: the lambda of a one-element transform binds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _words(text: Column) -> Column:
    """What SEPARATOR parts; spaces and line ends are split at as they are, the rarer separators are made spaces first."""
    rare = "\t\x0b\f\r"
    some = F.contains(text, F.lit(rare[0]))
    for c in rare[1:]:
        some = some | F.contains(text, F.lit(c))
    plain = F.replace(F.when(some, F.translate(text, rare, " " * len(rare))).otherwise(text), F.lit("\n"), F.lit(" "))
    return F.array_remove(F.split(plain, " ", -1), "")


def _windows(words: Column, size: int) -> Column:
    """Hashes of all windows of `size` words, none if there are fewer words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _again(hashes: Column) -> Column:
    """Elements that are equal to an earlier one."""
    return _bound(hashes, lambda h: F.size(h) - F.size(F.array_distinct(h)))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = lambda p, f: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), f)
    none = F.array().cast("array<int>")
    twins = _bound(placed, lambda p: pairs(p, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none)))
    places = F.sort_array(F.array_distinct(F.flatten(twins)))
    return _bound(places, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(pairs(p, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda total, x: total + x)))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, the MD5 of the text, SIGNALS (all long) and base_failed, of whole texts."""
    text = F.col("text")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({"words": _words(text), "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # A window that comes again holds WINDOW - 3 of four words that come again, one after the other: most texts have no such number.
    suspect = _again(_windows(F.col("words"), 4)) >= WINDOW - 3
    repeated = F.when(suspect, _covered(_windows(F.col("words"), WINDOW))).otherwise(F.lit(0))
    found = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": _matched(text, SYMBOLS),
        "n_dup_lines": _again(F.col("lines")).cast("long"),
        "n_repeat_words": repeated.cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_marks": (F.octet_length(text) - F.octet_length(F.replace(F.replace(text, F.lit("!"), F.lit("")), F.lit("?"), F.lit("")))).cast("long"),
        "n_capitals": _matched(text, "[A-Z]"),
    }
    d = d.select("doc_id", "stratum", F.md5(text.cast("binary")).alias("text_md5"), *[c.alias(n) for n, c in found.items()])
    return d.withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words")))


def share(top: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(top).cast("double") / F.col(under)).otherwise(F.lit(0.0))


def first_cutoff(rules: tuple = RULES) -> Column:
    """array<int> by rule: the number, from 1, of the loosest cutoff that rejects the text; one past the grid if none does."""

    def of(value: Column, cuts: tuple[float, ...]) -> Column:
        # Cutoffs fall, so those above the share come first.
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > value)) + 1

    return F.array(*[of(share(top, under), cuts) for _, top, under, cuts in rules])


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, and the eight factors taken off again."""
    z, small = x + 8, F.lit(1.0)
    for i in range(8):
        small = small * (x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(small)


def most_allowed(n: Column, risk: float, p: Column) -> Column:
    """The largest k with P(Bin(n, risk) <= k) <= p, exact; -1 if there is none. p is below a half."""
    n, mean = n.cast("double"), n.cast("double") * risk
    low = F.greatest(F.lit(0.0), F.floor(mean - 12 * F.sqrt(mean) - 40))
    start = _log_gamma(n + 1) - _log_gamma(low + 1) - _log_gamma(n - low + 1) + low * math.log(risk) + (n - low) * math.log1p(-risk)

    def step(at: Column, i: Column) -> Column:
        total = at["total"] + F.exp(at["term"])
        return F.struct((at["term"] + F.log((n - i) / (i + 1)) + math.log(risk / (1 - risk))).alias("term"), total.alias("total"), F.when(total <= p, i).otherwise(at["best"]).alias("best"))

    none = F.struct(start.alias("term"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("best"))
    places = F.sequence(low.cast("long"), F.greatest(low, F.least(F.ceil(mean), n - 1)).cast("long"))
    return F.when(n > 0, F.aggregate(places, none, step, lambda at: at["best"])).otherwise(F.lit(-1).cast("long"))


def trials(found: DataFrame, labels: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per stratum and distinct labelled text that passes the base rules: stratum, good, design, firsts."""
    told = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = found.where(~F.col("base_failed")).join(told, "doc_id").select("stratum", "text_md5", "label", first_cutoff(rules).alias("firsts"))
    texts = rows.groupBy("stratum", "text_md5").agg(F.min("label").alias("label"), F.min("firsts").alias("firsts"))
    return texts.select("stratum", (F.col("label") == 1).alias("good"), F.substring("text_md5", 1, 1).isin(*"02468ace").alias("design"), "firsts")


def _paths(design: DataFrame, rules: tuple, levels: tuple[tuple[int, float], ...]) -> DataFrame:
    """stratum, path: for each rule the number of the cutoff at each level, 0 for none."""
    sizes = design.groupBy("stratum").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    # The arrays' sums over cutoffs are the counts of texts rejected at each of them: 2 numbers for each cutoff of a stratum.
    hits = [F.struct(F.lit(r).alias("rule"), F.lit(j).alias("cut"), F.get(F.col("firsts"), F.lit(r)).alias("first")) for r, (_, _, _, cuts) in enumerate(rules) for j in range(1, len(cuts) + 1)]
    by = design.select("stratum", "good", F.explode(F.array(*hits)).alias("hit")).where("hit.first <= hit.cut")
    by = by.groupBy("stratum", "hit.rule", "hit.cut").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    by = by.join(sizes.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")))
    # The windows hold one rule's cutoffs.
    stricter = Window.partitionBy("stratum", "rule").orderBy("cut")
    by = by.withColumns({f"good_{m}": F.lead("good", m).over(stricter) for m in sorted({m for m, _ in levels})})
    by = by.withColumn("gain", F.col("bad") * F.col("n_good") - F.col("good") * F.col("n_bad")).where("gain > 0")
    best = [F.max(F.when(F.col(f"good_{m}") <= F.lit(t) * F.col("n_good"), F.struct(F.col("gain"), (-F.col("cut")).alias("cut")))) for m, t in levels]
    best = by.groupBy("stratum", "rule").agg(F.array(*[F.coalesce(-b["cut"], F.lit(0)) for b in best]).alias("cuts"))
    best = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cuts"))).alias("by_rule"))
    none = F.array(*[F.lit(0)] * len(levels))
    return best.select("stratum", F.transform(F.array(*map(F.lit, range(len(rules)))), lambda r: F.coalesce(F.try_element_at("by_rule", r), none)).alias("path"))


def calibrate(found: DataFrame, labels: DataFrame, rules: tuple = RULES, levels: tuple[tuple[int, float], ...] = LEVELS, alpha: float = ALPHA, delta: float = DELTA, **names: str) -> DataFrame:
    """Per stratum with labels: n_good of the holdout, allowed, false_rejections by level, level (0: none holds) and cuts, the number of each rule's cutoff (0: none)."""
    told = materialize(trials(found, labels, rules, **names), "quality-trials")
    paths = materialize(_paths(told.where("design"), rules, levels), "quality-paths")
    hold = told.where(~F.col("design") & F.col("good"))
    paths = paths.withColumnRenamed("stratum", "of")
    same = F.col("stratum").eqNullSafe(F.col("of"))
    ours = hold.join(paths, same, "left")
    rejects = lambda t: F.exists(F.arrays_zip("firsts", "path"), lambda x: x["firsts"] <= F.get(x["path"], F.lit(t)))
    counts = ours.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), F.array(*[F.count_if(F.coalesce(rejects(t), F.lit(False))) for t in range(len(levels))]).alias("false_rejections"))
    total = counts.agg(F.count(F.lit(1)).alias("strata"))  # one row
    counts = counts.crossJoin(F.broadcast(total)).withColumn("allowed", most_allowed(F.col("n_good"), alpha, F.lit(delta) / F.col("strata")))
    # Rejections grow with the level, so the levels that hold are the first ones.
    held = counts.withColumn("level", F.size(F.filter("false_rejections", lambda k: k <= F.col("allowed"))))
    cuts = F.transform("path", lambda p: F.when(F.col("level") > 0, F.get(p, F.col("level") - 1)).otherwise(F.lit(0)))
    out = held.join(paths, same, "left").select("stratum", "n_good", "allowed", "false_rejections", "level", F.coalesce(cuts, F.array(*[F.lit(0)] * len(rules))).alias("cuts"))
    return materialize(out, "quality-cutoffs")


def judge(found: DataFrame, cutoffs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """found, with `failed`, the names of the calibrated rules that reject the text, and kept."""
    chosen = cutoffs.select(F.col("stratum").alias("of"), "cuts")
    # Both are written tables: a small one of cutoffs is sent to all, a large one meets the texts with hot strata split.
    d = found.join(chosen, F.col("stratum").eqNullSafe(F.col("of")), "left")
    names = F.array(*[F.lit(r[0]) for r in rules])
    fired = F.filter(F.arrays_zip(names.alias("name"), first_cutoff(rules).alias("first"), F.col("cuts")), lambda x: x["first"] <= x["cuts"])
    failed = F.coalesce(F.array_join(F.transform(fired, lambda x: x["name"]), ","), F.lit(""))
    return d.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")).drop("of", "cuts")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, stratum, SIGNALS, base_failed, failed, kept."""
    found = materialize(signals(docs), "quality-signals")
    return judge(found, calibrate(found, labels)).drop("text_md5")
