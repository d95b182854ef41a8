import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from varloom.llm import quality

LONG = "a b c d e f g h " * 2000
ODD = [
    (1, None, "en"),
    (2, "", None),
    (3, " \t\n\x0b\x0c\r ", "en"),
    (4, "one", "en"),
    (4, "one", "en"),
    (None, "null id " * 30, None),
    (5, "é 東京 😀 # * $ % & | < > x#y", "fr"),
    (6, "same line\nsame line\n same line\n\n\nother\nsame line", "en"),
    (7, LONG, "en"),
    (8, "A b c d e f g H i j " + "u v w x y z 1 2 " + "mid dle " + "u v w x y z 1 2 3", "en"),
    (9, "w " * 16, "en"),
    (10, "no\x1cbreak no\xa0break no\x85break", "de"),
    (11, "x y x y x y x y x", "de"),
]


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 3000 else set(grams)
    hit = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 8)}
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "k", 1) for i, t, g in rows], "doc_id long, text string, lang string, stratum string, n_words long")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts_equal_brute_force(spark):
    got = quality.signals(frame(spark, ODD)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(t))) for i, t, _ in ODD)


def test_base_counts_of_random_words(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice("abc") + draw.choice([" ", " ", "\n", "\t", "  "]) for _ in range(draw.randint(0, 120))), "en") for i in range(300)]
    got = {r[0]: tuple(r[1:]) for r in quality.signals(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


@pytest.mark.parametrize("risk,p", [(0.05, 0.05), (0.05, 0.0125), (0.3, 0.01), (0.5, 0.4)])
def test_most_allowed_is_the_exact_binomial_bound(spark, risk, p):
    sizes = [0, 1, 13, 58, 59, 90, 200, 701, 3000]
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", quality.most_allowed(F.col("n"), risk, F.lit(p)).alias("k")).collect()}
    q, level = Fraction(str(risk)), Fraction(str(p))
    for n in sizes:
        tail, best = Fraction(0), -1
        for k in range(n):
            tail += math.comb(n, k) * q**k * (1 - q) ** (n - k)
            if tail > level:
                break
            best = k
        assert got[n] == best, n


def test_most_allowed_of_a_large_holdout(spark):
    # The normal approximation is near at this size: mean - 1.6449 sd.
    n = 10**9
    k = spark.range(1).select(quality.most_allowed(F.lit(n), 0.05, F.lit(0.05)).alias("k")).first().k
    assert abs(k - (n * 0.05 - 1.6448536 * math.sqrt(n * 0.05 * 0.95))) < 10


def corpus(n, seed, noise):
    draw = random.Random(seed)
    rows, told = [], []
    for i in range(n):
        bad = draw.random() < 0.3
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 6))) for _ in range(60)]
        if bad or draw.random() < noise:
            words = [w + "##" for w in words]
        rows.append((i, " ".join(words), "en" if i % 4 else "xx"))
        told.append((i, 0 if bad else 1, 0))
    return rows, told


def test_rules_reject_what_labels_call_bad(spark):
    rows, told = corpus(1200, 1, 0.0)
    got = {r.doc_id: r.kept for r in quality.rate(frame(spark, rows), labels(spark, told)).collect()}
    assert got == {i: bool(q) for i, q, _ in told}


def test_false_rejections_stay_under_the_limit(spark):
    # A tenth of the good texts look bad: a cutoff that catches the bad ones would break the limit, so none is taken.
    rows, told = corpus(1200, 2, 0.1)
    found = quality.signals(frame(spark, rows))
    for levels in (quality.LEVELS, ((0, 0.5),)):
        cutoffs = quality.calibrate(found, labels(spark, told), levels=levels)
        assert all(set(r.cuts) == {0} for r in cutoffs.collect())
        assert all(r.kept for r in quality.judge(found, cutoffs).collect())
    # The design half alone would have taken a cutoff: the holdout refuses it.
    assert all(r.level == 0 and r.false_rejections[0] > r.allowed for r in cutoffs.collect())


def test_few_labels_reject_nothing_and_copies_are_one_trial(spark):
    rows, told = corpus(60, 3, 0.0)
    same = [(1000 + i, rows[0][1] if told[0][1] else "good words here and there " * 1, "en") for i in range(500)]
    more = [(i, 1, 0) for i, _, _ in same]
    out = quality.calibrate(quality.signals(frame(spark, rows + same)), labels(spark, told + more)).collect()
    assert all(r.level == 0 and r.n_good < 60 for r in out)


def test_odd_rows_and_empty_tables(spark):
    some = labels(spark, [(1, 1, None), (None, 1, 1), (4, None, 0), (5, 7, 0), (7, 1, 0), (7, 0, 0)])
    out = quality.rate(frame(spark, ODD), some)
    assert out.count() == len(ODD) and out.where("kept is null").count() == 0
    none = labels(spark, [])
    assert quality.rate(frame(spark, []), none).collect() == []
    assert quality.rate(frame(spark, ODD), none).where("kept").count() == sum(not brute(t)[-1] for _, t, _ in ODD)


def test_plan_has_no_python(spark):
    plan = quality.rate(frame(spark, ODD), labels(spark, [(1, 1, 0)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
