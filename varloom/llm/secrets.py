r"""Secret scans with native functions only.

Three base patterns find assignments, access keys and long hex strings, leftmost and not
overlapping. On top of them, candidate strings (runs of one character class) are scanned with a sliding
window whose Shannon entropy is kept up by incremental counts: a step adds one character and takes one
off, and only the two counts that change touch the sum of c log2 c. A candidate's span reaches
from its first to its last window over the class's threshold.

What is known is cut out first: base matches and the words of the allow-list (KNOWN). Candidates are runs in what
is left between, so a known part hides itself and not the secret beside it. Candidates that the allow-list's
whole patterns (ALLOW) match are suppressed.

Spans are (kind, start, end), in code points, end exclusive. Null and empty texts have none. Repeated
rows are each scanned, a null id stays null, other columns are never looked at, an empty table
gives an empty result. Nothing is shuffled: each text is scanned where it is read. Places of n matches
take n^(4/3) steps: they are summed up in lots, as a native fold copies what it has gathered at each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.text import id_and_text

#: Kinds and patterns, fixed values. For access and hex the least length is part of the pattern: a run is matched whole
#: or not at all, so it keeps the same matches. An assignment that is too short still uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")

#: Character classes: kind, candidates, alphabet, bits of entropy that a window must reach.
WINDOW = 24
CLASSES = (
    ("entropy_hex", "[0-9A-Fa-f]{24,}", "0123456789ABCDEFabcdef", 3.0),
    ("entropy_base64", "[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
#: Candidates that aren't secrets: without a digit, without a letter, UUIDs.
ALLOW = (
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
#: Placeholders and alphabets, in either case, that are cut out of candidates.
KNOWN = ("example", "sample", "dummy", "changeme", "placeholder", "your_", "xxxx", "abcdefgh", "01234567", "12345678")
SPAN = "array<struct<start: int, ord: int, kind: string, end: int>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _bound(value: Column, f) -> Column:
    """f(value), worked out once: the lambda of a one-element transform binds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ends(sizes: Column) -> Column:
    """The running sums of an array<int>, in lots, then over the lots' totals."""
    none = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    add = lambda at, x: F.concat(at, F.array(last(at) + x))

    def lots(a: Column) -> Column:
        lot = F.ceil(F.pow(F.size(a) * 2, F.lit(1 / 3))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(a), lot), lambda i: F.aggregate(F.slice(a, i, lot), none, add))
        return _bound(parts, lambda p: _bound(F.aggregate(F.transform(p, last), F.array(F.lit(0)), add), lambda t: F.flatten(F.zip_with(p, F.slice(t, F.lit(1), F.size(p)), lambda one, before: F.transform(one, lambda x: x + before)))))

    return _bound(sizes, lambda a: F.when(F.size(a) == 0, none).otherwise(lots(a)))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of a pattern's matches; the gaps between them come from the same matcher."""
    none = F.array().cast("array<struct<start: int, end: int>>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(_matches(text, pattern), F.length)

    def places(n: Column) -> Column:
        # The last gap has no match after it.
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(n)), n, lambda g, m: g + m)
        return F.zip_with(_ends(both), n, lambda e, m: F.struct((e - m).alias("start"), e.alias("end")))

    return F.when(text.rlike(pattern), _bound(sizes, places)).otherwise(none)


def _spans(places: Column, kind: str, order: int) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), p["end"].alias("end"))).cast(SPAN)


def _hot(candidate: Column, alphabet: str, threshold: float, window: int) -> Column:
    """struct<first, last>: 1-based ends of the first window over the threshold and the last, 0 if there is none."""
    codes = F.transform(F.split(candidate, ""), lambda ch: F.position(ch, F.lit(alphabet)))
    weigh = F.array(*[F.lit(0.0)], *[F.lit(c).cast("double") * F.log2(F.lit(float(c))) for c in range(1, window + 2)])

    def run(codes: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            # The window that ended at i - 1 is judged, then character i enters and character i - window leaves.
            new, old = F.get(codes, i - 1), F.coalesce(F.get(codes, i - 1 - window), F.lit(0))
            entropy = F.log2(F.lit(float(window))) - at["sum"] / F.lit(float(window))
            hot = (i > window) & (entropy >= threshold)
            up, down = F.get(at["counts"], new), F.get(at["counts"], old)
            grown = F.get(weigh, up + 1) - F.get(weigh, up)
            shrunk = F.when(old > 0, F.get(weigh, down) - F.get(weigh, down - 1)).otherwise(F.lit(0.0))
            counts = F.transform(at["counts"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when((k == old) & (old > 0), 1).otherwise(0))
            return F.struct(
                counts.alias("counts"),
                F.when(new == old, at["sum"]).otherwise(at["sum"] + F.coalesce(grown, F.lit(0.0)) - shrunk).alias("sum"),
                F.when(hot & (at["first"] == 0), i - window).otherwise(at["first"]).alias("first"),
                F.when(hot, i - 1).otherwise(at["last"]).alias("last"),
            )

        start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.length(candidate) + 1), start, step, lambda at: F.struct(at["first"].alias("first"), at["last"].alias("last")))

    return _bound(codes, run)


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def cut_pattern(known: tuple[str, ...] = KNOWN) -> str:
    """What is cut out before candidates are looked for: whole base matches, and the allow-list's words."""
    assign = ASSIGN.removeprefix("(?i)")
    for word in ("password", "passwd", "secret", "token", "api_?key"):
        assign = assign.replace(word, _either_case(word), 1)
    assign = assign.replace("([A-Za-z0-9+/_.=-]+)", f"[A-Za-z0-9+/_.=-]{{{ASSIGN_LEAST},}}").replace("(", "(?:")
    return "|".join([assign, ACCESS, HEX, *map(_either_case, known)])


def _pieces(text: Column, cut: str) -> Column:
    """array<struct<text, start>>: what lies between the matches of `cut`."""
    parts, sizes = F.split(text, cut, -1), F.transform(_matches(text, cut), F.length)

    def placed(p: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), _ends(F.zip_with(F.transform(F.slice(p, F.lit(1), F.size(p) - 1), F.length), sizes, lambda a, b: a + b)))
        return F.zip_with(p, starts, lambda t, s: F.struct(t.alias("text"), s.alias("start")))

    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("start")))
    return F.when(text.rlike(cut), _bound(parts, placed)).otherwise(whole)


def _entropy_spans(pieces: Column, kind: str, order: int, pattern: str, alphabet: str, threshold: float, window: int, allow: tuple[str, ...]) -> Column:
    benign = "|".join(f"(?:{a})" for a in allow) or "(?!)"

    def of(piece: Column) -> Column:
        found = F.zip_with(_matches(piece["text"], pattern), _places(piece["text"], pattern), lambda m, p: F.struct(m.alias("text"), (p["start"] + piece["start"]).alias("start")))
        hot = F.transform(F.filter(found, lambda c: ~c["text"].rlike(benign)), lambda c: F.struct(c["start"].alias("start"), _hot(c["text"], alphabet, threshold, window).alias("hot")))
        return F.transform(F.filter(hot, lambda c: c["hot"]["last"] > 0), lambda c: F.struct((c["start"] + c["hot"]["first"] - 1).alias("start"), (c["start"] + c["hot"]["last"]).alias("end")))

    return _spans(F.flatten(F.transform(F.filter(pieces, lambda p: p["text"].rlike(pattern)), of)), kind, order)


def scan(docs: DataFrame, window: int = WINDOW, classes: tuple = CLASSES, allow: tuple[str, ...] = ALLOW, known: tuple[str, ...] = KNOWN) -> DataFrame:
    """doc_id, base and added: arrays of (start, ord, kind, end), each sorted by start, then kind in the order listed."""
    text, none = F.col("text"), F.array().cast(SPAN)
    assign = F.filter(F.zip_with(_places(text, ASSIGN), _matches(text, ASSIGN, 2), lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.length(v).alias("size"))), lambda p: p["size"] >= ASSIGN_LEAST)
    base = F.concat(
        F.when(text.rlike(ASSIGN), _spans(assign, "assign", 0)).otherwise(none),
        F.when(text.contains("AKIA"), _spans(_places(text, ACCESS), "access", 1)).otherwise(none),
        _spans(_places(text, HEX), "hex", 2),
    )
    more = lambda pieces: F.array_sort(F.concat(*[_entropy_spans(pieces, kind, len(BASE) + i, pattern, alphabet, bits, window, allow) for i, (kind, pattern, alphabet, bits) in enumerate(classes)]))
    some = "|".join(pattern for _, pattern, _, _ in classes)
    added = F.when(text.rlike(some), _bound(_pieces(text, cut_pattern(known)), more)).otherwise(none) if classes else none
    return id_and_text(docs).select("doc_id", F.array_sort(base).alias("base"), added.alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
