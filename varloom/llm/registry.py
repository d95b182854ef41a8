"""The opN_ queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import alignment, ann, chat, codes, exact_dedup, lm_score, mixing, quality, secrets, sentencepiece, simhash, toxicity, warc
from varloom.llm.ship import shipped


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("mean_log10", 5).alias("mean_log10"), "seen_3", "seen_2", "seen_1", "seen_0")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), temperature=0.5, epochs=1.0)
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.round("rate_mix", 6).alias("rate"), F.col("copy_mix").cast("long").alias("copy_no"), F.col("key_mix").alias("order_key"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(_table(spark, sf_dir, "documents"), n_best=2)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    counts = [secrets.count(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.BASE]
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    out = exact_dedup.deduplicate_by_parts(_table(spark, sf_dir, "documents"), index)
    index.close()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(index, index._varloom_warc, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "<|im_end|><|im_start|>assistant ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.render(chat.fold(chat.events(turns.unionByName(extra), revised=True))))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: shipped(f) for f in (op1_lm_score, op2_mix_sources, op3_sentencepiece, op4_secrets, op5_hnsw, op6_toxicity, op7_exact_dedup, op8_simhash, op9_warc, op10_chat_format, op11_quality_rules, op12_token_alignment, op13_vector_codes)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _found_sql(rows: str, keys: str, kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Matches in the texts x of `rows`, each with its start, from the lengths of what lies between them, and its text."""
    return f"""SELECT {keys}, '{kind}' AS kind, {order} AS ord, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: length(v[i]) >= {least}), lambda i: {{'s': CAST(list_sum(list_transform(g[1:i], lambda y: length(y)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT), 'm': m[i]}})) AS h
        FROM (SELECT {keys}, regexp_split_to_array(x, '{pattern}') AS g, regexp_extract_all(x, '{pattern}', 0) AS m, regexp_extract_all(x, '{pattern}', {group}) AS v FROM {rows})"""


def _secrets_sql() -> str:
    """Base matches; then what lies between the matches of the cut pattern, candidates in it, and entropy counted anew for every window."""
    either = secrets._either_case
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    assign = rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    base = " UNION ALL ".join(_found_sql("t", "doc_id", *k) for k in (("assign", 0, assign, 2, 8), ("access", 1, "AKIA([A-Z0-9]+)", 0, 16), ("hex", 2, "([0-9a-f]+)", 0, 32)))
    cand = " UNION ALL ".join(_found_sql("pieces", "doc_id, off", kind, 3 + i, f"({pattern.rpartition('{')[0]}+)", 0, secrets.WINDOW) for i, (kind, pattern, _, _) in enumerate(secrets.CLASSES))
    allow = " OR ".join(f"regexp_matches(h.m, '{a}')" for a in secrets.ALLOW)
    cut = secrets.cut_pattern().replace("'", "''")
    limit = " ".join(f"WHEN '{kind}' THEN {bits}" for kind, _, _, bits in secrets.CLASSES)
    text = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR)"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), base AS (SELECT doc_id, kind, ord, h.s AS s, h.s + length(h.m) AS e FROM ({base})),
        pieces AS (SELECT doc_id, unnest(g) AS x, unnest(list_transform(range(1, len(g) + 1), lambda i: CAST(coalesce(list_sum(list_transform(g[1:i - 1], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT))) AS off
            FROM (SELECT doc_id, regexp_split_to_array(x, '{cut}') AS g, regexp_extract_all(x, '{cut}', 0) AS m FROM t)),
        cand AS (SELECT doc_id, kind, ord, off + h.s AS s, h.m AS m FROM ({cand}) WHERE NOT ({allow})),
        w AS (SELECT doc_id, kind, ord, s, w, substr(m, w, {secrets.WINDOW}) AS part FROM (SELECT *, unnest(range(1, length(m) - {secrets.WINDOW} + 2)) AS w FROM cand)),
        ch AS (SELECT doc_id, kind, ord, s, w, c, count(*) AS n FROM (SELECT doc_id, kind, ord, s, w, unnest(string_split(part, '')) AS c FROM w) GROUP BY ALL),
        hot AS (SELECT doc_id, kind, ord, s, w FROM ch GROUP BY ALL HAVING -sum(n / {secrets.WINDOW}.0 * log2(n / {secrets.WINDOW}.0)) >= CASE kind {limit} END - 1e-12),
        added AS (SELECT doc_id, kind, ord, s + min(w) - 1 AS s, s + max(w) - 1 + {secrets.WINDOW} AS e FROM hot GROUP BY doc_id, kind, ord, hot.s),
        every AS (SELECT doc_id, kind, ord, s, e FROM base UNION ALL SELECT doc_id, kind, ord, s, e FROM added)
        SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            sha256(coalesce(string_agg({text}, ',' ORDER BY s, ord) FILTER (ord < 3), '')) AS base_sha256, coalesce(string_agg({text}, ',' ORDER BY s, ord) FILTER (kind IS NOT NULL), '') AS spans
        FROM t LEFT JOIN every ON every.doc_id = t.doc_id GROUP BY t.doc_id"""


def _quality_sql() -> str:
    """Windows as joined words, one row each; cutoffs counted for every pair of text and cutoff; binomial tails summed from zero."""
    first = ", ".join(f"len(list_filter({list(cuts)}::DOUBLE[], lambda c: c > CASE WHEN {under} > 0 THEN {top}::DOUBLE / {under} ELSE 0 END)) + 1" for _, top, under, cuts in quality.RULES)
    grid = ", ".join(f"({r}, {j})" for r, (_, _, _, cuts) in enumerate(quality.RULES, 1) for j in range(1, len(cuts) + 1))
    names = ", ".join(f"({r}, '{name}')" for r, (name, _, _, _) in enumerate(quality.RULES, 1))
    levels = ", ".join(f"({i}, {margin}, {share})" for i, (margin, share) in enumerate(quality.LEVELS, 1))
    return f"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, lang AS stratum, coalesce(text, '') AS x FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda a: a <> '') AS ws, list_filter(string_split(x, chr(10)), lambda a: regexp_matches(a, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
        g AS (SELECT row, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT row, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        again AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
        rep AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS j FROM again) GROUP BY row),
        s AS (SELECT w.row, doc_id, stratum, md5(x) AS h, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
            CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(x) - length(regexp_replace(x, '[!?]', '', 'g')) AS n_marks,
            length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN rep ON rep.row = w.row),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [{first}] AS firsts FROM s),
        trial AS (SELECT stratum, h, min(quality) = 1 AS good, substr(h, 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS design, any_value(firsts) AS firsts
            FROM f JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND NOT base_failed GROUP BY stratum, h),
        grid(rule, cut) AS (VALUES {grid}), names(rule, name) AS (VALUES {names}), lev(level, margin, share) AS (VALUES {levels}),
        cnt AS (SELECT stratum, rule, cut, count(*) FILTER (good AND firsts[rule] <= cut) AS g, count(*) FILTER (NOT good AND firsts[rule] <= cut) AS b, count(*) FILTER (good) AS ng, count(*) FILTER (NOT good) AS nb
            FROM trial, grid WHERE design GROUP BY stratum, rule, cut),
        path AS (SELECT a.stratum, a.rule, level, a.cut FROM cnt a JOIN lev ON true JOIN cnt n ON n.stratum IS NOT DISTINCT FROM a.stratum AND n.rule = a.rule AND n.cut = a.cut + margin
            WHERE a.b * a.ng > a.g * a.nb AND n.g <= share * a.ng QUALIFY row_number() OVER (PARTITION BY a.stratum, a.rule, level ORDER BY a.b * a.ng - a.g * a.nb DESC, a.cut) = 1),
        hold AS (SELECT row_number() OVER () AS id, stratum, firsts FROM trial WHERE good AND NOT design),
        size AS (SELECT stratum, count(*) AS n FROM hold GROUP BY stratum),
        hit AS (SELECT hold.stratum, level, count(DISTINCT id) AS k FROM hold JOIN path ON path.stratum IS NOT DISTINCT FROM hold.stratum AND firsts[rule] <= cut GROUP BY hold.stratum, level),
        tail AS (SELECT stratum, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.ALPHA}) + (n - i) * ln(1 - {quality.ALPHA}))) OVER (PARTITION BY stratum ORDER BY i) AS p
            FROM (SELECT stratum, n, unnest(range(0, n)) AS i FROM size)),
        allowed AS (SELECT stratum, max(i) AS k FROM tail WHERE p <= {quality.DELTA} / (SELECT count(*) FROM size) GROUP BY stratum),
        chosen AS (SELECT a.stratum, max(lev.level) AS level FROM allowed a JOIN lev ON true LEFT JOIN hit ON hit.level = lev.level AND hit.stratum IS NOT DISTINCT FROM a.stratum WHERE coalesce(hit.k, 0) <= a.k GROUP BY a.stratum),
        failed AS (SELECT f.row, string_agg(name, ',' ORDER BY rule) AS failed FROM f JOIN chosen c ON c.stratum IS NOT DISTINCT FROM f.stratum JOIN path p ON p.stratum IS NOT DISTINCT FROM f.stratum AND p.level = c.level AND firsts[p.rule] <= p.cut
            JOIN names USING (rule) GROUP BY f.row)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM f LEFT JOIN failed USING (row)"""


def _codes_sql() -> str:
    """Every round compares all parts with all entries."""
    near = lambda i: f"""a{i} AS (SELECT p.row, p.part, e.entry, list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{i} e USING (part)
            QUALIFY row_number() OVER (PARTITION BY p.row, p.part ORDER BY d, e.entry) = 1)"""  # noqa: E731
    moved = lambda i: f"""n{i} AS (SELECT part, entry, list(v ORDER BY j) AS x FROM (SELECT part, entry, j, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v
            FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{i} JOIN p USING (row, part)) GROUP BY part, entry, j) GROUP BY part, entry),
        c{i + 1} AS (SELECT part, entry, coalesce(n{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN n{i} USING (part, entry))"""  # noqa: E731
    steps = ", ".join(f"{near(i)}, {moved(i)}" for i in range(codes.ROUNDS)) + f", {near(codes.ROUNDS)}"
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding, label NULLS LAST) AS row, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)),
        p AS (SELECT row, part, list_transform(x[(part - 1) * len(x) // {codes.PARTS} + 1:part * len(x) // {codes.PARTS}], lambda y: CAST(floor({codes.SCALE} * y) AS BIGINT)) AS x FROM v, range(1, {codes.PARTS + 1}) t(part)),
        c0 AS (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {codes.ENTRIES}), {steps},
        r AS (SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY row),
        b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{codes.ROUNDS})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (row), b"""


ORACLE = {
    "op1_lm_score": f"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        k AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
        g AS (SELECT *, lag(w, 1) OVER p AS w1, lag(w, 2) OVER p AS w2 FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
        u1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY ALL), u2 AS (SELECT doc_id, w1, w, count(*) AS n FROM g WHERE i > 1 GROUP BY ALL),
        u3 AS (SELECT doc_id, w2, w1, w, count(*) AS n FROM g WHERE i > 2 GROUP BY ALL),
        c1 AS (SELECT doc_id, w, sum(n) OVER (PARTITION BY w) - n AS f FROM u1), c2 AS (SELECT doc_id, w1, w, sum(n) OVER (PARTITION BY w1, w) - n AS f FROM u2),
        c3 AS (SELECT doc_id, w2, w1, w, sum(n) OVER (PARTITION BY w2, w1, w) - n AS f FROM u3),
        size AS (SELECT doc_id, len(ws) AS n, greatest(sum(len(ws)) OVER () - len(ws), 1) AS rest FROM t),
        j AS (SELECT g.doc_id, least(i, 3) AS tried, coalesce(c3.f, 0) AS t3, coalesce(c2.f, 0) AS t2, c1.f AS t1, p2.f AS b2, p1.f AS b1, rest FROM g JOIN size USING (doc_id)
            JOIN c1 ON g.doc_id = c1.doc_id AND g.w = c1.w LEFT JOIN c2 ON g.doc_id = c2.doc_id AND g.w = c2.w AND g.w1 = c2.w1
            LEFT JOIN c3 ON g.doc_id = c3.doc_id AND g.w = c3.w AND g.w1 = c3.w1 AND g.w2 = c3.w2
            LEFT JOIN c1 p1 ON g.doc_id = p1.doc_id AND g.w1 = p1.w LEFT JOIN c2 p2 ON g.doc_id = p2.doc_id AND g.w1 = p2.w AND g.w2 = p2.w1),
        e AS (SELECT *, CASE WHEN t3 > 0 THEN 3 WHEN t2 > 0 THEN 2 WHEN t1 > 0 THEN 1 ELSE 0 END AS ev FROM j),
        s AS (SELECT doc_id, ev, log10(CASE ev WHEN 3 THEN t3 / b2 WHEN 2 THEN t2 / b1 WHEN 1 THEN t1 / rest ELSE 1.0 / rest END) + (tried - ev) * log10(0.4) AS x FROM e)
        SELECT size.doc_id, CAST(any_value(size.n) AS BIGINT) AS n_words, round(avg(x), 5) AS mean_log10, count(*) FILTER (ev = 3) AS seen_3,
               count(*) FILTER (ev = 2) AS seen_2, count(*) FILTER (ev = 1) AS seen_1, count(*) FILTER (ev = 0) AS seen_0
        FROM size LEFT JOIN s USING (doc_id) GROUP BY size.doc_id""",
    "op2_mix_sources": """
        WITH RECURSIVE per AS (
            SELECT coalesce(source, '') AS s, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY 1),
        total AS (SELECT sum(size) AS size, sum(pow(size, 0.5)) AS weight FROM per),
        rates AS (SELECT s, CASE WHEN per.size > 0 THEN pow(per.size, 0.5) / total.weight * total.size / per.size ELSE 1.0 END AS rate FROM per, total),
        cdf(s, rate, k, p, c) AS (
            SELECT s, rate, 0, exp(-rate), exp(-rate) FROM rates
            UNION ALL
            SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k + 1 < ceil(rate + 12 * sqrt(rate) + 20)),
        drawn AS (
            SELECT d.*, r.rate, CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
            FROM documents d JOIN rates r ON coalesce(d.source, '') = r.s),
        counted AS (
            SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars, any_value(d.rate) AS rate, count(*) AS n
            FROM drawn d JOIN cdf ON coalesce(d.source, '') = cdf.s AND d.u >= cdf.c GROUP BY doc_id)
        SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, i AS copy_no,
               md5('mix:order:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':' || CAST(i AS VARCHAR)) AS order_key
        FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM counted)""",
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""",
    "op9_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to FROM r""",
    "op10_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS who FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(24 + length(who) + length(shown)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op4_secrets": _secrets_sql(),
    "op11_quality_rules": _quality_sql(),
    "op13_vector_codes": _codes_sql(),
}
