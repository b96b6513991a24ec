"""One registered query per operator, over its whole table, and the same result in SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import collocations, filteraudit, hostrules, htmltext, jaccard, langid, packing, pieces, suffixdedup, suffixtree, topk, urlfilter, warc
from tapeloom.llm.batches import small_batches

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixdedup.digests(_table(spark, folder, "documents").select("doc_id", "text"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    records, payloads = warc.write_archive(_table(spark, folder, "pages"))
    archive = warc.read_archive(records, payloads)
    return archive.select(
        F.col("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return urlfilter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = hostrules.judge(_table(spark, folder, "documents").select("doc_id", "text", "source"), keep_text=False)
    return judged.select("doc_id", *hostrules.MEASURES, "base_failed", "kept")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, folder, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(_table(spark, folder, "pages").select("page_id", "html")).select("page_id", "text")


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = suffixtree.score(docs, ~suffixtree.held_out())
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_state")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(filteraudit.failures(_table(spark, folder, "documents")), _table(spark, folder, "labels"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_warc,
        op3_url_filters,
        op4_packing,
        op5_quality_rules,
        op6_language_id,
        op7_sentencepiece,
        op8_jaccard_join,
        op9_html_extraction,
        op10_exact_top_k,
        op11_suffix_tree_scores,
        op12_filter_audit,
        op13_collocations,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"substr('{_BASE32}', 1 + ((('0x' || substr(sha1(body), {5 * i + 1}, 5))::INTEGER >> {shift}) & 31), 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
_CASES = "\n".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{action} {host}{path}'"
    for action, host, path in sorted(RULES, key=lambda r: (-r[1].count("."), -len(r[2])))
)
_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d""",
    "op3_url_filters": f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE {_CASES} END AS hit FROM s)
SELECT page_id, host, path, substr(hit, 7) AS rule, coalesce(substr(hit, 1, 5), 'allow') AS verdict FROM f""",
    "op5_quality_rules": rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, string_split(text, chr(10)) AS lines FROM t),
n AS (SELECT *, len(words) AS n_words,
        list_transform(range(1, greatest(len(words) - 3, 1)), lambda i: array_to_string(words[i:i + 4], ' ')) AS grams,
        list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')) AS full_lines FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times
      FROM (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM n)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(5) AS o(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT doc_id, source, CAST(n_words AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM n LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 10 * n_symbols > n_words AS b2, 20 * n_dup_lines > n_words AS b3 FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f1, count(*) FILTER (b2) AS f2, count(*) FILTER (b3) AS f3 FROM f GROUP BY source),
l AS (SELECT source, n, unnest([1, 2, 3]) AS rule, unnest([f1, f2, f3]) AS fails FROM h),
q AS (SELECT rule, least(greatest(avg(fails / n), 1e-6), 1 - 1e-6) AS mean, var_pop(fails / n) AS var, avg(1.0 / n) AS inv FROM l GROUP BY rule),
b AS (SELECT rule, mean, CASE WHEN var - mean * (1 - mean) * inv > 0
        THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1, 1.0), 1e4) ELSE 1e4 END AS k FROM q),
bad AS (SELECT DISTINCT source FROM l JOIN b USING (rule) WHERE (fails + mean * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
t AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * shared >= 75 * (i.n_shingles + j.n_shingles - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, n_shingles, component_id FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) ON x = doc_id""",
    "op10_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op12_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, min(doc_id) OVER (PARTITION BY text) AS head FROM t),
m AS (SELECT doc_id, part,
        CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > head, false) AS INT) AS mask FROM w),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN g USING (doc_id) GROUP BY part, mask),
f AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM range(5) AS r(i)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
      JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0) AS earlier FROM o, range(1, 6) AS r(k)),
x AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN (mask & (bit + earlier)::INT) = 0 THEN docs ELSE 0 END) AS kept,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier::INT) = 0 THEN docs ELSE 0 END) AS removed,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier::INT) <> 0 THEN docs ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier::INT) = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN (mask & bit) <> 0 AND (mask & earlier::INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x""",
    "op13_collocations": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
             string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT row, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS body FROM t),
w AS (SELECT row, lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS words FROM p),
o AS (SELECT row, lang, piece, generate_subscripts(words, 1) AS i, unnest(words) AS x FROM w),
g AS MATERIALIZED (SELECT lang, x, lead(x) OVER q AS y, lead(x, 2) OVER q AS z FROM o WINDOW q AS (PARTITION BY row, piece ORDER BY i)),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, a.f AS l, b.f AS r, 1 AS k
      FROM f2 c JOIN f1 a ON a.lang = c.lang AND a.x = c.x JOIN f1 b ON b.lang = c.lang AND b.x = c.y
      WHERE c.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 d WHERE d.lang = c.lang AND d.x = c.x AND d.y = c.y AND 100 * d.f >= 50 * c.f)
        AND NOT EXISTS (SELECT 1 FROM f3 d WHERE d.lang = c.lang AND d.y = c.x AND d.z = c.y AND 100 * d.f >= 50 * c.f)
      UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, a.f, b.f, 1
      FROM f3 c JOIN f1 a ON a.lang = c.lang AND a.x = c.x JOIN f2 b ON b.lang = c.lang AND b.x = c.y AND b.y = c.z
      UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, a.f, b.f, 2
      FROM f3 c JOIN f2 a ON a.lang = c.lang AND a.x = c.x AND a.y = c.y JOIN f1 b ON b.lang = c.lang AND b.x = c.z),
s AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s),
v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score, k AS cut
FROM v JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000""",
}
