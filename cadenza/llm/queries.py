"""The queries of this subpackage over the whole tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, divergence, exact_dedup, html_text, importance, licenses, lm_scoring, mixing, mpeg_audio, near_dedup, substring_dedup, token_files, toxicity
from cadenza.llm.common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; it is installed with the library on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    names = F.transform("matches", lambda m: F.concat_ws(":", m["passage"].cast("string"), m["license"]))
    return found.select(
        "doc_id", "n_passages", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ";").alias("licenses"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digests(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_token_files, op3_licenses, op4_exact_dedup, op5_near_dedup, op6_html_text, op7_substring_dedup, op8_mixing,
        op9_mpeg_audio, op10_bpe, op11_divergence, op12_lm_scoring, op13_importance,
    )
    return {f.__name__: f for f in every}


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    rows = ", ".join(
        f"({n}, '{name}', [{', '.join(repr(b) for b in bigrams)}])" for n, (name, bigrams) in enumerate(licenses.template_bigrams())
    )
    return f"""
WITH templates(number, license, own) AS (VALUES {rows}),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, coalesce(text, '') AS whole FROM documents),
passages AS (
  SELECT doc_id, i AS passage, parts[i] AS p FROM lines, unnest(range(1, len(parts) + 1)) AS r(i)
  UNION ALL SELECT doc_id, 0, whole FROM lines WHERE len(parts) > 1),
words AS (SELECT doc_id, passage, string_split(trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM passages),
bigrams AS (SELECT doc_id, passage, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, passage, license, round(2.0::DOUBLE * len(list_intersect(b, own)) / (len(b) + len(own)), 6) AS dice
  FROM bigrams, templates WHERE 2 * 100 * least(len(b), len(own)) >= {licenses.LEAST} * (len(b) + len(own))),
best AS (
  SELECT doc_id, passage, license, dice FROM scored WHERE dice * 100 >= {licenses.LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id, passage ORDER BY dice DESC, license DESC) = 1),
matches AS (
  SELECT doc_id, count(*) AS n, string_agg(passage || ':' || license, ';' ORDER BY passage) AS names, max(dice) AS dice FROM best GROUP BY doc_id)
SELECT doc_id, len(list_filter(parts, lambda x: x <> ''))::BIGINT AS n_passages, coalesce(n, 0)::BIGINT AS n_matches, coalesce(names, '') AS licenses,
  coalesce(dice, 0.0)::DOUBLE AS best_dice
FROM lines LEFT JOIN matches USING (doc_id)"""


#: Table of the reflected polynomial of CRC-32, from its rule: eight shifts of each byte.
_CRC_TABLE = "list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"


def _importance_sql() -> str:
    pattern = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    return f"""
WITH crc(t) AS MATERIALIZED (SELECT {_CRC_TABLE}),
docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, {pattern}) AS w FROM documents),
aims AS MATERIALIZED (SELECT regexp_extract_all({_LOWERED}, {pattern}) AS w FROM benchmark),
words AS MATERIALIZED (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM docs UNION ALL SELECT w FROM aims)),
bytes AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b FROM words),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
source AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS word FROM docs) JOIN buckets USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS word FROM aims) JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM source)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM target)::DOUBLE AS t),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(g.n, 0)::DOUBLE + 1) * (totals.s + 10000) / ((source.n::DOUBLE + 1) * (totals.t + 10000))))::BIGINT AS gain
  FROM source LEFT JOIN target g USING (bucket), totals),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS word FROM docs) JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM ranked"""


def _divergence_sql() -> str:
    share = "(1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v))::BIGINT"
    p, q = share.format(n="coalesce(c.n, 0)", total="total"), share.format(n="lang_n", total="lang_total")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
each AS MATERIALIZED (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
grps AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source) LEFT JOIN langs USING (lang)),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p} AS p, {q} AS q
  FROM grps g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_divergence": _divergence_sql(),
        "op13_importance": _importance_sql(),
        "op3_licenses": _license_sql(),
        "op4_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWERED} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
        "op5_near_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS c FROM both_ways UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.doc_id),
least AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN least USING (doc_id)""",
        "op7_substring_dedup": """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM words, unnest(range(1, len(w) - 11)) AS r(i) WHERE len(w) >= 13),
covered AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY t) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM covered, unnest(range(0, 13)) AS r(k)),
each AS (SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    }
