"""The registered query of each operator, and the SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, license_scan, line_dedup, mixture, pii, preference, quality, simhash, url_lm, warc_zip
from .common import read_table

URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def _digest(spans) -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> "F.Column":
    return F.filter("pii", lambda s: s["kind"] == kind)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = pii.KINDS[:4]
    return found.select(
        "doc_id",
        *[F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_digest(F.filter("pii", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        _digest(F.col("pii")).alias("spans"),
    )


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "windows", "found", F.round("score", 6).alias("score"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc_zip.round_trip(spark, read_table(spark, sf_dir, "pages"))
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score")
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_lm.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 4).alias("score"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_notices(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    phrases = [n.phrase for n in license_scan.PHRASES]
    base = F.filter("notices", lambda n: n["phrase"].isin(*phrases))
    found = found.withColumn("base", base)

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda n: n["label"]))), ",")

    first = F.transform("base", lambda n: n["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("notices").alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["score"])), F.lit(0.0)).alias("score"),
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    made = preference.format_preferences(turns, preference.pairs_by_number(turns))

    def mask(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)

    return made.select("pair_id", "chosen_id", "rejected_id", "prefix_turns", "prompt", "chosen", "rejected", mask("chosen_mask"), mask("rejected_mask"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixture.plan_mix(read_table(spark, sf_dir, "documents"))
    return mixture.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_pii, op2_decontam, op3_warc, op4_quality, op5_urls, op6_licenses, op7_lines, op8_preferences, op9_simhash, op10_mix]
    return {f.__name__: f for f in ops}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p
), m AS (
  SELECT payload_digest AS digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM d LEFT JOIN m ON payload_digest = digest
"""

#: Lines of {docs} (doc_id, text) with the places of repeated long lines removed.
LINES_SQL = f"""
  l AS (
    SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{docs}})
  ), k AS (
    SELECT *, translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l
  ), r AS (
    SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
  ), j AS (
    SELECT k.*, coalesce(doc_id < last, false) AS gone FROM k LEFT JOIN r USING (key)
  ), kept AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
    FROM j GROUP BY doc_id
  )
"""

_OP7 = f"WITH {LINES_SQL.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept"

_OP8 = """
WITH c AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), p AS (
  SELECT conv_id // 2 AS pair_id, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id
  FROM c GROUP BY 1
), b AS (
  SELECT pair_id, chosen_id, rejected_id, x.t AS c, y.t AS r
  FROM p LEFT JOIN c x ON x.conv_id = chosen_id LEFT JOIN c y ON y.conv_id = rejected_id
), n AS (
  SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(c), len(r)) + 1) IF c[i] IS DISTINCT FROM r[i]]) - 1,
    CASE WHEN c IS NULL OR r IS NULL THEN 0 ELSE least(len(c), len(r)) END) AS k
  FROM b
), s AS (
  SELECT *, [['<|im_start|>' || coalesce(u.role, '') || chr(10), coalesce(u.text, '') || '<|im_end|>' || chr(10), u.role] FOR u IN coalesce(c, r)[1:k]] AS pre,
    [['<|im_start|>' || coalesce(u.role, '') || chr(10), coalesce(u.text, '') || '<|im_end|>' || chr(10), u.role] FOR u IN c[k + 1:]] AS cs,
    [['<|im_start|>' || coalesce(u.role, '') || chr(10), coalesce(u.text, '') || '<|im_end|>' || chr(10), u.role] FOR u IN r[k + 1:]] AS rs
  FROM n
), z AS (
  SELECT *, [length(u[1]) + length(u[2]) FOR u IN cs] AS cl, [length(u[1]) + length(u[2]) FOR u IN rs] AS rl FROM s
)
SELECT pair_id, chosen_id, rejected_id, CAST(k AS BIGINT) AS prefix_turns,
  array_to_string([u[1] || u[2] FOR u IN pre], '') AS prompt,
  CASE WHEN c IS NOT NULL THEN coalesce(array_to_string([u[1] || u[2] FOR u IN cs], ''), '') END AS chosen,
  CASE WHEN r IS NOT NULL THEN coalesce(array_to_string([u[1] || u[2] FOR u IN rs], ''), '') END AS rejected,
  CASE WHEN c IS NOT NULL THEN coalesce(array_to_string([CAST(coalesce(list_sum(cl[1:i - 1]), 0) + length(cs[i][1]) AS VARCHAR) || ':' ||
    CAST(list_sum(cl[1:i]) AS VARCHAR) FOR i IN range(1, len(cs) + 1) IF cs[i][3] = 'assistant'], ','), '') END AS chosen_mask,
  CASE WHEN r IS NOT NULL THEN coalesce(array_to_string([CAST(coalesce(list_sum(rl[1:i - 1]), 0) + length(rs[i][1]) AS VARCHAR) || ':' ||
    CAST(list_sum(rl[1:i]) AS VARCHAR) FOR i IN range(1, len(rs) + 1) IF rs[i][3] = 'assistant'], ','), '') END AS rejected_mask
FROM z
"""


def oracle_sql() -> dict[str, str]:
    """The others hash, draw or match with errors in ways that SQL doesn't express."""
    return {"op3_warc": _OP3, "op7_lines": _OP7, "op8_preferences": _OP8}
