"""Registered queries of the numbered operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat, decontaminate, divergence, html, licenses, linededup, neardup, packing, periodic, quality, sharding, suffixes, toxicity
from siltstone.llm._common import remove_later, scratch_path, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.chat_digests(chat.format_chats(rows.unionByName(more)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the shard that the last version keeps it in, read back from the shards. They are removed when the driver ends."""
    root = scratch_path(spark, "shards")
    remove_later(spark, root)
    shards = sharding.shard(table(spark, sf_dir, "documents"), root)
    rows = shards.read(schema="doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "shard")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.with_planted_tails(table(spark, sf_dir, "documents"))))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_suffix_dedup, op3_line_dedup, op4_quality_rules, op5_license_scans, op6_packing, op7_minhash_near_dedup, op8_decontamination, op9_sharding, op10_html_extraction, op11_source_divergence, op12_periodic_runs, op13_toxicity)}

_SAID = "</s>[INST] ok [/INST]"
_ESCAPED = r"""regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|(?:OUT|BODY|TURN)\])', '\1\\\2\3', 'g')"""
_ROLE = _ESCAPED.replace("(text", "(role")

SQL = {
    "op1_chat_formatting": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'
), marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length({_ESCAPED}) + CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13
    WHEN role = 'assistant' THEN 9 ELSE 19 + length({_ROLE}) END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op3_line_dedup": """
WITH lines AS (
  SELECT doc_id, i AS pos, l[i] AS line, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), windows AS (
  SELECT a.doc_id, a.pos, a.line || chr(10) || b.line || chr(10) || c.line AS w
  FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN lines c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
), later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest(range(0, 3)) AS k)
)
SELECT l.doc_id, any_value(n)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id""",
    "op11_source_divergence": r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 10
), uses AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source GROUP BY g.lang, g.source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (g.total + 2 * v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), langs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q
  FROM cells JOIN sizes USING (lang) JOIN (SELECT lang, sum(total) AS total FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cells JOIN langs USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
