"""The thin queries opN_<name> over whole tables, and their SQL where it can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, hmm, language, lines, neighbours, pieces, secrets, sharding, simhash, tiling, toxicity, whitening
from .common import table


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.expand(rows.unionByName(own)))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A deviation beyond a long is null; the operator has it whole.
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_hmm": op1_hmm,
    "op2_chat_format": op2_chat_format,
    "op3_language": op3_language,
    "op5_secrets": op5_secrets,
    "op4_sentencepiece": op4_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op8_neighbours": op8_neighbours,
    "op7_line_dedup": op7_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_divergence": op11_divergence,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

_OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    14 + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '###', '\h'), ':', '\c'))
       + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '###', '\h')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM n
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM v GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (  -- every kept term of each group, with the group's and the language's share
  SELECT s.lang, s.source, v.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (v.total + 2) // (l.n + 2 * l.v))::BIGINT AS q
  FROM s JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = v.term
), m AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op2_chat_format": _OP2_SQL, "op11_divergence": _OP11_SQL}
