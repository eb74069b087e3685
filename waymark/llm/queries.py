"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.chat import rotate_perspectives
from waymark.llm.classifier import quality_scores
from waymark.llm.common import documents
from waymark.llm.conversation_repair import repair_damaged
from waymark.llm.fingerprints import fingerprints
from waymark.llm.mixing import mixing_report
from waymark.llm.ngram_join import ngram_links
from waymark.llm.packing import pack_documents
from waymark.llm.paragraph_dedup import repeated_passages
from waymark.llm.quality_rules import judge_documents
from waymark.llm.sanitise import personal_data_report
from waymark.llm.source_audit import audit_sources
from waymark.llm.token_counts import token_counts
from waymark.llm.warc import archive_round_trip


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(documents(spark, sf_dir)).drop("lang", "source", "text_hash")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(documents(spark, sf_dir))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("text_hash")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(documents(spark, sf_dir)).drop("text_hash")


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir),
                          spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"))


def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_source_mixing, op3_paragraph_dedup, op4_ngram_join, op5_perspectives,
    op6_personal_data, op7_packing, op8_fingerprints,
    op9_quality_classifier, op10_token_counts, op11_warc_archives, op12_source_audit,
    op13_conversation_repair)}

ORACLES = {
    "op2_source_mixing": """
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   CAST('0x' || substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR),
                        md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS place
            FROM documents),
        sources AS (
            SELECT source, sum(size) AS source_size, 3 * sum(size) AS cap,
                   [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, cap / w AS at,
                   (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))
                   / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
            FROM sources
            WINDOW earlier AS (ORDER BY cap / w, source NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (
            SELECT source, CAST(source_size AS BIGINT) AS source_size,
                   CASE WHEN level * w >= cap THEN CAST(cap AS DOUBLE) ELSE w * (
                       SELECT arg_min(l.level, l.at) FROM levels l WHERE l.level * l.w < l.cap)
                   END AS target
            FROM levels),
        passes AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS n
            FROM targets),
        placed AS (
            SELECT s.*, source_size, target, n, target - n * source_size AS rest,
                   sum(size) OVER (PARTITION BY s.source ORDER BY place
                                   ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
            FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(size * (n + CASE WHEN size > 0 AND middle <= rest THEN 1 ELSE 0 END)
                    AS BIGINT) AS taken
        FROM placed
    """,
    "op5_perspectives": """
        WITH turns AS (
            SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'),
                       '[^\\p{L}\\p{N}_-]', '_', 'g') AS role,
                   replace(coalesce(text, ''), '<|', '< |') AS text
            FROM conversations),
        speakers AS (
            SELECT DISTINCT conv_id AS conv, role AS speaker FROM turns WHERE role <> 'system'),
        rendered AS (
            SELECT conv_id, speaker, turn, role, text, role = speaker AS mask,
                   '<|' || CASE WHEN role = speaker THEN 'assistant'
                                WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || role END
                        || '|>' || chr(10) || text || '<|end|>' || chr(10) AS message
            FROM turns JOIN speakers ON conv_id IS NOT DISTINCT FROM conv)
        SELECT conv_id, speaker, turn, role, message, mask,
               row_number() OVER dialogue - 1 AS position,
               CAST(sum(length(message)) OVER dialogue - length(message) AS BIGINT) AS start,
               CAST(sum(length(message)) OVER dialogue AS BIGINT) AS "end"
        FROM rendered
        WINDOW dialogue AS (PARTITION BY conv_id, speaker
                            ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
    """,
    "op12_source_audit": """
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang,
                   coalesce(source, '') AS source,
                   regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
            FROM documents),
        occurring AS (
            SELECT doc, lang, source, unnest(terms) AS term FROM docs),
        kept AS (
            SELECT lang, term FROM occurring GROUP BY lang, term
            HAVING count(DISTINCT doc) >= 10),
        vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counted AS (
            SELECT g.lang, g.source, k.term, count(o.term) AS c
            FROM groups g JOIN kept k ON k.lang = g.lang
            LEFT JOIN occurring o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
            GROUP BY g.lang, g.source, k.term),
        shares AS (
            SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)::HUGEINT)
                   // ((sum(c) OVER (PARTITION BY lang, source))::HUGEINT + 2 * v) AS p
            FROM counted JOIN vocabulary USING (lang)),
        whole AS (
            SELECT lang, term, 1 + (1000000000 * (c + 2)::HUGEINT)
                   // ((sum(c) OVER (PARTITION BY lang))::HUGEINT + 2 * v) AS q
            FROM (SELECT lang, term, sum(c) AS c FROM counted GROUP BY lang, term)
            JOIN vocabulary USING (lang)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item,
                   sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares a JOIN shares b
                ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY a.lang, a.source, b.source),
        results AS (
            SELECT g.lang, g.source, 'pair' AS part, h.source AS item,
                   CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source
                AND pairs.item = h.source
            UNION ALL
            SELECT s.lang, s.source, 'term', s.term,
                   CAST((p - q) * (p - q) // (p + q) AS BIGINT)
            FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term
            WHERE c > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
                                          ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM results
        QUALIFY part = 'pair' OR rank <= 10
    """,
}
