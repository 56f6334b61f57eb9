"""Corpus checks of the core: queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.operators.orphans import Reference, orphan_counts, orphans
from docsift.sources.tables import table


def references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    """The three foreign keys of the store that are checked."""
    catalog = table(spark, sf_dir, "doc_catalog", ["document_id", "loaded_at", "deleted_at"])
    section = table(spark, sf_dir, "document_section", ["section_id", "document_id", "loaded_at", "deleted_at"])
    query = table(spark, sf_dir, "user_query", ["query_id", "loaded_at", "deleted_at"])
    result = table(spark, sf_dir, "retrieval_result", ["result_id", "section_id", "loaded_at", "deleted_at"])
    answer = table(spark, sf_dir, "answer", ["answer_id", "query_id", "loaded_at", "deleted_at"])
    return [
        Reference("document_section", section, "section_id", "document_id", catalog, "document_id"),
        Reference("retrieval_result", result, "result_id", "section_id", section, "section_id"),
        Reference("answer", answer, "answer_id", "query_id", query, "query_id"),
    ]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record whose reference leads nowhere, with its reason."""
    return orphans(references(spark, sf_dir))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan counts per table, month of arrival and reason."""
    return orphan_counts(references(spark, sf_dir))


_CTE = """
WITH refs AS (
  SELECT 'document_section' AS src_table, section_id AS record_id, max(document_id) AS ref_id, min(loaded_at) AS first, max(deleted_at) AS gone
  FROM document_section WHERE section_id IS NOT NULL GROUP BY section_id
  UNION ALL
  SELECT 'retrieval_result', result_id, max(section_id), min(loaded_at), max(deleted_at)
  FROM retrieval_result WHERE result_id IS NOT NULL GROUP BY result_id
  UNION ALL
  SELECT 'answer', answer_id, max(query_id), min(loaded_at), max(deleted_at)
  FROM answer WHERE answer_id IS NOT NULL GROUP BY answer_id
), targets AS (
  SELECT 'document_section' AS src_table, document_id AS key, min(loaded_at) AS first, max(deleted_at) AS gone FROM doc_catalog GROUP BY document_id
  UNION ALL
  SELECT 'retrieval_result', section_id, min(loaded_at), max(deleted_at) FROM document_section GROUP BY section_id
  UNION ALL
  SELECT 'answer', query_id, min(loaded_at), max(deleted_at) FROM user_query GROUP BY query_id
), found AS (
  SELECT r.src_table, r.record_id, r.first,
    CASE WHEN t.key IS NULL THEN 'missing' WHEN t.gone IS NOT NULL THEN 'deleted'
         WHEN t.first > r.first + INTERVAL 24 HOUR THEN 'late' END AS reason
  FROM refs r LEFT JOIN targets t ON t.src_table = r.src_table AND t.key = r.ref_id
  WHERE r.ref_id IS NOT NULL AND r.gone IS NULL
)
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
SQL = {
    "p1_found": _CTE + "SELECT src_table, record_id, reason FROM found WHERE reason IS NOT NULL",
    "p1_counts": _CTE + """SELECT src_table, strftime(first, '%Y-%m') AS month, reason, count(*) AS records
FROM found WHERE reason IS NOT NULL GROUP BY ALL""",
}
