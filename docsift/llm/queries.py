"""Queries of problems 2 to 9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.llm import cutoff, knn, leaks, neardup, pack, pairs, scans, split


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(_t(spark, sf_dir, "document_section"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of p2_found: one row per section with its class of equal texts and the number of similar classes."""
    return neardup.links(_t(spark, sf_dir, "document_section"), n=3, similarity=0.6, min_words=20)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(_t(spark, sf_dir, "answer"), _t(spark, sf_dir, "user_query"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.divided(_t(spark, sf_dir, "document_section"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pieces(_t(spark, sf_dir, "document_section"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.mutual(_t(spark, sf_dir, "document_section"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.neighbours(_t(spark, sf_dir, "document_section"))


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(_t(spark, sf_dir, "document_section"), lambda key: key % 20 == 0)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(_t(spark, sf_dir, "document_section"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(_t(spark, sf_dir, "document_section"))


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packed(pack.token_counts(_t(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_item"))


def p8_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a long exact run of a passage, or with at least half of it in edited form."""
    found = leaks.leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_item"), least_run=leaks.RUN, least_coverage=0.5)
    return found.filter((found.run >= leaks.RUN) | (found.coverage >= 0.5))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.found(_t(spark, sf_dir, "documents"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.rates(_t(spark, sf_dir, "documents"))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in code points and bytes at which the texts of a source end too often."""
    tested = cutoff.hazards(cutoff.endings(_t(spark, sf_dir, "documents")), ("chars", "bytes"))
    return tested.filter("significant").select("source", "unit", "size", "ended", "at_risk")


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p3_found, p4_found, p4_pieces, p5_found, p5_neighbours, p5_search, p6_found, p6_repaired, p7_sequences, p8_found, p8_alignments, p9_found, p9_rates, p9_limits)}
SQL = {
    "p9_limits": f"""WITH c AS (SELECT source, unit, size, count(*) AS ended FROM (
  SELECT source, 'chars' AS unit, length(text) AS size FROM documents UNION ALL SELECT source, 'bytes', strlen(text) FROM documents) WHERE size > 0 GROUP BY ALL),
r AS (SELECT *, sum(ended) OVER (PARTITION BY source, unit ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS at_risk,
  sum(ended) OVER (PARTITION BY source, unit ORDER BY size RANGE BETWEEN {cutoff.NEIGHBOURS} PRECEDING AND {cutoff.NEIGHBOURS} FOLLOWING) - ended AS around FROM c),
e AS (SELECT *, at_risk * (around + 0.5) / ({2 * cutoff.NEIGHBOURS} * at_risk + around * {cutoff.NEIGHBOURS / 2}) AS expected FROM r),
p AS (SELECT *, CASE WHEN ended > expected THEN -(ended * ln(ended / expected) - ended + expected) ELSE 0 END AS log_p FROM e),
n AS (SELECT *, count(*) OVER (PARTITION BY source, unit) AS tests, row_number() OVER (PARTITION BY source, unit ORDER BY log_p, size) AS nth FROM p),
l AS (SELECT *, max(CASE WHEN log_p <= ln({cutoff.FALSE_DISCOVERY} * nth / tests) THEN nth END) OVER (PARTITION BY source, unit) AS top FROM n)
SELECT source, unit, size::BIGINT AS size, ended::BIGINT AS ended, at_risk::BIGINT AS at_risk FROM l WHERE nth <= top""",
    "p4_found": r"""SELECT DISTINCT section_id FROM document_section
WHERE section_id IS NOT NULL AND length(trim(section_text, chr(32) || chr(9) || chr(10) || chr(13))) > 1200""",
}
