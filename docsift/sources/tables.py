"""Parquet tables of the document store: schemas and loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.reduce import divided, reducer

#: Key column of each table of the store.
KEYS = {
    "app_user": "user_id",
    "doc_catalog": "document_id",
    "document_section": "section_id",
    "user_query": "query_id",
    "retrieval_result": "result_id",
    "answer": "answer_id",
    "documents": "doc_id",
    "eval_item": "item_id",
}

SCHEMAS = {
    "app_user": "user_id long, username string, email string",
    "doc_catalog": "document_id long, user_id long, document_name string, upload_date date, file_type string",
    "document_section": "section_id long, document_id long, section_text string, embedding array<float>, page_number int",
    "user_query": "query_id long, user_id long, query_text string, query_date date",
    "retrieval_result": "result_id long, query_id long, section_id long, similarity_score double",
    "answer": "answer_id long, query_id long, answer_text string",
}


def schema(name: str) -> T.StructType:
    """The schema of a store table, for creating or validating it."""
    return T.StructType.fromDDL(SCHEMAS[name])


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan one table; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def one_split(df: DataFrame) -> bool:
    """The planner's estimate of the input fits one split of a scan."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key: a row sent twice keeps its content, so the earliest arrival stands for both.

    Rows with a null key are kept as they are distinct from each other.  Texts
    and vectors stay where they are: repeated keys are found on the key alone,
    and only rows that a reducer of fixed size lets pass are shuffled whole.  An
    input of one split is shuffled by its key, for it has to be spread anyway.
    """
    rest = [c for c in df.columns if c not in (key, "loaded_at")]
    aggs = [F.min("loaded_at").alias("loaded_at")] if "loaded_at" in df.columns else []
    # one aggregate per column, so that columns nobody reads are pruned from the shuffle
    aggs += [F.first(F.col(f"`{c}`")).alias(c) for c in rest]
    if not aggs:
        return df.dropDuplicates([key])
    wide = any(isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for c in rest)
    if wide and not one_split(df):
        keys = df.select(key).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
        some, others = divided(df, key, reducer(keys, key))
    else:
        some, others = df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
    return some.groupBy(key).agg(*aggs).select(*df.columns).unionByName(others)
