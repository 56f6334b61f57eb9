"""Reading uploaded files and writing snapshots of the store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.sources.tables import SCHEMAS


def read_txt(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """path, text of plain-text files; undecodable bytes are dropped."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.make_valid_utf8("value"), "�", "").alias("text"))
    return rows.withColumn("text", X.clean_ingest("text")) if clean else rows


def read_pdf(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """path, page_number, text of PDF files, pages from 1, without blank pages.  Needs pypdf or PyPDF2."""
    try:
        import pypdf as library
    except ImportError:
        try:
            import PyPDF2 as library
        except ImportError as e:
            raise ImportError("reading PDF files needs pypdf or PyPDF2") from e
    name = library.__name__

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import importlib
        import io

        module = importlib.import_module(name)
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                texts = [page.extract_text() or "" for page in module.PdfReader(io.BytesIO(content)).pages]
                yield pd.DataFrame({"path": p, "page_number": range(1, len(texts) + 1), "text": texts})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page_number int, text string")
    rows = rows.withColumn("text", X.clean_ingest("text")) if clean else rows
    return rows.filter(X.strip("text") != "")


def pdf_text(pages: DataFrame) -> DataFrame:
    """path, text: the pages of each file joined in order and cleaned again."""
    parts = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("path").agg(X.clean_ingest(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("text"))


def check_uploads(names: DataFrame) -> DataFrame:
    """Adds safe_name, file_type and reject (null if the upload is fine) to file names."""
    n = F.col("file_name")
    reject = F.when(n.isNull(), "no file").when(X.strip(n) == "", "no name").when(~X.allowed_file(n), "file type")
    return names.select("*", X.safe_name(n).alias("safe_name"), F.lower(F.substring_index(n, ".", -1)).alias("file_type"), reject.alias("reject"))


def create_store(spark: SparkSession, database: str) -> None:
    """Create the store's tables where they don't exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new snapshot; the path must not be one that ``df`` reads."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
