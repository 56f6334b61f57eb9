"""Relational views over the store, set-wise: what a page asks for one user or question is computed for all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.functions import text as X
from docsift.sources.tables import KEYS, once


def live(df: DataFrame, name: str) -> DataFrame:
    """Rows of a store table once per key, without deleted ones."""
    rows = once(df, KEYS[name])
    return rows.filter("deleted_at is null").drop("deleted_at", "loaded_at") if "deleted_at" in rows.columns else rows.drop("loaded_at")


def documents_by_owner(documents: DataFrame) -> DataFrame:
    """Each owner's documents, newest first: adds ``place``."""
    order = W.partitionBy("user_id").orderBy(F.desc_nulls_last("upload_date"), "document_id")
    return documents.withColumn("place", F.row_number().over(order))


def recent_queries(queries: DataFrame, most: int = 10) -> DataFrame:
    """Each user's latest questions."""
    return queries.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("query_id")))).filter(F.col("place") <= most)


def history(queries: DataFrame, answers: DataFrame, most: int = 5) -> DataFrame:
    """query_id, place, shown_id, shown_text, answer_text: for each question the last questions of its user up to it, oldest first."""
    by_user = W.partitionBy("user_id").orderBy("query_id").rowsBetween(-(most - 1), 0)
    rows = queries.withColumn("shown", F.collect_list(F.struct("query_id", "query_text")).over(by_user))
    flat = rows.select("query_id", "user_id", F.posexplode("shown").alias("n", "s")).select("query_id", "user_id", (F.col("n") + 1).alias("place"), F.col("s.query_id").alias("shown_id"), F.col("s.query_text").alias("shown_text"))
    return flat.join(answer_of(answers).withColumnRenamed("query_id", "shown_id"), "shown_id", "left").select("query_id", "place", "shown_id", "shown_text", "answer_text")


def answer_of(answers: DataFrame) -> DataFrame:
    """query_id, answer_text of the first answer to each question."""
    return answers.filter(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min(F.struct("answer_id", "answer_text")).alias("a")).select("query_id", F.col("a.answer_text").alias("answer_text"))


def provenance(results: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, document_id, document_name, file_type, pages: the documents behind each question, with their pages in order."""
    s = sections.select("section_id", "document_id", "page_number")
    rows = results.select("query_id", "section_id").join(s, "section_id").select("query_id", "document_id", "page_number").distinct()
    grouped = rows.groupBy("query_id", "document_id").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))
    return grouped.join(documents.select("document_id", "document_name", "file_type"), "document_id").select("query_id", "document_id", "document_name", "file_type", "pages")


def page_label(pages: Column | str) -> Column:
    """``p. 3`` or ``pp. 3-5, 7`` for an ordered array of distinct pages; empty for none."""
    pages = F.col(pages) if isinstance(pages, str) else pages
    runs = F.aggregate(
        pages, F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] + 1 == p), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), p.alias("b"))))).otherwise(
            F.concat(acc, F.array(F.struct(p.alias("a"), p.alias("b"))))
        ),
    )
    text = F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string")))), ", ")
    return F.when(F.size(pages) == 0, F.lit("")).when(F.size(pages) == 1, F.concat(F.lit("p. "), text)).otherwise(F.concat(F.lit("pp. "), text))


def source_line(prov: DataFrame, shown: int = 2) -> DataFrame:
    """query_id, sources, more: the first documents with their page labels, and how many more there are."""
    label = page_label("pages")
    named = F.concat(F.col("document_name"), F.when(label == "", F.lit("")).otherwise(F.concat(F.lit(" · "), label)))
    docs = prov.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("document_id", named.alias("s")))).alias("d"))
    return docs.select("query_id", F.array_join(F.transform(F.slice("d", 1, shown), lambda x: x["s"]), ", ").alias("sources"), F.greatest(F.size("d") - shown, F.lit(0)).alias("more"))


def register_conflicts(users: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose name or address is taken: two equi-joins instead of one on a disjunction."""
    a = candidates.join(users.select(F.col("username")).filter("username is not null").distinct(), "username", "left_semi")
    b = candidates.join(users.select(F.col("email")).filter("email is not null").distinct(), "email", "left_semi")
    return a.select(*candidates.columns).unionByName(b.select(*candidates.columns)).distinct()


def owned(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (document_id, user_id) whose user owns the document."""
    return requests.join(documents.select("document_id", "user_id"), ["document_id", "user_id"], "left_semi")


def delete_documents(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """The store after the documents of authorised requests (document_id, user_id) are gone, as new snapshots.

    Sections, results, and documents go; of the questions that lost a result,
    those without any other go with their answers.  Questions that never had a
    result stay.
    """
    docs, sections, results = tables["doc_catalog"], tables["document_section"], tables["retrieval_result"]
    gone = owned(docs, requests).select("document_id").distinct()
    lost = sections.join(gone, "document_id", "left_semi").select("section_id").distinct()
    affected = results.join(lost, "section_id", "left_semi").select("query_id").distinct()
    kept = results.join(lost, "section_id", "left_anti")
    orphans = affected.join(kept.select("query_id"), "query_id", "left_anti")
    return {
        "doc_catalog": docs.join(gone, "document_id", "left_anti"),
        "document_section": sections.join(gone, "document_id", "left_anti"),
        "retrieval_result": kept,
        "user_query": tables["user_query"].join(orphans, "query_id", "left_anti"),
        "answer": tables["answer"].join(orphans, "query_id", "left_anti"),
        "orphans": orphans,
    }


def append_with_ids(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows with keys that go on from the largest existing one.

    Numbers are dealt out per partition of a range-partitioned sort, so no task
    sees all rows; the counts per partition are as many as there are partitions.
    """
    spark = new.sparkSession
    start = existing.agg(F.max(key)).first()[0] or 0
    rows = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from docsift.stage import Stage

    rows = Stage(spark, "ids").save(rows, "new")
    before, base = {}, start
    for r in rows.groupBy("_p").count().orderBy("_p").collect():
        before[r[0]] = base
        base += r[1]
    offsets = spark.createDataFrame(list(before.items()) or [], "_p int, _base long")
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*order))).join(F.broadcast(offsets), "_p")
    return ranked.withColumn(key, F.col("_base") + F.col("_n")).drop("_p", "_n", "_base")


def name_filter(documents: DataFrame, typed: str) -> DataFrame:
    """Documents whose name holds the typed text, without case; all for a blank text."""
    wanted = F.lower(X.strip(F.lit(typed)))
    return documents.filter((wanted == "") | F.contains(F.lower("document_name"), wanted))


def selection_label(chosen: Column, total: Column) -> Column:
    """What the selector shows for k of n chosen documents."""
    return F.when(total == 0, "Upload documents").when(chosen == 0, "All documents").otherwise(F.concat(chosen.cast("string"), F.lit(" of "), total.cast("string")))


def kept_selection(chosen: Column, valid: Column) -> Column:
    """Chosen ids that still exist."""
    return F.array_intersect(chosen, valid)


def stamped(df: DataFrame, column: str, today: Column | None = None) -> DataFrame:
    """Rows with the day they were written; ``today`` replaces the clock, as in tests."""
    return df.withColumn(column, F.current_date() if today is None else today)


def one(df: DataFrame, *order: str):
    """The first row in the given order, or None."""
    return df.orderBy(*order).first() if order else df.first()


def initial(c: Column | str) -> Column:
    """The upper-case first letter of a name."""
    return F.upper(F.substring(F.col(c) if isinstance(c, str) else c, 1, 1))
