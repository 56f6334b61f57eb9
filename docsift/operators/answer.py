"""Composing answers from retrieved sections: routing by intent, definitions, lists, a reader, and the extractive fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.functions import patterns as P
from docsift.functions import text as X
from docsift.functions.lists import list_items
from docsift.reduce import reduced, reducer
from docsift.stage import Stage

#: ``reader(df) -> df`` adds a column ``span`` to (query_id, query_text, context); none means the fallback.
Reader = Callable[[DataFrame], DataFrame]


def relevant(retrieved: DataFrame, gate: float = P.GATE) -> DataFrame:
    """Of each question's first five sections those with at least ``gate`` of the best score; the best is always kept."""
    top = F.max("score").over(W.partitionBy("query_id"))
    rows = retrieved.filter(F.col("rank") <= P.CONTEXT_SECTIONS).withColumn("_top", top)
    return rows.filter((F.col("score") >= gate * F.col("_top")) | (F.col("rank") == 1)).drop("_top")


def numbered_first(rows: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    """Adds ``place``: sections with numbered items first, else in rank order."""
    order = W.partitionBy("query_id").orderBy(F.desc(X.numbered(cleaned)), "rank")
    return rows.withColumn("place", F.row_number().over(order))


def context(retrieved: DataFrame) -> DataFrame:
    """query_id, context, words: cleaned sections in rank order, up to the first that would exceed the word limit."""
    cleaned = F.col("cleaned") if "cleaned" in retrieved.columns else X.clean_display("section_text")
    rows = retrieved.filter(F.col("rank") <= P.CONTEXT_SECTIONS).select("query_id", "rank", cleaned.alias("cleaned"))
    rows = rows.withColumn("words", X.word_count("cleaned"))
    total = F.sum("words").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("total", total).filter(F.col("total") <= P.CONTEXT_WORDS)
    parts = F.sort_array(F.collect_list(F.struct("rank", "cleaned")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["cleaned"]), " ").alias("context"), F.sum("words").alias("words"))


def content_sentences(rows: DataFrame, most: int = 3) -> DataFrame:
    """query_id, summary: the first distinct sentences that aren't titles, over sections in ``place`` order."""
    s = rows.select("query_id", "place", F.posexplode(F.split("cleaned", P.AFTER_SENTENCE_SHOWN)).alias("n", "raw")).withColumn("sentence", X.strip("raw"))
    s = s.filter(~X.header_like("sentence")).withColumn("_fp", F.lower(X.squeeze(F.substring("sentence", 1, 80))))
    s = s.withColumn("_k", F.row_number().over(W.partitionBy("query_id", "_fp").orderBy("place", "n"))).filter("_k = 1")
    s = s.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("place", "n"))).filter(F.col("_r") <= most)
    parts = F.sort_array(F.collect_list(F.struct("_r", "sentence")))
    return s.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["sentence"]), " ").alias("summary"))


def definitions(rows: DataFrame) -> DataFrame:
    """query_id, definition, priority: the strongest definition of the question's term over its first five sections."""
    asked = rows.filter(X.is_definition("query_text")).withColumn("term", X.key_term("query_text")).filter("term <> ''")
    # exploded rather than filtered, for a filter would look for every definition a second time
    hit = asked.filter(F.col("rank") <= P.CONTEXT_SECTIONS).select("query_id", "rank", F.explode(F.filter(F.array(X.definition_in("cleaned", "term")), lambda x: x.isNotNull())).alias("d"))
    best = F.min(F.struct(F.col("d.priority").alias("priority"), "rank", F.col("d.place").alias("place"), F.col("d.sentence").alias("sentence"))).alias("b")
    return hit.groupBy("query_id").agg(best).select("query_id", F.col("b.sentence").alias("definition"), F.col("b.priority").alias("priority"))


def list_answers(rows: DataFrame) -> DataFrame:
    """query_id, items: of list questions, the items of the first relevant section with at least two, at most ten."""
    found = rows.filter(X.is_list("query_text")).withColumn("items", list_items("cleaned", "query_text")).filter(F.size("items") >= 2)
    best = F.min(F.struct("rank", F.slice("items", 1, 10).alias("items"))).alias("b")
    return found.groupBy("query_id").agg(best).select("query_id", F.col("b.items").alias("items"))


def best_section(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, best: list items, else the first content sentences, else the context."""
    near = relevant(rows)
    items, summary = list_answers(near), content_sentences(numbered_first(near))
    joined = rows.select("query_id").distinct().join(items, "query_id", "left").join(summary, "query_id", "left").join(fallback.select("query_id", "context"), "query_id", "left")
    bullets = F.array_join(F.transform("items", lambda i: F.concat(F.lit("• "), i)), "\n")
    return joined.select("query_id", F.coalesce(bullets, F.when(F.col("summary") != "", F.col("summary")), F.col("context")).alias("best"))


def cleaned_results(retrieved: DataFrame, sections: DataFrame) -> DataFrame:
    """Retrieved rows with ``cleaned`` text; each section that was retrieved is cleaned once, where it is scanned."""
    hit = reduced(sections.select("section_id", "section_text"), "section_id", reducer(retrieved, "section_id"))
    return retrieved.join(hit.select("section_id", X.clean_display("section_text").alias("cleaned")), "section_id")


def answers(questions: DataFrame, retrieved: DataFrame, sections: DataFrame, reader: Reader | None = None) -> DataFrame:
    """query_id, route, answer, context of every question.

    retrieved: query_id, section_id, score, rank.  Routes are tried in this
    order: no sections or too little context (not_found), list, definition,
    reader, fallback.  Definitions and lists never reach the reader.
    """
    q = questions.select("query_id", "query_text")
    stage = Stage(questions.sparkSession, "answers")
    rows = stage.save(cleaned_results(retrieved, sections).join(q, "query_id"), "retrieved")
    ctx = context(rows)
    first = rows.filter("rank = 1").select("query_id", F.col("cleaned").alias("top"))
    ctx = stage.save(ctx, "context")
    best = stage.save(best_section(rows, ctx), "best")
    out = q.join(ctx, "query_id", "left").join(first, "query_id", "left").join(best, "query_id", "left").join(definitions(rows), "query_id", "left")
    if reader:
        open_ = out.filter(~X.is_list("query_text") & F.col("definition").isNull() & (F.length("context") >= P.CONTEXT_LEAST))
        out = out.join(reader(open_.select("query_id", "query_text", "context")).select("query_id", "span"), "query_id", "left")
    else:
        out = out.withColumn("span", F.lit(None).cast("string"))
    out = stage.save(out.withColumn("read", read_span("span", "context")), "joined")
    route = (
        F.when(F.coalesce(F.length("context"), F.lit(0)) < P.CONTEXT_LEAST, "not_found")
        .when(X.is_list("query_text"), "list")
        .when(F.col("definition").isNotNull(), "definition")
        .when(F.length("read") > 10, "reader")
        .otherwise("fallback")
    )
    out = out.withColumn("route", route)
    raw = F.when(F.col("route").isin("list", "fallback"), F.col("best")).when(F.col("route") == "definition", F.col("definition")).otherwise(F.col("read"))
    text = F.when(F.col("route") == "not_found", F.lit(P.NOT_FOUND)).otherwise(X.polish(F.col("raw")))
    shown = F.when(F.col("route").isin("list", "definition", "reader"), F.col("top")).otherwise(F.lit(""))
    out = stage.save(out.select("query_id", "route", "top", raw.alias("raw")), "routed")
    return out.select("query_id", "route", text.alias("answer"), shown.alias("context"))


def read_span(span: str, ctx: str) -> Column:
    """A reader's span; under fifteen characters it is widened to its sentence."""

    def widened(s: Column) -> Column:
        wide = X.expand_to_sentence(s, ctx)
        return F.when((s != "") & (F.length(s) < 15), X.let(wide, lambda w: F.when(F.length(w) > F.length(s), w).otherwise(s))).otherwise(s)

    return X.let(X.strip(span), widened)


def first_section(retrieved: DataFrame, sections: DataFrame) -> DataFrame:
    """query_id, answer: the text of the best section as it is, the simplest way to answer."""
    return retrieved.filter("rank = 1").join(sections.select("section_id", "section_text"), "section_id").select("query_id", F.col("section_text").alias("answer"))
