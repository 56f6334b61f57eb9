"""Dividing documents into sections: fixed windows, sentence-aware overlapping chunks, and both per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import patterns as P
from docsift.functions import text as X


def fixed_chunks(c: Column | str, size: int = P.CHUNK_WORDS) -> Column:
    """Array of chunks of ``size`` words without overlap."""
    ws = X.words(c)
    starts = F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws), F.lit(size))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.lit(size)), " "))


def chunk_bounds(counts: Column, size: int = P.CHUNK_WORDS, overlap: int = P.CHUNK_OVERLAP) -> Column:
    """array<struct<a, b>>: first and last sentence (from 1) of each chunk, given the sentences' word counts.

    A fold over the sentences that carries the open chunk.  A sentence that does
    not fit closes it; the next chunk opens with the longest run of whole last
    sentences of at most ``overlap`` words.  Sentences are never divided.
    """
    empty = "cast(array() as array<struct<a:int,b:int>>)"
    zero = F.expr(f"named_struct('done', {empty}, 'a', 1, 'at', 0, 'words', 0)")

    def step(s: Column, n: Column) -> Column:
        at = s["at"] + 1
        closes = (s["words"] + n > size) & (s["at"] >= s["a"])
        # how many last sentences of the closed chunk fit into the overlap
        run = F.aggregate(
            F.reverse(F.slice(counts, s["a"], F.greatest(s["at"] - s["a"] + 1, F.lit(0)))),
            F.expr("named_struct('k', 0, 'words', 0, 'open', true)"),
            lambda r, m: F.when(r["open"] & (r["words"] + m <= overlap), F.struct((r["k"] + 1).alias("k"), (r["words"] + m).alias("words"), F.lit(True).alias("open"))).otherwise(
                F.struct(r["k"].alias("k"), r["words"].alias("words"), F.lit(False).alias("open"))
            ),
        )
        closed = F.struct(
            F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["at"].alias("b")))).alias("done"), (s["at"] - run["k"] + 1).alias("a"), at.alias("at"), (run["words"] + n).alias("words")
        )
        kept = F.struct(s["done"].alias("done"), s["a"].alias("a"), at.alias("at"), (s["words"] + n).alias("words"))
        return F.when(closes, closed).otherwise(kept)

    def finish(s: Column) -> Column:
        return F.when(s["at"] >= s["a"], F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["at"].alias("b"))))).otherwise(s["done"])

    return F.aggregate(counts, zero, step, finish)


def overlap_chunks(df: DataFrame, text: str, size: int = P.CHUNK_WORDS, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """Explode each row's text into (pos, chunk), pos from 1; a row whose text has no sentence gives no row."""
    rows = df.withColumn("_sentences", X.sentences(text)).filter(F.size("_sentences") > 0)
    rows = rows.withColumn("_counts", F.transform("_sentences", X.word_count))
    rows = rows.select("*", F.posexplode(chunk_bounds(F.col("_counts"), size, overlap)).alias("_i", "_c"))
    part = F.array_join(F.slice("_sentences", F.col("_c.a"), F.col("_c.b") - F.col("_c.a") + 1), " ")
    return rows.select(*[c for c in df.columns if c != text], (F.col("_i") + 1).alias("pos"), X.strip(part).alias("chunk"))


def paged(df: DataFrame, text: str) -> DataFrame:
    """One row per page: blocks between blank lines stand for pages, numbered from 1; blank pages keep their number but give no row."""
    pages = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n[ \t]*\n")).alias("_p", "_t"))
    out = pages.select("*", (F.col("_p") + 1).alias("page_number"), F.col("_t").alias(text)).drop("_p", "_t")
    return out.filter(X.strip(text) != "")
