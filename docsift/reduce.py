"""A semi-join reducer of fixed size: which keys may occur on the other side of a join.

The keys are folded into ``BITS`` bits, kept as at most ``BITS / 64`` rows of one
long each.  That bound does not depend on the data, so the rows can always be
broadcast; with more keys the reducer lets more rows pass, never fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 2**22


def _place(column: str) -> tuple[F.Column, F.Column]:
    h = F.pmod(F.xxhash64(F.col(column), F.lit(77)), F.lit(BITS))
    return F.floor(h / 64).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def reducer(keys: DataFrame, column: str) -> DataFrame:
    """The folded keys: word, bits."""
    word, bit = _place(column)
    return keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def reduced(df: DataFrame, column: str, by: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among the folded keys."""
    word, bit = _place(column)
    marked = df.withColumn("_word", word).withColumn("_bit", bit)
    hit = marked.join(F.broadcast(by.withColumnRenamed("word", "_word")), "_word").filter(F.expr("getbit(bits, _bit) = 1"))
    return hit.select(*df.columns)


def divided(df: DataFrame, column: str, by: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the folded keys, all other rows and those without a key)."""
    word, bit = _place(column)
    marked = df.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(by.withColumnRenamed("word", "_word")), "_word", "left")
    hit = F.col(column).isNotNull() & F.coalesce(F.expr("getbit(bits, _bit) = 1"), F.lit(False))
    return marked.filter(hit).select(*df.columns), marked.filter(~hit).select(*df.columns)
