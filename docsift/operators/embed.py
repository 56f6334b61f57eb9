"""Vectors of texts: a deterministic hashed embedder, and a place for a model.

The hashed embedder needs no weights: lower-case words fall into ``DIM`` buckets
by md5, and counts are normalised.  It is lexical, not semantic.  A model is
plugged in as an ``Embedder`` whose ``encode`` maps a list of texts to a matrix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 384
SEPARATOR = r"[^\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")


def tokens(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), SEPARATOR), lambda w: w != "")


def bucket(token: Column) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % DIM).cast("int")


def sparse(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, weight of each text's hashed vector, of length 1."""
    counts = df.select(key, F.explode(tokens(text)).alias("w")).select(key, bucket(F.col("w")).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def hashed(c: Column | str) -> Column:
    """array<double> of the hashed vector, all zero for a text without words; no shuffle."""
    buckets = F.transform(tokens(c), bucket)
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), DIM), lambda a, b: F.transform(a, lambda x, i: F.when(i == b, x + 1).otherwise(x)))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def hashed_buckets(text: str | None, known: dict[str, int]) -> list[int]:
    """The bucket of every word of a text; ``known`` keeps those of words met before."""
    ws = _WORD.findall((text or "").lower())
    try:
        return [known[w] for w in ws]
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        for w in ws:
            if w not in known:
                known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DIM
        return [known[w] for w in ws]


def hashed_matrix(texts: list[str | None]) -> np.ndarray:
    """Rows of hashed vectors, as ``sparse`` gives them."""
    out, known = np.zeros((len(texts), DIM), np.float64), {}
    for i, t in enumerate(texts):
        for b in hashed_buckets(t, known):
            out[i, b] += 1
    norms = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def embedder_udf(make: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_matrix) -> Callable[..., Column]:
    """An iterator Arrow UDF text -> array<float>; ``make`` loads the model once per task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            yield pd.Series(list(encode(texts.tolist()).astype(np.float32)))

    return embed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is all zero, null if lengths differ or a value is missing."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm)))


def with_vectors(sections: DataFrame, text: str, vector: str, udf: Callable[..., Column] | None = None) -> DataFrame:
    """Sections with a vector for every row: stored ones stay, missing ones are computed.

    The rows are split before the UDF, for a condition around a UDF does not
    keep it from running on every row.
    """
    udf = udf or embedder_udf()
    stored = sections.filter(F.col(vector).isNotNull())
    missing = sections.filter(F.col(vector).isNull()).withColumn(vector, udf(F.coalesce(F.col(text), F.lit(""))))
    return stored.unionByName(missing.select(*sections.columns))
