"""Problem 7: filling training sequences with whole documents by minimum bin slack.

Documents are measured in tokens of a public tokenizer.  Packing needs only the
number of documents of each length, at most ``capacity`` numbers, so it runs on
the driver over a bounded table whatever the size of the corpus.  For each bin a
bitset subset-sum programme over the lengths still available finds the fullest
combination; that combination is then taken as often as the supply lasts, which
is what taking it bin by bin would do.  Documents get their place from their
rank among those of their length; ranks are counted in salted groups, so no
length, however common, meets in one task.

A document longer than a sequence is divided: its full sequences stand alone and
the rest is packed like a document.

Defined results: null and empty texts have 0 tokens and get no place; a repeated
key is one document (its largest token count); a null key gets no place; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.llm.words import by_batch
from docsift.stage import Stage

CAPACITY = 2048
VOCABULARY = os.environ.get("DOCSIFT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SALTS = 256


def encoder(path: str):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of every document."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).filter("doc_id is not null and t is not null and t <> ''")

    def make():
        encode = encoder(path).encode_ordinary

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(encode(t)) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["doc_id", "tokens"])

        return run

    return by_batch(rows, make, "doc_id long, tokens int").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Length -> copies of a combination with the largest total <= room.

    available: (length, copies) in falling order of length.  The reachable totals
    after each length are kept as the bits of one integer.
    """
    mask = (1 << (room + 1)) - 1
    reach, states = 1, []
    for length, copies in available:
        states.append((reach, length))
        left, step = min(copies, room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length in reversed(states):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            out[length] = n
        if not total:
            break
    return out


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, repeats) of all bins: each bin holds the longest length left and the fullest combination with it."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        first = order[0]
        left[first] -= 1
        rest = fullest([(n, left[n]) for n in order if left[n] and n <= capacity - first], capacity - first)
        left[first] += 1
        rest[first] = rest.get(first, 0) + 1
        times = min(left[n] // k for n, k in rest.items())
        for n, k in rest.items():
            left[n] -= k * times
        out.append((rest, times))
        if any(not left[n] for n in rest):
            order = [n for n in order if left[n]]
    return out


def places(combos: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies per bin, first bin, offset of the first copy) for each length of each combination."""
    rank: dict[int, int] = {}
    out, at = [], 0
    for combo, times in combos:
        offset = 0
        for n in sorted(combo, reverse=True):
            k = combo[n]
            start = rank.get(n, 0)
            out.append((n, start, start + k * times, k, at, offset))
            rank[n] = start + k * times
            offset += k * n
        at += times
    return out


def packed(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, part, sequence_no, position, tokens: the place of each document, or of each part of a divided one."""
    spark: SparkSession = counts.sparkSession
    docs = Stage(spark, "pack").save(counts.filter("tokens > 0"), "tokens")
    items = docs.select(
        "doc_id", F.floor(F.col("tokens") / capacity).cast("int").alias("full"), (F.col("tokens") % capacity).cast("int").alias("rest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    sums = items.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("fulls"))
    # at most capacity x SALTS rows; only sums per length go to the driver
    per_length = sums.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("fulls").alias("fulls")).collect()
    combos = patterns({r.rest: r.n for r in per_length if r.rest}, capacity)
    bins = sum(t for _, t in combos)
    table = spark.createDataFrame(places(combos) or [], "rest int, low long, high long, copies int, first_bin long, offset int")

    by_salt = W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("rest", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("base"))
    ranked = items.withColumn("nth", F.row_number().over(W.partitionBy("rest", "salt").orderBy("doc_id")) - 1)
    ranked = ranked.join(base, ["rest", "salt"]).withColumn("rank", F.col("base") + F.col("nth"))
    rests = (
        ranked.filter("rest > 0")
        .join(F.broadcast(table), "rest")
        .filter("rank >= low and rank < high")
        .select(
            "doc_id", F.col("full").alias("part"),
            (F.col("first_bin") + F.floor((F.col("rank") - F.col("low")) / F.col("copies"))).cast("long").alias("sequence_no"),
            (F.col("offset") + F.pmod(F.col("rank") - F.col("low"), F.col("copies")) * F.col("rest")).cast("int").alias("position"),
            F.col("rest").alias("tokens"),
        )
    )
    before = W.partitionBy("one").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    long = items.filter("full > 0").withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4096)))
    slots = long.groupBy("slot").agg(F.sum("full").alias("fulls")).withColumn("one", F.lit(1))
    slots = slots.select("slot", F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("slot").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("prior", F.coalesce(F.sum("full").over(within), F.lit(0))).join(slots, "slot")
    fulls = long.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), (F.col("base") + F.col("prior")).alias("at")).select(
        "doc_id", "part", (F.lit(bins) + F.col("at") + F.col("part")).cast("long").alias("sequence_no"), F.lit(0).alias("position"), F.lit(capacity).alias("tokens")
    )
    return rests.unionByName(fulls)
