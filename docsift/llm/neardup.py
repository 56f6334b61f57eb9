"""Problem 2: near-duplicate texts by a chosen-path join over word shingles.

Each text becomes the set of its word shingles.  Texts with equal sets form a
class with one representative; only representatives are joined.  A set is
embedded as minima of hash functions, each of which is a sampled token of the
set.  A path starts with one sampled token and all sets that chose it share a
bucket.  A bucket of at most ``BUCKET`` sets is compared directly by 128-bit
sketches; a larger one is split again on further sampled tokens, two per level.
Every pair that the sketches let pass is verified on the full sets.

Each split may lose a pair, so the number of first tokens follows from the
target recall and the depth that splitting really reached: after a run with the
tokens for one level, sets that may still be missed, by the splits of their own
buckets, meet each other on further tokens.  A pair leaves when either set does,
so each set may miss half of what the recall allows.  Tokens of splits are drawn from ``SPLITS`` hash functions of their own;
that a pair may agree on few of these is part of the computation.

A bucket that is still too large after ``DEPTH`` splits holds sets that agree on
all sampled tokens; it is compared in blocks, so no bucket is given up.

Defined results: null or empty texts, and texts with fewer than ``min_words``
words or fewer than one shingle, take part in nothing; a repeated key with the
same text is one record; null keys are left out; empty tables give empty
results.  Members of a class of at most ``expand`` texts are listed with all
their partners; in a larger class of copies each member is paired with the
representative, which alone carries the links to other texts.  Only the key and
text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.words import WORD, by_batch
from docsift.reduce import divided, reduced, reducer
from docsift.stage import Stage

SHINGLE, SIMILARITY = 5, 0.8
RECALL = 0.998
#: What each set of a pair has to reach for that recall.
EACH = 1 - (1 - RECALL) / 2
BUCKET, DEPTH, EXPAND = 1000, 6, 64
#: Hash functions for the tokens of splits and, one bit each, for the sketch.
SPLITS, BITS = 16, 128
_RNG = np.random.default_rng(20240229)
_P = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sorted 64-bit shingle hashes of texts; word hashes are kept between texts."""

    def __init__(self, n: int, min_words: int):
        self.n, self.least, self.seen = n, max(n, min_words), {}

    def __call__(self, text: str | None) -> np.ndarray | None:
        ws = WORD.findall(text.lower()) if text else []
        if len(ws) < self.least:
            return None
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        try:
            ids = [seen[w] for w in ws]
        except KeyError:
            for w in ws:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            ids = [seen[w] for w in ws]
        h = np.array(ids, np.uint64)
        m = len(h) - self.n + 1
        with np.errstate(over="ignore"):
            s = np.zeros(m, np.uint64)
            for k in range(self.n):
                s = (s ^ h[k : k + m]) * _P[k]
                s ^= s >> np.uint64(31)
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


@lru_cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of n hash functions, the same for every process."""
    rng = np.random.default_rng(5)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], paths: int) -> tuple[np.ndarray, np.ndarray]:
    """Path tokens (rows x paths, 32 bits) and sketches (rows x 2, 64 bits) of shingle sets."""
    tokens = np.empty((len(sets), paths), np.uint32)
    bits = np.empty((len(sets), BITS), np.uint8)
    factor, addend = _hashes(paths + BITS)
    for i in range(0, len(sets), 128):
        part = sets[i : i + 128]
        x = np.concatenate(part)
        at = np.cumsum([0] + [len(p) for p in part[:-1]])
        with np.errstate(over="ignore"):
            for k in range(paths + BITS):
                low = np.minimum.reduceat((x * factor[k] + addend[k]) >> np.uint64(20), at)
                if k < paths:
                    tokens[i : i + len(part), k] = (low * _P[3] >> np.uint64(32)).astype(np.uint32)
                else:
                    bits[i : i + len(part), k - paths] = (low * _P[4] >> np.uint64(63)).astype(np.uint8)
    return tokens, np.packbits(bits, axis=1).view(np.int64)


def missed(similarity: float, first: int, depth: int) -> float:
    """Chance that a pair is in no common bucket: ``first`` tokens, each followed by ``depth`` splits on two tokens."""
    return float(_weights(similarity) @ _apart(similarity, depth) ** first)


def _weights(similarity: float) -> np.ndarray:
    """Chances that a pair agrees on 0 to SPLITS of the hash functions for splits."""
    return np.array([math.comb(SPLITS, n) * similarity**n * (1 - similarity) ** (SPLITS - n) for n in range(SPLITS + 1)])


def _apart(similarity: float, depth: int) -> np.ndarray:
    """Chances that one first token and ``depth`` splits bring a pair into no common bucket, by the hash functions agreed on."""
    share, below = np.arange(SPLITS + 1) / SPLITS, np.ones(SPLITS + 1)
    for _ in range(depth):
        below = 1 - (1 - share * below) ** 2
    return 1 - similarity * below


@lru_cache
def roots(similarity: float, depth: int, recall: float = RECALL) -> int:
    """First tokens needed for the recall where buckets are split so often."""
    n = 1
    while missed(similarity, n, depth) > 1 - recall:
        n += 1
    return n


def tokens_at_first(similarity: float) -> int:
    """First tokens of every set; only sets whose buckets were split too often get more."""
    return max(roots(similarity, 1), roots(similarity, 0, EACH))


def _least_agreement(similarity: float) -> int:
    """Sketch bits that agree at least, four standard deviations under the expectation at the threshold."""
    p = (1 + similarity) / 2
    return math.floor(BITS * p - 4 * math.sqrt(BITS * p * (1 - p)))


SKETCHED = "k long, cls binary, n int, tokens array<int>, lo long, hi long"


def sketched(df: DataFrame, key: str, text: str, n: int, min_words: int, paths: int) -> DataFrame:
    """One row per record: k, class digest, set size, path tokens and sketch."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")

    def make():
        shingle = Shingler(n, min_words)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, sets = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (s := shingle(t)) is not None:
                    keys.append(k)
                    sets.append(s)
            if not keys:
                return None
            tokens, sketch = signatures(sets, paths)
            offsets = pa.array(np.arange(0, paths * len(keys) + 1, paths, dtype=np.int32))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(offsets, pa.array(tokens.view(np.int32).ravel())), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]),
                ],
                ["k", "cls", "n", "tokens", "lo", "hi"],
            )

        return run

    return by_batch(rows, make, SKETCHED)


def _compare(sizes: np.ndarray, ids: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside buckets (rows of one bucket adjoin) whose sizes and sketches allow the similarity."""
    least = _least_agreement(similarity)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(ids))
    left, right = [], []
    d = 1
    live = at[at + d < end]
    while len(live):
        other = live + d
        same = BITS - np.bitwise_count(lo[live] ^ lo[other]).astype(np.int32) - np.bitwise_count(hi[live] ^ hi[other])
        a, b = n[live], n[other]
        ok = (same >= least) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (ids[live] != ids[other])
        left.append(ids[live[ok]])
        right.append(ids[other[ok]])
        d += 1
        live = live[live + d < end[live]]
    a, b = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
    return np.minimum(a, b), np.maximum(a, b)


def _bucket_pairs(buckets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of buckets given as arrays of (k, n, lo, hi)."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(0)
            rows = lists.flatten()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            k, n, lo, hi = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            lo, hi = np.ascontiguousarray(lo).view(np.uint64), np.ascontiguousarray(hi).view(np.uint64)
            pairs = np.unique(np.stack(_compare(sizes, k, n, lo, hi, similarity), 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        return run

    return by_batch(buckets.select("rows"), make, "a long, b long")


def _gather(rows: DataFrame, counts: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of the buckets in ``counts``, none of which exceeds BUCKET rows."""
    member = F.struct("k", "n", "lo", "hi")
    paths = counts.select("path")
    buckets = reduced(rows, "path", reducer(paths, "path")).join(paths, "path").groupBy("path").agg(F.collect_list(member).alias("rows"))
    return _bucket_pairs(buckets, similarity)


def candidates(reps: DataFrame, stage: Stage, similarity: float, again: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """a, b (a < b): pairs of representatives that some bucket brought together. reps: sketched rows with ``tokens_at_first``; again: sketched rows of some keys with so many tokens."""
    used, need = 0, tokens_at_first(similarity)
    rows, out, splits, unsure, deepest = reps, None, None, None, 0
    while used < need:
        found, depth, deep = _run(rows, stage, similarity, used, need)
        out = found if out is None else out.union(found)
        deepest = max(deepest, depth)
        used, need = need, roots(similarity, deepest, EACH)
        if deep is None or used >= need:
            break
        splits = deep if splits is None else splits.union(deep)
        still = _unsure(splits, similarity, used)
        unsure = stage.save(still if unsure is None else still.join(unsure, "k", "left_semi"), "unsure")
        if unsure.isEmpty():
            break
        rows = stage.save(again(unsure, SPLITS + need), "again")
    return out.distinct()


def _unsure(splits: DataFrame, similarity: float, used: int) -> DataFrame:
    """k of the sets that may miss more than their part; splits: k, r (first token), depth of its splits, of which the deepest counts."""
    depths = splits.groupBy("k", "r").agg(F.max("depth").alias("depth")).groupBy("k").agg(F.collect_list("depth").alias("depths"))
    weights, apart = _weights(similarity), np.stack([_apart(similarity, d) for d in range(DEPTH + 1)])

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.bincount(x, minlength=len(apart)) for x in batch.column(1).to_pylist()]
            n = np.array(rows, np.int64).reshape(-1, len(apart))
            n[:, 0] = used - n.sum(1)
            miss = np.exp(n @ np.log(apart)) @ weights
            return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(miss > 1 - EACH))], ["k"])

        return run

    return by_batch(depths, make, "k long")


def _run(reps: DataFrame, stage: Stage, similarity: float, begin: int, end: int) -> tuple[DataFrame, int, DataFrame | None]:
    """Pairs by the first tokens from ``begin`` to ``end``, how often buckets were split, and k, r, depth of what was split.

    Rows and pairs of every level are written before the next, so that no plan holds
    more than one level and no level is computed again for those below it.
    """
    first = F.slice("tokens", SPLITS + begin + 1, end - begin)
    rows = reps.select("k", "n", "lo", "hi", F.posexplode(first).alias("r", "token")).select(F.xxhash64(F.col("r") + begin, "token").alias("path"), "k", "n", "lo", "hi", (F.col("r") + begin).alias("r"))
    out, deep, above = None, None, []
    for level in range(DEPTH + 1):
        if level:
            rows = stage.save(rows, f"rows{level}")
            split = stage.save(rows.select("k", "r").distinct().withColumn("depth", F.lit(level)), f"split{level}")
            deep = split if deep is None else deep.union(split)
        for done in above:
            stage.drop(done)
        counts = stage.save(rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), f"sizes{level}")
        above = [rows, counts]
        found = stage.save(_gather(rows, counts.filter(F.col("size") <= BUCKET), similarity), f"pairs{level}")
        out = found if out is None else out.union(found)
        large = counts.filter(F.col("size") > BUCKET).select("path", "size")
        if large.isEmpty():
            break
        inside = reduced(rows, "path", reducer(large, "path")).join(large, "path")
        if level == DEPTH:
            # blocks of a bucket, each met with each: every row goes to the cells of its block's row and column
            blocks = F.ceil(F.col("size") / (BUCKET / 2)).cast("int")
            own = F.pmod(F.xxhash64("k", "path"), blocks.cast("long")).cast("int")
            cell = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
            spread = inside.select("k", "n", "lo", "hi", "path", F.explode(cell).alias("c")).select(F.xxhash64("path", "c.i", "c.j").alias("path"), "k", "n", "lo", "hi")
            out = out.union(stage.save(_gather(spread, spread.select("path").distinct(), similarity), "blocks"))
            break
        tokens = reps.select(F.col("k").alias("id"), F.slice("tokens", 1, SPLITS).alias("tokens"))
        pick = [F.pmod(F.xxhash64("path", F.lit(level), F.lit(j)), F.lit(SPLITS)).cast("int") for j in range(2)]
        chosen = F.explode(F.array(*[F.struct(p.alias("c"), F.element_at("tokens", p + 1).alias("token")) for p in pick]))
        rows = inside.join(tokens, F.col("k") == F.col("id")).select("path", "k", "n", "lo", "hi", "r", chosen.alias("x")).select(F.xxhash64("path", "x.c", "x.token").alias("path"), "k", "n", "lo", "hi", "r")
    for done in above:
        stage.drop(done)
    return out, level, deep


def _sets(df: DataFrame, wanted: DataFrame, key: str, text: str, n: int, min_words: int) -> DataFrame:
    """k, s (shingle hashes) of the wanted keys."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    rows = reduced(rows, "k", reducer(wanted, "k")).join(wanted, "k", "left_semi")

    def make():
        shingle = Shingler(n, min_words)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            got = [(k, s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := shingle(t)) is not None]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([s.view(np.int64) for _, s in got], pa.list_(pa.int64()))], ["k", "s"]) if got else None

        return run

    return by_batch(rows, make, "k long, s array<long>").dropDuplicates(["k"])


def joined(df: DataFrame, key: str, text: str, n: int = SHINGLE, similarity: float = SIMILARITY, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): verified pairs (a, b, similarity) of representatives, and k, rep, copies of every record."""
    stage = Stage(df.sparkSession, "neardup")
    rows = stage.save(sketched(df, key, text, n, min_words, SPLITS + tokens_at_first(similarity)), "sketched")
    # sketches are long: only those of classes that may have several rows are shuffled and written again
    repeated = rows.groupBy("cls").agg(F.count("*").alias("rows")).filter("rows > 1")
    some, others = divided(rows, "cls", stage.save(reducer(repeated, "cls"), "repeated"))
    head = F.min(F.struct("k", "n", "tokens", "lo", "hi")).alias("r")
    heads = some.groupBy("cls").agg(head, F.max("k").alias("last")).select("cls", "r.*", (F.col("last") > F.col("r.k")).alias("several"))
    reps = stage.save(heads, "heads").unionByName(others.withColumn("several", F.lit(False)))

    def again(keys: DataFrame, paths: int) -> DataFrame:
        texts = reduced(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), "k", reducer(keys, "k")).join(keys, "k", "left_semi")
        return sketched(texts, "k", "t", n, min_words, paths).dropDuplicates(["k"])

    found = stage.save(candidates(reps, stage, similarity, again), "candidates")
    wanted = found.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    sets = stage.save(_sets(df, wanted, key, text, n, min_words), "sets")
    both = found.join(sets.withColumnsRenamed({"k": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"k": "b", "s": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    value = common / (F.size("sa") + F.size("sb") - common)
    pairs = stage.save(both.select("a", "b", value.alias("similarity")).filter(F.col("similarity") >= similarity), "pairs")
    stage.drop(sets)
    shared = reps.filter("several").select("cls", F.col("k").alias("rep"))
    copies = reduced(rows.select("k", "cls"), "cls", reducer(shared, "cls")).distinct().join(shared, "cls")
    sizes = copies.groupBy("rep").agg(F.count("*").alias("copies"))
    members = copies.join(sizes, "rep").select("k", "rep", "copies")
    return pairs, members.union(reps.filter("not several").select("k", F.col("k").alias("rep"), F.lit(1).cast("long").alias("copies")))


def found(df: DataFrame, key: str = "section_id", text: str = "section_text", n: int = 3, similarity: float = 0.6, min_words: int = 20, expand: int = EXPAND) -> DataFrame:
    """section_id_a, section_id_b: every similar pair, smaller key first; see the module on large classes of copies."""
    pairs, members = joined(df, key, text, n, similarity, min_words)
    small = members.filter(F.col("copies") <= expand)
    lists = small.filter("copies > 1").groupBy("rep").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    within = lists.select(F.posexplode("ks").alias("i", "a"), "ks").select("a", F.explode(F.expr("slice(ks, i + 2, size(ks))")).alias("b"))
    star = members.filter((F.col("copies") > expand) & (F.col("k") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("k").alias("b"))
    side = lists.select("rep", "ks")
    one = lambda c: F.coalesce(F.col(f"ks_{c}"), F.array(c))
    across = (
        pairs.select("a", "b")
        .join(side.withColumnsRenamed({"rep": "a", "ks": "ks_a"}), "a", "left")
        .join(side.withColumnsRenamed({"rep": "b", "ks": "ks_b"}), "b", "left")
        .select(F.explode(one("a")).alias("x"), one("b").alias("ys"))
        .select("x", F.explode("ys").alias("y"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return across.union(within).union(star).select(F.col("a").alias("section_id_a"), F.col("b").alias("section_id_b"))


def links(df: DataFrame, key: str = "section_id", text: str = "section_text", n: int = SHINGLE, similarity: float = SIMILARITY, min_words: int = 0) -> DataFrame:
    """section_id, class_id, copies, links: one row per record; links counts the other classes its text is similar to."""
    pairs, members = joined(df, key, text, n, similarity, min_words)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(degree, "rep", "left")
    return out.select(F.col("k").alias("section_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
