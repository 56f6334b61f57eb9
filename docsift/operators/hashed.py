"""The k best sections of every question under the hashed embedder, by whole-number arithmetic.

A hashed vector is a row of word counts over its length, so a score is a whole
number over the product of two lengths.  Sections are written once as blocks of
counts, ordered by length; tasks hold questions and go through all blocks, adding
one row of counts per word of a question.  Questions are sorted so that the
next one begins with words of the last one, whose partial sums are kept.  The k-th
best score so far is a lower limit for what a block, and in it a segment of
sections of about one length, must reach; no score that could enter is left out.

Sections that can't be told apart by score and fingerprint stand for each other,
the smallest key (``k`` of them where near-duplicates stay) going first, and
questions of equal words and term are answered once.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.functions import text as X
from docsift.operators.embed import DIM, hashed_buckets
from docsift.stage import Stage

#: Sections in a block: a row of counts stays in the cache.
BLOCK = 16384
#: Sections in a segment, which is looked into only if its largest sum can be reached by a score that enters.
SEGMENT = 256
#: Questions whose sums over a block are compared at once.
ASKED = 64
#: Scores are rounded before they are compared, so that ties don't depend on the order of summation.
DECIMALS = 9
BOOST = 0.1
#: Bits of a count where bucket and count are one whole number; a larger count is written in parts.
_BITS = 23


def _counts(buckets: list[int]) -> bytes:
    """Buckets and counts of a text, by bucket."""
    n = np.bincount(np.array(buckets, np.int64), minlength=DIM)
    at = np.flatnonzero(n)
    parts = [(at << _BITS) + np.minimum(n[at], 2**_BITS - 1)]
    while (n := np.maximum(n - (2**_BITS - 1), 0)).any():
        at = np.flatnonzero(n)
        parts.append((at << _BITS) + np.minimum(n[at], 2**_BITS - 1))
    return np.concatenate(parts).astype("<u4").tobytes()


def _length2(buckets: list[int]) -> int:
    n = np.bincount(np.array(buckets, np.int64), minlength=1)
    return int((n * n).sum())


def _section_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        texts, counts, length2 = b.column(1).to_pylist(), [], []
        for begin in range(0, len(texts), 256):
            found = [hashed_buckets(t, known) for t in texts[begin : begin + 256]]
            sizes = np.array([len(x) for x in found])
            if sizes.max() >= 2**_BITS:
                counts += [_counts(x) for x in found]
                length2 += [_length2(x) for x in found]
                continue
            m = np.bincount(np.repeat(np.arange(len(found)) * DIM, sizes) + np.array([w for x in found for w in x], np.int64), minlength=DIM * len(found)).reshape(-1, DIM)
            row, at = np.nonzero(m)
            flat, cuts = ((at << _BITS) + m[row, at]).astype("<u4"), np.searchsorted(row, np.arange(len(found) + 1)).tolist()
            counts += [flat[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
            length2 += (m * m).sum(1).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.binary()), pa.array(length2, pa.int64())], ["k", "fp", "counts", "length2"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of length as blocks: keys, fingerprints, lengths, counts by bucket, and the places of each term."""
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        coded = rows.column("counts").to_pylist()
        sizes = [len(c) // 4 for c in coded]
        flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
        m = np.bincount((flat >> _BITS) * n + np.repeat(np.arange(n), sizes), weights=flat & (2**_BITS - 1), minlength=DIM * n)
        kind = "<u1" if m.max(initial=0) < 2**8 else "<u4"
        terms = [(t, i) for i, x in enumerate(rows.column("terms").to_pylist()) for t in x or ()]
        terms.sort()
        whole = lambda name: rows.column(name).to_numpy().astype("<i8").tobytes()
        cells = [whole("k"), whole("fp"), whole("length2"), m.astype(kind).tobytes(), np.array([t for t, _ in terms], "<i8").tobytes(), np.array([i for _, i in terms], "<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([int(rows.column("length2")[0].as_py())], pa.int64()), pa.array([n], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["least", "n", "k", "fp", "length2", "counts", "term", "place"])

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        while size >= BLOCK:
            rows = pa.Table.from_batches(held)
            yield block(rows.slice(0, BLOCK))
            held = rows.slice(BLOCK).to_batches()
            size -= BLOCK
    if size:
        yield block(pa.Table.from_batches(held))


_BLOCK_SCHEMA = "least long, n int, k binary, fp binary, length2 binary, counts binary, term binary, place binary"


def _sections(sections: DataFrame, key: str, text: str, asked: DataFrame | None, stage: Stage, k: int, dedup: bool) -> DataFrame:
    """The written blocks of all sections; ``asked``: key, term (as a number) of what sections define."""
    fp = F.xxhash64(X.fingerprint(text)) if dedup else F.lit(0).cast("long")  # without removal nobody reads it
    rows = sections.select(F.col(key).cast("long").alias("k"), F.col(text), fp.alias("fp")).filter("k is not null")
    rows = rows.mapInArrow(_section_rows, "k long, fp long, counts binary, length2 long")
    if asked is not None:
        rows = rows.join(asked.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_set("term")).alias("terms")), "k", "left")
    else:
        rows = rows.withColumn("terms", F.expr("cast(null as array<bigint>)"))
    if dedup:
        rows = rows.groupBy("fp", "counts", "length2", "terms").agg(F.min("k").alias("k"))
    else:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("counts", "terms").orderBy("k"))).filter(F.col("_n") <= k)
    rows = rows.select("k", "fp", "length2", "counts", "terms").repartitionByRange("length2").sortWithinPartitions("length2", "k")
    return stage.save(rows.mapInArrow(_blocks, _BLOCK_SCHEMA), "blocks")


def _question_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        rows = [(i, sorted(hashed_buckets(t, known))) for i, t in enumerate(b.column(1).to_pylist()) if t is not None and t.strip()]
        if rows:
            at = pa.array([i for i, _ in rows])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array([x for _, x in rows], pa.list_(pa.int32()))], ["id", "term", "buckets"])


def retrieve(sections: DataFrame, questions: DataFrame, key: str, text: str, per: str, question: str, k: int, least: float | None, boost: bool, dedup: bool) -> DataFrame:
    """per, key, score, rank of the k best sections of every question."""
    from docsift.operators.retrieve import defined_terms, definitions

    spark = sections.sparkSession
    stage = Stage(spark, "retrieve")
    q = questions.select(F.col(per).cast("long").alias("id"), F.col(question).alias("q")).filter("id is not null and q is not null")
    said = None
    if boost:
        terms = stage.save(defined_terms(q, "id", "q"), "terms")
        said = stage.save(definitions(sections, key, text, terms).select(key, F.xxhash64("term").alias("term")), "said")
        q = q.join(terms.select("id", F.xxhash64("term").alias("term")), "id", "left")
    else:
        q = q.withColumn("term", F.lit(None).cast("long"))
    blocks = _sections(sections, key, text, said, stage, k, dedup)
    q = stage.save(q.select("id", "q", "term").mapInArrow(_question_rows, "id long, term long, buckets array<int>"), "questions")
    often = {r.b: n for n, r in enumerate(q.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "b").collect())}
    place = F.array(*[F.lit(often.get(b, 0)) for b in range(DIM)])
    ordered = F.array_sort(F.transform("buckets", lambda b: F.element_at(place, b + 1)))
    distinct = q.groupBy(ordered.alias("words"), "term").agg(F.collect_list("id").alias("ids"))
    tasks = spark.sparkContext.defaultParallelism * 3
    spread = distinct.repartitionByRange(tasks, "words").sortWithinPartitions("words")
    found = spread.mapInArrow(_scan(sorted(blocks.inputFiles()), sorted(often, key=often.get), k, least, dedup), "ids array<long>, found array<struct<k:long,score:double>>")
    rows = found.select(F.explode("ids").alias(per), "found").select(per, F.posexplode("found").alias("rank", "x"))
    return rows.select(per, F.col("x.k").alias(key), "x.score", (F.col("rank") + 1).alias("rank"))


def _read(files: list[str]) -> Iterator[dict]:
    """The blocks, of which one is held at a time, shortest sections first as far as the files are in order."""
    for f in files:
        system, path = pf.FileSystem.from_uri(f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file:///") else f)
        with system.open_input_file(path) as source:
            for b in pq.ParquetFile(source).iter_batches(batch_size=1):
                if b.num_rows:
                    yield b.to_pylist()[0]


def _best(score: np.ndarray, keys: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of different groups; equal scores go by key."""

    def first(at: np.ndarray) -> list[int]:
        seen: set[int] = set()
        out = []
        for i in at[np.lexsort((keys[at], -score[at]))].tolist():
            g = int(group[i])
            if g not in seen:
                seen.add(g)
                out.append(i)
                if len(out) == k:
                    break
        return out

    some = 8 * k
    if len(score) > 2 * some:
        out = first(np.flatnonzero(score >= np.partition(score, len(score) - some)[len(score) - some]))
        if len(out) == k:
            return np.array(out, np.int64)
    return np.array(first(np.arange(len(score))), np.int64)


def _enter(best: list[tuple[float, int, int]], score: list[float], keys: list[int], group: list[int], k: int) -> None:
    """Enter sections into the sorted k best of different groups; equal scores go by key."""
    for s, c, g in zip(score, keys, group):
        x = (-s, c, g)
        if len(best) == k and x >= best[-1]:
            continue
        at = next((j for j, y in enumerate(best) if y[2] == g), -1)
        if at >= 0:
            if best[at] <= x:
                continue
            del best[at]
        elif len(best) == k:
            del best[-1]
        insort(best, x)


def _scan(files: list[str], buckets: list[int], k: int, least: float | None, dedup: bool):
    floor = -math.inf if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, words = [], [], []
        for b in batches:
            ids.append(b.column(2))
            asked += b.column(1).to_pylist()
            words += b.column(0).to_pylist()
        if not words:
            return
        n = len(words)
        shared = [0] * n
        for i in range(1, n):
            a, b = words[i - 1], words[i]
            j, most = 0, min(len(a), len(b))
            while j < most and a[j] == b[j]:
                j += 1
            shared[i] = j
        flat = np.array([w for x in words for w in x] + [len(buckets)], np.int64)
        starts = np.cumsum([0] + [len(x) for x in words])
        order = np.array([*buckets, 0], np.int64)
        length = np.array([math.sqrt(_length2(x)) or 1.0 for x in words])
        term = np.array([t if t is not None else 0 for t in asked], np.int64)
        has_term = np.array([t is not None for t in asked])
        limit = np.full(n, floor)  # what a score must reach; the k-th best once there are k
        full = np.zeros(n, bool)
        state: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
        largest = np.maximum.reduce
        longest, deepest = float(length.max()), max(map(len, words))
        for block in _read(files):
            size = block["n"]
            keys, fps = np.frombuffer(block["k"], "<i8"), np.frombuffer(block["fp"], "<i8")
            group = fps if dedup else keys
            norms = np.sqrt(np.frombuffer(block["length2"], "<i8").astype(np.float64))
            reach = longest * float(norms.max()) + 1
            norms[norms == 0] = 1
            kind = np.uint8 if reach < 2**8 else np.uint16 if reach < 2**16 else np.int64
            m = np.frombuffer(block["counts"], "<u1" if len(block["counts"]) == DIM * size else "<u4").reshape(DIM, size)
            # one row per word by frequency, filled up to whole segments; lengths bound every sum, so nothing overflows
            width = -(-size // SEGMENT) * SEGMENT
            m, whole = np.zeros((len(order), width), kind), m
            m[:, :size] = whole[order]
            parts = np.pad(norms, (0, width - size), "edge").reshape(-1, SEGMENT)
            low, high = parts.min(1), parts.max(1)
            # no section of the block exceeds the sum of the largest counts
            peak = np.add.reduceat(np.append(m.max(1).astype(np.int64)[flat[:-1]], 0), np.minimum(starts[:-1], len(flat) - 1))
            peak[starts[1:] == starts[:-1]] = 0
            need = np.where(np.isfinite(limit), np.ceil((limit - 1e-8) * length * float(norms.min())), -1)
            places, told = np.frombuffer(block["place"], "<i4"), np.frombuffer(block["term"], "<i8")
            lo, hi = np.searchsorted(told, term, "left"), np.where(has_term, np.searchsorted(told, term, "right"), 0)
            raised = hi > lo
            rows = list(m)
            sums = [np.zeros(width, kind), *(np.empty(width, kind) for _ in range(deepest))]
            whole = np.empty((ASKED, width), kind)
            last = 0
            todo = np.flatnonzero((peak >= need) | raised)
            for begin in range(0, len(todo), ASKED):
                some = todo[begin : begin + ASKED]
                have = 0
                at = list(sums)
                for i, out in zip(some.tolist(), whole):
                    if i != last:
                        have = min(have, shared[i] if i == last + 1 else min(shared[last + 1 : i + 1]))
                        last = i
                    x = words[i]
                    end = len(x) - 1
                    for j in range(have, end):
                        if j:
                            at[j + 1] = np.add(at[j], rows[x[j]], out=sums[j + 1])
                        else:
                            at[1] = rows[x[0]]
                    if have > end:
                        out[:] = at[end + 1]
                    else:
                        at[end + 1] = np.add(at[end], rows[x[end]], out=out)
                    have = end + 1
                dots = whole[: len(some)]
                cells = dots.reshape(len(some), -1, SEGMENT)
                tops = largest(cells, axis=2)
                reach = limit[some]
                few = np.flatnonzero(~full[some])
                if len(few) and k <= len(low) and not dedup:
                    # so many segments hold a section with this score each
                    reach[few] = np.maximum(reach[few], np.partition(tops[few] / high, len(low) - k, axis=1)[:, len(low) - k] / length[some[few]])
                least_dots = ((reach - 1e-8) * length[some])[:, None] * low
                who, segment = np.nonzero(tops >= least_dots)
                row, place = np.nonzero(cells[who, segment] >= least_dots[who, segment][:, None])
                who, new = who[row], segment[row] * SEGMENT + place
                if width > size:
                    who, new = who[new < size], new[new < size]
                score = np.round(dots[who, new] / (length[some[who]] * norms[new]), DECIMALS)
                for w in np.flatnonzero(raised[some]).tolist():
                    i = some[w]
                    more = places[lo[i] : hi[i]]
                    higher = np.round(np.round(dots[w, more] / (length[i] * norms[more]), DECIMALS) + BOOST, DECIMALS)
                    before = np.searchsorted(who, w)
                    who, new, score = np.insert(who, before, np.full(len(more), w)), np.insert(new, before, more), np.insert(score, before, higher)
                ok = score >= limit[some[who]]
                who, new, score = who[ok], new[ok], score[ok]
                cuts = [0, *(np.flatnonzero(np.diff(who)) + 1).tolist(), len(who)] if len(who) else []
                scores, found, groups = score.tolist(), keys[new].tolist(), group[new].tolist()
                for a, z in zip(cuts, cuts[1:]):
                    i = int(some[who[a]])
                    best = state[i]
                    if z - a > 8 * k:
                        enter = (a + _best(score[a:z], keys[new[a:z]], group[new[a:z]], k)).tolist()
                        _enter(best, [scores[e] for e in enter], [found[e] for e in enter], [groups[e] for e in enter], k)
                    else:
                        _enter(best, scores[a:z], found[a:z], groups[a:z], k)
                    if len(best) == k:
                        full[i], limit[i] = True, -best[-1][0]
        chunks = pa.chunked_array(ids).combine_chunks()
        for a in range(0, n, 1024):
            part = state[a : a + 1024]
            offsets = np.cumsum([0] + [len(x) for x in part]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array([c for x in part for _, c, _ in x], pa.int64()), pa.array([-s for x in part for s, _, _ in x], pa.float64())], ["k", "score"])
            yield pa.RecordBatch.from_arrays([chunks.slice(a, len(part)), pa.ListArray.from_arrays(pa.array(offsets), rows)], ["ids", "found"])

    return run
