"""Problem 8: evaluation passages inside corpus documents.

The passages are a stated query set, held as hashes of their word n-grams in
blocks of at most ``BLOCK_WORDS`` words, so what a block broadcasts is bounded
and a larger set only takes more passes.  Every word n-gram of a passage is a
seed, however many documents hold it, so any ``GRAM`` words in a row that a
document shares with a passage are met.  One pass over the documents a block
joins seeds to documents, merges near shifts of a passage and aligns passage and
surroundings by Smith-Waterman over words, which also scores edited copies; the
longest exact run is read off the same matrix.  Document texts are never
shuffled.

Defined results: null or empty texts and passages give nothing; passages with
fewer than ``GRAM`` words have no seed and give nothing; a repeated document
key gives its best row; null keys give nothing; empty tables give an empty
result.  Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.words import WORD, by_batch, words

GRAM, RUN = 6, 15
BLOCK_WORDS = 1_000_000
#: Shifts, and words of a row of alignments, that are held at once.
SHIFTS, CELLS = 1_000_000, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
#: Words beyond the passage's ends that are aligned too.
PAD = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(ids: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of each run of n word numbers; 0 where a run holds an unknown word (number 0)."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    m = len(ids) - n + 1
    h, known = np.zeros(m, np.uint64), np.ones(m, bool)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = ids[k : k + m]
            h = h * _BASE + part.astype(np.uint64)
            known &= part > 0
        h ^= h >> np.uint64(29)
    h[~known] = 0
    return h


class Passages:
    """One block of passages as word numbers and n-gram hashes."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.number: dict[str, int] = {}
        self.items = [(i, np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64)) for i, ws in items]
        self.length = np.array([len(ids) for _, ids in self.items], np.int64)
        hashes = [gram_hashes(ids) for _, ids in self.items]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        place = np.concatenate([*(np.arange(len(x)) for x in hashes), np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        #: Places in passages by n-gram: those of grams[g] are first[g] to first[g + 1].
        self.grams, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item, self.place = item[order], place[order]


def _numbers(texts: list[str | None], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a batch of texts, set apart by GRAM noughts, and where each text begins."""
    get, gap = number.get, [0] * GRAM
    all_ids: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(all_ids))
        if t:
            all_ids += [get(w, 0) for w in WORD.findall(t.lower())]
        all_ids += gap
    return np.array(all_ids, np.int64), np.array(starts + [len(all_ids)], np.int64)


def _hits(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted n-grams and their index."""
    h = gram_hashes(ids)
    some = np.flatnonzero(h)
    if not len(wanted) or not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, h[some]), len(wanted) - 1)
    ok = wanted[at] == h[some]
    return some[ok], at[ok]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and longest exact run of each (passage, segment), all pairs at once."""
    m, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    left, right = np.full((len(pairs), m), -1, np.int32), np.full((len(pairs), n), -2, np.int32)
    for k, (a, b) in enumerate(pairs):
        left[k, : len(a)], right[k, : len(b)] = a, np.where(b > 0, b, -3)
    score, run = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32)
    above, runs = np.zeros((len(pairs), n + 1), np.int32), np.zeros((len(pairs), n + 1), np.int32)
    slope = np.arange(n + 1, dtype=np.int32) * GAP
    for i in range(m):
        same = right == left[:, i : i + 1]
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        nxt = np.zeros_like(runs)
        nxt[:, 1:] = (runs[:, :-1] + 1) * same
        above, runs = row, nxt
        np.maximum(score, row.max(axis=1), out=score)
        np.maximum(run, nxt.max(axis=1), out=run)
    return score, run


def _jobs(index: Passages, starts: np.ndarray, doc: np.ndarray, pos: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Document, passage, begin and end of each stretch to align: shifts of a passage at most PAD apart are one.  Last, its longest run of words in step."""
    n = index.first[which + 1] - index.first[which]
    at = np.repeat(index.first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, d, pos = index.item[at], np.repeat(doc, n), np.repeat(pos, n)
    shift = pos - index.place[at]
    order = np.lexsort((pos, shift, item, d))
    item, d, shift, pos = item[order], d[order], shift[order], pos[order]
    other = (d[1:] != d[:-1]) | (item[1:] != item[:-1])
    broken = np.append(True, other | (shift[1:] != shift[:-1]) | (pos[1:] - pos[:-1] != 1))
    every = np.arange(len(d))
    step = every - np.maximum.accumulate(np.where(broken, every, 0)) + GRAM
    new = np.flatnonzero(other | (shift[1:] - shift[:-1] > PAD)) + 1
    first, last = np.append(0, new), np.append(new, len(d)) - 1
    d, item, step = d[first], item[first], np.maximum.reduceat(step, first)
    return np.stack([d, item, np.maximum(starts[d], shift[first] - PAD), np.minimum(starts[d + 1] - GRAM, shift[last] + index.length[item] + PAD), step], 1)


def _within_reach(jobs: np.ndarray, index: Passages, ids: np.ndarray, run: int, coverage: float) -> np.ndarray:
    """The jobs that have a run of so many words, or enough words of the passage for the coverage in any order."""
    keep = jobs[:, 4] >= run
    if coverage <= 1:
        mark = np.full(len(index.number) + 1, -1, np.int64)
        for j in np.flatnonzero(~keep).tolist():
            _, i, a, b, _ = jobs[j].tolist()
            mark[ids[a:b]] = j
            mark[0] = -1
            own = index.items[i][1]
            keep[j] = np.count_nonzero(mark[own] == j) >= coverage * len(own)
    return jobs[keep]


def _leaks_of_batch(keys: list[int], texts: list[str | None], index: Passages, least_run: int = 0, least_coverage: float = 0.0) -> tuple[list, list, list, list, list]:
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    ids, starts = _numbers(texts, index.number)
    pos, which = _hits(ids, index.grams)
    doc = np.searchsorted(starts, pos, "right") - 1
    # whole documents with about SHIFTS shifts at a time
    before = np.cumsum(index.first[which + 1] - index.first[which]) // SHIFTS
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)) if len(doc) else []
    begin = 0
    for k, end in enumerate(ends):
        if k + 1 < len(ends) and before[ends[k + 1] - 1] == before[begin]:
            continue
        jobs = _jobs(index, starts, doc[begin:end], pos[begin:end], which[begin:end])
        begin = end
        jobs = _within_reach(jobs, index, ids, least_run, least_coverage)
        jobs = jobs[np.lexsort((jobs[:, 3] - jobs[:, 2], index.length[jobs[:, 1]]))]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        part: list[list[int]] = []
        wide = 0
        for job in [*jobs.tolist(), None]:
            wide = max(wide, job[3] - job[2]) if job else wide
            if part and (not job or len(part) == 256 or (len(part) + 1) * wide > CELLS):
                score, run = align([(index.items[i][1], ids[a:b]) for _, i, a, b, _ in part])
                for (d, i, _, _, _), s, r in zip(part, score.tolist(), run.tolist()):
                    old = best.get((d, i), (0, 0))
                    best[d, i] = (max(old[0], s), max(old[1], r))
                part, wide = [], job[3] - job[2] if job else 0
            part.append(job)
        for (d, i), (s, r) in best.items():
            item, ws = index.items[i]
            for col, v in zip(out, (keys[d], item, r, s, s / (MATCH * len(ws)))):
                col.append(v)
    return out


def _blocks(items: DataFrame, key: str, passage: str) -> list[list[tuple[int, list[str]]]]:
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    rows = items.select(F.col(key).cast("long").alias("k"), F.col(passage).alias("p")).filter("k is not null and p is not null").groupBy("k").agg(F.max("p").alias("p"))
    for r in rows.orderBy("k").toLocalIterator():
        ws = words(r.p)
        if len(ws) < GRAM:
            continue
        if size and size + len(ws) > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((r.k, ws))
        size += len(ws)
    return [b for b in blocks if b]


LEAK = "doc_id long, item_id long, run int, score int, coverage double"


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", least_run: int = 0, least_coverage: float = 0.0) -> DataFrame:
    """doc_id, item_id, run (longest exact run in words), score and coverage (score over that of the whole passage) of each seeded pair.

    With limits, of the pairs that reach ``least_run`` or ``least_coverage`` (over 1: only the run counts); others that can't are not aligned.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).filter("doc_id is not null and t is not null")
    out = spark.createDataFrame([], LEAK)
    for block in _blocks(items, item_key, passage):
        shared = spark.sparkContext.broadcast(Passages(block))

        def match(shared=shared):
            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                cols = _leaks_of_batch(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.value, least_run, least_coverage)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "run", "score", "coverage"])

            return run

        out = out.unionByName(by_batch(rows, match, LEAK))
    best = F.max(F.struct("run", "score", "coverage")).alias("b")
    out = out.filter((F.col("run") >= least_run) | (F.col("coverage") >= least_coverage))
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with at least RUN consecutive words in common."""
    return leaks(docs, items, least_run=RUN, least_coverage=2.0).filter(F.col("run") >= RUN).select("doc_id", "item_id")
