"""Scoring sections against questions: boost, ranking, near-duplicate removal, threshold and top-k.

The order of effects is boost, sort, removal of near-duplicates, threshold,
top-k.  The threshold is applied before the removal: the row kept of each group
is its best, so if that fails all fail.

Under the hashed embedder retrieval works on counts of words, see ``hashed``.
With other encoders questions are a stated query set.  They are scored in blocks of at most
``BLOCK`` vectors, which bounds what a task holds of them; each batch of sections
keeps, per question, the ``k`` best of different fingerprints, so a window over
these few rows gives the overall result and no question meets all sections in
one task.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.functions import patterns as P
from docsift.functions import text as X
from docsift.operators import hashed
from docsift.operators.embed import cosine, hashed_matrix
from docsift.reduce import reduced, reducer

BLOCK = 4096
#: Scores are rounded before they are compared, so that ties don't depend on the order of summation.
DECIMALS = 9


def ranked(scored: DataFrame, per: str, key: str, text: str | None, k: int, least: float | None = P.THRESHOLD) -> DataFrame:
    """Threshold, near-duplicate removal (if ``text`` names a column) and the k best per question, with their rank."""
    rows = scored.filter(F.col("score") >= least) if least is not None else scored
    order = (F.desc("score"), F.asc(key))
    if text:
        rows = rows.withColumn("_fp", X.fingerprint(text))
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(per, "_fp").orderBy(*order))).filter("_n = 1").drop("_n", "_fp")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(per).orderBy(*order))).filter(F.col("rank") <= k)


def vector_topk(sections: DataFrame, key: str, vector: str, query: list[float], k: int = P.TOP_K, least: float = P.THRESHOLD) -> DataFrame:
    """The k most similar rows to one vector: a scan with TakeOrderedAndProject, no window."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = sections.select(key, cosine(F.col(vector), q).alias("score")).filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(k)


def scoped(sections: DataFrame, documents: DataFrame, owner: Column, wanted: Column) -> DataFrame:
    """Sections of the wanted documents that the owner has; all sections if none is left.

    wanted: a comma-separated list; parts that aren't whole numbers are ignored.
    """
    ids = F.filter(F.transform(F.split(wanted, ","), F.trim), lambda x: x.rlike(r"^[0-9]+$"))
    mine = documents.filter(F.col("user_id") == owner).filter(F.array_contains(F.transform(ids, lambda x: x.cast("long")), F.col("document_id"))).select("document_id")
    some = mine.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row
    marked = sections.join(mine.withColumn("_mine", F.lit(True)), "document_id", "left").join(F.broadcast(some))
    return marked.filter(F.col("_mine") | ~F.col("_some")).drop("_mine", "_some")


#: A defining verb with the white space before it; the exact pattern also asks for its end.
_VERB = re.compile(r"\s+(?:is|are|stands\s+for|refers\s+to|can\s+be\s+defined\s+as|means)", re.I)
#: Letters, decimal digits and underscores, between which there is no word boundary; other numerals count as marks.
_RUN = re.compile(r"\w+")
#: Runs of a term that the equi-join compares; the exact pattern compares the rest.
RUNS = 4


@lru_cache
def _marks() -> dict[int, str]:
    return {c: "\N{MIDDLE DOT}" for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not (chr(c).isalpha() or chr(c).isdecimal())}


def _runs(text: str) -> list[re.Match]:
    return list(_RUN.finditer(text if text.isascii() else text.translate(_marks())))


def _last_runs(term: str) -> str:
    return " ".join(m[0].casefold() for m in _runs(term)[-RUNS:])


def _before_verbs(text: str) -> set[tuple[str, str]]:
    """(last runs, text around them) before each defining verb: one for each number of runs that a term may have."""
    out: set[tuple[str, str]] = set()
    verbs = list(_VERB.finditer(text))
    if not verbs:
        return out
    runs = _runs(text)
    ends = [m.end() for m in runs]
    for v in verbs:
        at, end = bisect_right(ends, v.start()), v.end() + 1
        key = ""
        if v.start() and not (at and ends[at - 1] == v.start()):
            out.add(("", text[max(0, (ends[at - 1] if at else 0) - 1) : end]))
        for n in range(1, min(RUNS, at) + 1):
            key = runs[at - n][0].casefold() + (" " + key if key else "")
            # a term of more runs than are compared may begin anywhere
            begin = 0 if n == RUNS or n == at else ends[at - n - 1] - 1
            out.add((key, text[begin:end]))
    return out


def definitions(sections: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """key, term: which sections say what a term is, one row for each.

    Candidates come from an equi-join of the last runs of a term with the runs
    before defining verbs, of which those that no term has are dropped first; the
    exact pattern then decides on the text around them.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_last_runs(x) for x in b.column(0).to_pylist()], pa.string())], ["term", "_last"])

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows, found = [], []
                for n, x in enumerate(b.column(1).slice(i, 512).to_pylist(), i):
                    if x and (pairs := _before_verbs(x)):
                        found += pairs
                        rows += [n] * len(pairs)
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], [key, "_last", "_near"])

    known = terms.select("term").distinct().mapInArrow(keyed, "term string, _last string")
    near = sections.select(F.col(key).cast("long").alias(key), text).mapInArrow(said, f"{key} long, _last string, _near string")
    near = reduced(near, "_last", reducer(known, "_last"))
    return near.join(known, "_last").filter(X.definition_boost("_near", "term") > 0).select(key, "term").distinct()


def defined_terms(questions: DataFrame, per: str, question: str) -> DataFrame:
    """per, term of the questions that ask for a definition."""
    return questions.filter(X.is_definition(question)).select(per, F.explode(F.array(X.key_term(question))).alias("term")).filter("term <> ''")


def boosts(sections: DataFrame, key: str, text: str, questions: DataFrame, per: str, question: str) -> DataFrame:
    """per, key of the (question, section) pairs that earn the definition boost."""
    asked = defined_terms(questions, per, question)
    return definitions(sections, key, text, asked).join(asked, "term").select(per, key).distinct()


def retrieve(
    sections: DataFrame, questions: DataFrame, key: str = "section_id", text: str = "section_text", per: str = "query_id", question: str = "query_text",
    k: int = P.TOP_K, least: float = P.THRESHOLD, boost: bool = True, dedup: bool = True, encode=hashed_matrix,
) -> DataFrame:
    """per, key, score, rank of the k best sections of every question."""
    if encode is hashed_matrix:
        return hashed.retrieve(sections, questions, key, text, per, question, k, least, boost, dedup)
    raised = None
    if boost:
        raised = boosts(sections, key, text, questions, per, question).groupBy(key).agg(F.collect_list(per).alias("_boosted"))
    base = sections.select(F.col(key).cast("long").alias(key), text, X.fingerprint(text).alias("_fp"))
    base = base.join(raised, key, "left") if raised is not None else base.withColumn("_boosted", F.expr("cast(null as array<bigint>)"))
    return _best(base, questions, key, per, question, k, least, dedup, encode)


def unit_rows(vectors: list[list[float]]) -> np.ndarray:
    """Vectors of one length as rows of length 1; a zero vector stays zero."""
    x = np.array(vectors, np.float64)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def retrieve_vectors(
    sections: DataFrame, questions: DataFrame, key: str, vector: str, per: str, question: str, k: int = P.TOP_K, least: float = P.THRESHOLD, group: str | None = None, dim: int = 64,
) -> DataFrame:
    """per, key, score, rank of the k sections with the most similar stored vectors.

    ``group`` names a column of which each value counts once per question.
    Vectors of another length than ``dim`` or with missing values take no part.
    """
    whole = lambda c: (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    fp = F.col(group).cast("string") if group else F.lit(None).cast("string")
    base = sections.filter(whole(F.col(vector))).select(F.col(key).cast("long").alias(key), vector, fp.alias("_fp"), F.expr("cast(null as array<bigint>)").alias("_boosted"))
    return _best(base, questions.filter(whole(F.col(question))), key, per, question, k, least, group is not None, unit_rows)


def _best(base: DataFrame, questions: DataFrame, key: str, per: str, question: str, k: int, least: float, dedup: bool, encode) -> DataFrame:
    """Scores of blocks of questions against (key, content, _fp, _boosted) rows, reduced to the k best per question."""
    out = None
    for ids, vectors in _blocks(questions, per, question, encode):
        part = base.mapInArrow(_scorer(base.sparkSession.sparkContext.broadcast((ids, vectors)), (per, key), k, least, dedup, encode), f"{per} long, {key} long, score double, _fp string")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.sparkSession.createDataFrame([], f"{per} long, {key} long, score double, _fp string")
    order = (F.desc("score"), F.asc(key))
    if dedup:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy(per, "_fp").orderBy(*order))).filter("_n = 1").drop("_n")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy(per).orderBy(*order))).filter(F.col("rank") <= k)
    return out.select(per, key, "score", "rank")


def _blocks(questions: DataFrame, per: str, question: str, encode) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Question keys and vectors in bounded blocks, streamed to the driver one partition at a time."""
    ids: list[int] = []
    texts: list[str] = []
    for r in questions.select(per, question).filter(F.col(per).isNotNull()).toLocalIterator():
        if r[1] is None or isinstance(r[1], str) and not r[1].strip():
            continue
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == BLOCK:
            yield np.array(ids, np.int64), encode(texts)
            ids, texts = [], []
    if ids:
        yield np.array(ids, np.int64), encode(texts)


def _scorer(block, names: tuple[str, str], k: int, least: float, dedup: bool, encode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        place = {int(x): i for i, x in enumerate(ids)}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                keys, texts, fps, boosted = (c.to_pylist() for c in part.columns)
                scores = np.round(q @ encode(texts).T, DECIMALS)
                for s, who in enumerate(boosted):
                    for x in who or ():
                        if x in place:
                            scores[place[x], s] = round(scores[place[x], s] + 0.1, DECIMALS)
                group = np.unique(np.array([f or "" for f in fps], object).astype(str), return_inverse=True)[1] if dedup else np.arange(len(keys))
                order = np.argsort(keys, kind="stable")
                ranked_keys = np.array(keys, np.int64)[order]
                scores, group = scores[:, order], group[order]
                rows, cols = [], []
                need = min(k, scores.shape[1])
                # the k-th best of different fingerprints can't lie beyond the k + (repeats)-th best of all
                spare = min(scores.shape[1], need + len(keys) - len(np.unique(group)))
                # score and place in one whole number, so that equal scores go by key
                both = np.rint(scores * 10**DECIMALS).astype(np.int64) * 1024 + (1023 - np.arange(scores.shape[1]))
                best = np.argpartition(both, scores.shape[1] - spare, axis=1)[:, scores.shape[1] - spare :]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, 1), axis=1), 1)
                if not dedup:
                    best = best[:, :need]
                    keep = np.take_along_axis(scores, best, 1) >= least
                    rows, cols = np.nonzero(keep)
                    cols = best[keep]
                else:
                    for i in np.flatnonzero(scores.max(1) >= least).tolist():
                        seen: set[int] = set()
                        for c in best[i].tolist():
                            if scores[i, c] < least or len(seen) == need:
                                break
                            if group[c] not in seen:
                                seen.add(group[c])
                                rows.append(i)
                                cols.append(c)
                if len(rows):
                    fp = np.array(fps, object)[order]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[rows]), pa.array(ranked_keys[cols]), pa.array(scores[rows, cols]), pa.array(list(fp[cols]), pa.string())],
                        [*names, "score", "_fp"],
                    )

    return run
