"""Problem 4: cutting long texts into overlapping pieces at natural boundaries.

A text (without the blanks and line ends at its ends) that fits the limit is
one piece.  A longer one is cut into atomic segments: lines and sentences,
and where such a segment alone exceeds the limit, clauses, words and at last
single code points (never before a combining mark).  A heap holds the
boundaries between adjacent segments, weakest first; the weakest boundary
whose two sides fit together with the overlap is merged, until none fits.

Defined results: null or blank text gives no piece; a row sent twice gives its
pieces once; a null key gives no piece; pieces without their overlap, put
together, are exactly the stripped text.  Only the key and text columns are
read, so further columns don't matter.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.words import by_batch

LIMIT, OVERLAP, SLACK = 1200, 150, 30
#: What is removed at both ends of a text before it is measured.
BLANKS = " \t\r\n"

_LEVELS = (
    (5, re.compile(r"\n[ \t\r]*\n\s*")),
    (4, re.compile(r"\r?\n[ \t]*")),
    (3, re.compile(r"(?<=[.!?])[\"'”’)\]]*[ \t]+|(?<=[。！？])[」』”）]*")),
    (2, re.compile(r"(?<=[;:,])[ \t]+|(?<=[，；：、])")),
    (1, re.compile(r"\s+")),
)


def _cuts(text: str, start: int, end: int, level: int, most: int, out: list[tuple[int, int]]) -> None:
    """Append (position, strength) of the boundaries inside text[start:end], from ``level`` on until parts are <= most."""
    if level == len(_LEVELS):
        at = start
        while end - at > most:
            cut = at + most
            while cut > at + 1 and unicodedata.combining(text[cut]):
                cut -= 1
            out.append((cut, 0))
            at = cut
        return
    strength, pattern = _LEVELS[level]
    at = start
    for m in pattern.finditer(text, start, end):
        cut = m.end()
        if at < cut < end:
            if cut - at > most:
                _cuts(text, at, cut, level + 1, most, out)
            elif level < 2:
                _cuts(text, at, cut, level + 1, most, out)
            out.append((cut, strength))
            at = cut
    if end - at > most or level < 2:
        _cuts(text, at, end, level + 1, most, out)


def _cuts_top(text: str, most: int) -> list[tuple[int, int]]:
    """All boundaries of a text: lines and sentences always, finer ones only inside what is still too long."""
    found: list[tuple[int, int]] = []
    _cuts(text, 0, len(text), 0, most, found)
    found.sort()
    return found


def segments(text: str, limit: int = LIMIT, overlap: int = OVERLAP + SLACK) -> list[int]:
    """Start positions of the pieces' own parts (without overlap) of a text longer than ``limit``."""
    most = limit - overlap
    cuts = _cuts_top(text, most)
    starts = [0] + [c for c, _ in cuts]
    ends = starts[1:] + [len(text)]
    strength = [s for _, s in cuts]
    n = len(starts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i], ends[i + 1] - starts[i], i, ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    bound = strength + [9]
    while heap:
        s, size, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end or end - starts[i] != size:
            continue
        if size > (limit if i == 0 else most):
            continue
        ends[i], bound[i], after[i], alive[j] = ends[j], bound[j], after[j], False
        if after[j] < n:
            before[after[j]] = i
            k = after[i]
            heapq.heappush(heap, (bound[i], ends[k] - starts[i], i, ends[k]))
        if before[i] >= 0:
            h = before[i]
            heapq.heappush(heap, (bound[h], ends[i] - starts[h], h, ends[i]))
    return [starts[i] for i in range(n) if alive[i]]


_SENTENCE, _SPACE = _LEVELS[2][1], _LEVELS[4][1]


def _overlap_start(text: str, start: int, floor: int, overlap: int, slack: int) -> int:
    """Where the repeated part before ``start`` begins: at a sentence, else a word, near ``overlap`` characters before."""
    low, high = max(floor, start - overlap - slack), max(floor, start - overlap + slack)
    if start - floor <= overlap:
        return floor
    for pattern in (_SENTENCE, _SPACE):
        found = [m.end() for m in pattern.finditer(text, low, high) if low < m.end() <= high]
        if found:
            return min(found, key=lambda p: abs(start - overlap - p))
    at = max(floor, start - overlap)
    while at > low and unicodedata.combining(text[at]):
        at -= 1
    return at


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, int]]:
    """(start with overlap, start of the own part, end) of each piece of a stripped text."""
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    starts = segments(text, limit, overlap + slack)
    out, floor = [], 0
    for k, start in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(text)
        first = _overlap_start(text, start, floor, overlap, slack) if k else 0
        out.append((first, start, end))
        floor = first
    return out


PIECES = "section_id long, piece_no int, piece_start int, own_start int, piece_end int, piece_text string"


def pieces(df: DataFrame, key: str = "section_id", text: str = "section_text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text; offsets are code points of the stripped text."""
    rows = (
        df.select(F.col(key).cast("long").alias("section_id"), F.trim(F.col(text), F.lit(BLANKS)).alias("t"))
        .filter("section_id is not null and length(t) > 0")
    )
    short = rows.filter(F.length("t") <= limit).select(
        "section_id", F.lit(1).alias("piece_no"), F.lit(0).alias("piece_start"), F.lit(0).alias("own_start"), F.length("t").alias("piece_end"), F.col("t").alias("piece_text")
    )

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, (a, b, c) in enumerate(split(t, limit, overlap), 1):
                    for col, v in zip(cols, (k, no, a, b, c, t[a:c])):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["section_id", "piece_no", "piece_start", "own_start", "piece_end", "piece_text"])

        return run

    long = by_batch(rows.filter(F.length("t") > limit), make, PIECES)
    return short.unionByName(long).dropDuplicates(["section_id", "piece_no"])


def divided(df: DataFrame, key: str = "section_id", text: str = "section_text", limit: int = LIMIT) -> DataFrame:
    """Keys of the texts that the splitter divides."""
    return pieces(df, key, text, limit).filter("piece_end > piece_start and own_start > 0").select("section_id").distinct()
