"""Problem 9: texts cut off by field limits or broken transfers.

Lengths of each source are treated as survival times, in code points, in bytes
and in code points without what was appended to the cut.  Window functions give
the discrete hazard of each length and that of its neighbours; a Poisson tail
bound tests one against the other, with Benjamini-Hochberg control inside each
source and unit.  A text with an incomplete ending is reported if it ends at a
significant length of its source.  This includes endings that could be either
(a list entry, a bare number with a full stop), where hardly any text has that
length by chance.

Transfers break at any length, so the incomplete endings that remain have a
hazard of their own: per source, their number among its texts is tested against
the share that the judgement of endings may get wrong, again with
false-discovery control, over the sources.  Plainly incomplete endings of the
sources that pass are reported too.  No ending is reported without a test.

Defined results: null and blank texts are not cut; a null source is a source of
its own; repeated keys are one document; a null key is not reported; empty
tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.llm.words import by_batch
from docsift.stage import Stage

NEIGHBOURS, FALSE_DISCOVERY = 40, 0.001
#: An ending that could be either needs a length that at most this share of its texts have by chance.
BY_CHANCE = 0.05
#: Broken transfers: share of whole texts whose ending may be misjudged, and the false discoveries allowed among sources.
MISJUDGED, SOURCE_DISCOVERY = 0.001, 0.05
#: Sources are ranked by -log p in classes of this width, up to the given number of them.
CLASS, CLASSES = 0.05, 8000
UNITS = ("chars", "bytes", "own")
#: The patterns of endings below span fewer characters than this.
SPAN = 400

#: What transfers and sites append to a cut text.
APPENDED = re.compile(
    r"(?:\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|\.{3,}|…|\ufffd+|[\x00-\x08\x1a]+|<!--[^>]{0,80}(?:-->)?|</?[A-Za-z][^<>]{0,60}>?|<|&#?\w{0,7};?"
    r"|[\[(](?:(?:text |content |output )?(?:truncated|cut(?: off)?|shortened|more|continued|continues|to be continued|abgeschnitten|gekürzt|tronqué|suite|truncado|省略|続く|未完|截断|下略))[^\])]{0,20}[\])]?"
    r"|(?:>+\s*)?(?:read more|continue reading|show more|see more|weiterlesen|mehr lesen|lire la suite|leer más|阅读更多|続きを読む)\W{0,5}))+\s*\Z",
    re.I,
)
#: Any appended mark holds one of these near its end.
_MARKS = re.compile(r"[.…\ufffd\x00-\x08\x1a<>&;\])]|(?i:more|reading|lesen|suite|más|更多|読む)\W{0,5}\Z|[<&\[(]\S{0,80}\Z")
COMPLETE = re.compile(r"[.!?。！？．][\"'“”‘’»«)\]）」』】]*\Z")
#: A last line that can't end a text: a bare list number or abbreviation.
STUB = re.compile(r"(?:^|\n)\s*[\[(]?\d{1,4}[.)\]]?\Z|(?:^|\s)(?:Figs?|Nos?|Abb|Nr|vol|pp?|e\.g|i\.e|z\.B|bzw|cf|vs|approx)\.\Z")
#: A number whose full stop may be a decimal point: nought, or one after a preposition.
NUMBER = re.compile(r"(?:^|\s)(?:0|(?:at|than|below|above|to|between|and|after|for|of|by|over|under|bei|mit|von|unter|über|nach|als|à|de|entre|après|tras|a|en) \d+)\.\Z", re.I)
_L = r"[^\W\d_]"
#: Lines that end a text without being a sentence.
END_MARK = re.compile(
    rf"(?:[\W_]+|[\[({{<*=~#–—-].*[\])}}>*=~#–—-]|[\w .]{{0,24}}:?\s*[-+]?[\d.,]+(?:\s*[/|;\t]\s*[-+]?[\d.,]+)+"
    rf"|{_L}(?:{_L}| ){{2,40}}:\s+[^\W_][\w ./-]{{0,30}}|(?:Figs?|Tables?|Sheets?|Pages?|Abb|Tabelle|Tableau|Tabla|Figuras?|図|表|图)\b\.?\s*\d.{{0,40}})"
)
FORMULA = re.compile(r"\(\d+\)\s+.{1,60}")
_PROSE = re.compile(rf"(?:\b{_L}{{2,}}\s+){{3}}")
SIGN = re.compile(rf"\d{{1,4}}[a-z']?\s+{_L}[\w '’/-]{{0,70}}")
_HEADING = re.compile(r"[:：]\Z|sign|numeral|zeichen|référence|referencia|符号|標記", re.I)
_WORD = re.compile(rf"{_L}+")


def judge(text: str | None) -> tuple[str, int]:
    """(kind, own length): whole, cut or doubtful, and the length without what was appended."""
    if not text:
        return "whole", 0
    core = text.rstrip()
    if _MARKS.search(core, max(0, len(core) - 90)):
        while (m := APPENDED.search(core, max(0, len(core) - 200))) and m.start() < len(core):
            core = core[: m.start()].rstrip()
    own = len(core)
    if not core:
        return "whole", own
    near = max(0, own - SPAN)
    if STUB.search(core, near):
        return "doubtful", own
    if COMPLETE.search(core, near):
        return ("doubtful" if NUMBER.search(core, near) else "whole"), own
    at = core.rfind("\n") + 1
    last = core[at:].strip()
    above = core[:at].rstrip()
    before = above[above.rfind("\n") + 1 :].strip()
    blank = core[len(above) : at].count("\n") > 1 or not above
    if SIGN.fullmatch(last) and (SIGN.fullmatch(before) or _HEADING.search(before)):
        word = _WORD.findall(last)[-1].lower() if core[-1].isalpha() else ""
        if word:
            told = core[:at].lower()
            seen = re.search(rf"(?<![^\W\d_]){re.escape(word)}(?![^\W\d_])", told)
            if not seen and re.search(rf"(?<![^\W\d_]){re.escape(word)}[^\W\d_]", told):
                return "cut", own
        return "doubtful", own
    if blank or not re.search(r"[\w,;]\Z", before):
        if FORMULA.fullmatch(last) and not _PROSE.search(last):
            return "whole", own
        if END_MARK.fullmatch(last) and (last[0].isupper() or not last[0].isalpha()):
            return "whole", own
    return "cut", own


def _ending(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per record: its lengths and the judgement of its ending."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("t")).filter("doc_id is not null")
    rows = rows.select("doc_id", "source", F.length("t").alias("chars"), F.octet_length("t").alias("bytes"), "t")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, own = zip(*map(judge, batch.column(4).to_pylist()))
            return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, pa.int32()), pa.array(kinds, pa.string())], ["doc_id", "source", "chars", "bytes", "own", "kind"])

        return run

    return by_batch(rows, make, "doc_id long, source string, chars int, bytes int, own int, kind string")


def endings(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, chars, bytes, own, kind: one row per key."""
    rest = F.struct("source", "chars", "bytes", "own", "kind")
    return _ending(df, key, text, source).groupBy("doc_id").agg(F.max(rest).alias("r")).select("doc_id", "r.*")


def hazards(ends: DataFrame, units: tuple[str, ...] = UNITS) -> DataFrame:
    """source, unit, size, ended, at_risk, expected, log_p, significant: the hazard test of every length."""
    measures = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("size")) for u in units]))
    counts = ends.select("source", measures.alias("u")).select("source", "u.*").filter("size > 0").groupBy("source", "unit", "size").agg(F.count("*").alias("ended"))
    family = W.partitionBy("source", "unit")
    falling = family.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    near = family.orderBy("size").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    rows = counts.withColumn("at_risk", F.sum("ended").over(falling)).withColumn("around", F.sum("ended").over(near) - F.col("ended"))
    # exposure of the neighbouring lengths; half an ending more keeps an empty neighbourhood from a hazard of nought
    exposure = 2 * NEIGHBOURS * F.col("at_risk") + F.col("around") * NEIGHBOURS / 2.0
    rows = rows.withColumn("expected", F.col("at_risk") * (F.col("around") + 0.5) / exposure)
    rows = rows.withColumn("log_p", _log_p(F.col("ended"), F.col("expected")))
    ranked = rows.withColumn("tests", F.count("*").over(family)).withColumn("nth", F.row_number().over(family.orderBy("log_p", "size")))
    passes = F.col("log_p") <= F.log(F.lit(FALSE_DISCOVERY) * F.col("nth") / F.col("tests"))
    ranked = ranked.withColumn("limit", F.max(F.when(passes, F.col("nth"))).over(family))
    significant = F.coalesce(F.col("nth") <= F.col("limit"), F.lit(False))
    return ranked.select("source", "unit", "size", "ended", "at_risk", "expected", "log_p", significant.alias("significant"))


def _log_p(seen: Column, expected: Column) -> Column:
    """Logarithm of the Chernoff bound of a Poisson tail."""
    return F.when(seen > expected, -(seen * F.log(seen / expected) - seen + expected)).otherwise(F.lit(0.0))


def transfers(known: DataFrame) -> DataFrame:
    """source, broken, documents, expected, log_p, significant: the test of the incomplete endings away from limits, per source.

    known: source, kind, at_limit.  The false-discovery rank of a source is
    counted over classes of p, a table of fixed size, so no task sees all sources.
    """
    per = known.groupBy("source").agg(F.count("*").alias("documents"), F.count_if((F.col("kind") == "cut") & ~F.col("at_limit")).alias("broken"))
    per = per.withColumn("expected", F.col("documents") * F.lit(MISJUDGED)).withColumn("log_p", _log_p(F.col("broken"), F.col("expected")))
    per = per.withColumn("class", F.least(F.floor(-F.col("log_p") / CLASS), F.lit(CLASSES)).cast("int"))
    classes = per.groupBy("class").agg(F.count("*").alias("n"))
    falling = W.orderBy(F.desc("class")).rowsBetween(W.unboundedPreceding, 0)
    total = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = classes.withColumn("nth", F.sum("n").over(falling)).withColumn("tests", F.sum("n").over(total))
    passing = ranked.filter(-F.col("class") * CLASS <= F.log(F.lit(SOURCE_DISCOVERY) * F.col("nth") / F.col("tests"))).agg(F.min("class").alias("least"))
    out = per.join(F.broadcast(passing))  # one row
    return out.select("source", "broken", "documents", "expected", "log_p", F.coalesce((F.col("class") >= F.col("least")) & (F.col("broken") > 0), F.lit(False)).alias("significant"))


def judged(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, kind, at_limit, broken, cut for every document; at_limit and broken name the test that decided."""
    stage = Stage(df.sparkSession, "cutoff")
    ends = stage.save(endings(df, key, text, source), "endings")
    limits = stage.save(hazards(ends).filter("significant").select(F.col("source").alias("s"), "unit", "size", (F.col("expected") <= BY_CHANCE * F.col("ended")).alias("sure")), "limits")
    known = ends
    for u in UNITS:
        own = limits.filter(F.col("unit") == u).select("s", F.col("size").alias("_size"), F.when(F.col("sure"), 2).otherwise(1).alias(f"at_{u}"))
        known = known.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col(u) == F.col("_size")), "left").drop("s", "_size")
    at = F.greatest(*[F.coalesce(F.col(f"at_{u}"), F.lit(0)) for u in UNITS])
    at_limit = at >= F.when(F.col("kind") == "cut", 1).when(F.col("kind") == "doubtful", 2)
    known = stage.save(known.select("doc_id", "source", "kind", F.coalesce(at_limit, F.lit(False)).alias("at_limit")), "known")
    sources = transfers(known).filter("significant").select(F.col("source").alias("s"), F.lit(True).alias("_broken"))
    out = known.join(sources, F.col("source").eqNullSafe(F.col("s")), "left")
    broken = F.coalesce(F.col("_broken"), F.lit(False)) & (F.col("kind") == "cut") & ~F.col("at_limit")
    return out.select("doc_id", "source", "kind", "at_limit", broken.alias("broken"), (F.col("at_limit") | broken).alias("cut"))


def found(df: DataFrame) -> DataFrame:
    """Documents cut inside a word or sentence."""
    return judged(df).filter("cut").select("doc_id")


def rates(df: DataFrame) -> DataFrame:
    """source, documents, truncated, at_limit, broken, share: how often each source truncates, at limits and in transfers."""
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    out = judged(df).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("long")).alias("truncated"), count("at_limit"), count("broken"))
    return out.withColumn("share", F.round(F.col("truncated") / F.col("documents"), 6))
