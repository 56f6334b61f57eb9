"""Text functions of the document store as column expressions.

Every function is built from Catalyst expressions, null in gives null out unless
stated, and ``\\w``, ``\\s`` and ``\\b`` are Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions import patterns as P


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), P.ENDS, "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(col(c), P.SPACES, " ")


def words(c: Column | str) -> Column:
    """Array of white-space separated words; empty for blank text."""
    return F.filter(F.split(col(c), P.SPACES), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def _replace_all(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def clean_ingest(c: Column | str) -> Column:
    """Cleaning of extracted text before it is stored; null gives an empty text."""
    return strip(_replace_all(F.coalesce(col(c), F.lit("")), (P.REPLACEMENT, P.BULLETS, P.NUMBER_LINES, P.SITE_MARKS, *P.BROKEN, P.SPLIT_WORDS, *P.HYPHENS, P.BLANKS, P.BEFORE_PUNCTUATION)))


def clean_display(c: Column | str) -> Column:
    """Cleaning of stored text before it is shown; null gives an empty text."""
    first = strip(_replace_all(F.coalesce(col(c), F.lit("")), (P.REPLACEMENT,)))
    return strip(_replace_all(first, (P.LEADING_NUMBER, P.BULLETS, P.SITE_MARKS, *P.BROKEN, P.SPLIT_WORDS, *P.HYPHENS, P.BLANKS, P.BEFORE_PUNCTUATION)))


def sentences(c: Column | str) -> Column:
    """Array of the sentences longer than ten characters."""
    parts = F.split(F.regexp_replace(col(c), "\n", " "), P.AFTER_SENTENCE)
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 10)


def display_sentences(c: Column | str) -> Column:
    """Array of the stripped, non-empty sentences of shown text; line ends are kept inside them."""
    return F.filter(F.transform(F.split(col(c), P.AFTER_SENTENCE_SHOWN), strip), lambda s: s != "")


def fingerprint(c: Column | str) -> Column:
    """Near-duplicate key: the first hundred characters without case, extra blanks and a leading number."""
    return F.regexp_replace(F.lower(strip(squeeze(F.substring(col(c), 1, 100)))), r"(?U)^\d{1,3}\s+", "")


def header_like(c: Column | str) -> Column:
    """Looks like a title: empty, under twenty characters, marked (A) or (B), or mostly capitals."""

    def judge(s: Column) -> Column:
        letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
        capitals = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
        return (F.length(s) < 20) | s.rlike(r"\([AB]\)(?U)\s*$") | ((letters > 0) & (capitals > F.lit(0.7) * letters))

    return let(strip(F.coalesce(col(c), F.lit(""))), judge)


def is_definition(c: Column | str) -> Column:
    q = F.coalesce(col(c), F.lit(""))
    return q.rlike(P.DEFINITION_START) | q.rlike(P.DEFINITION_PHRASE)


def is_list(c: Column | str) -> Column:
    q = F.coalesce(col(c), F.lit(""))
    return q.rlike(P.LIST_PHRASE) | q.rlike(P.LIST_SUFFIX)


def key_term(c: Column | str) -> Column:
    """What a definition question asks about: an acronym, else up to three words."""
    q = strip(F.coalesce(col(c), F.lit("")))
    q = strip(F.regexp_replace(q, r"[?!.]+$", ""))
    for pattern in (P.LEADER, P.ARTICLE, P.TRAILING_VERB, P.TRAILING_PLACE):
        q = F.regexp_replace(q, pattern, "")
    q = strip(F.regexp_replace(strip(q), r"^[\"']+|[\"']+$", ""))

    def choose(q: Column) -> Column:
        acronym = F.regexp_extract(q, P.ACRONYM, 1)
        short = let(words(q), lambda ws: F.array_join(F.when(F.lower(F.try_element_at(ws, F.lit(1))).isin("a", "an", "the"), F.slice(ws, 2, 3)).otherwise(F.slice(ws, 1, 3)), " "))
        return F.when(acronym != "", acronym).otherwise(short)

    return let(q, choose)


def quoted(term: Column) -> Column:
    """A term as a literal part of a pattern."""
    return F.concat(F.lit("\\Q"), F.regexp_replace(term, r"\\E", ""), F.lit("\\E"))


def definition_boost(text: Column | str, term: Column | str) -> Column:
    """0.1 if the text says what the term is, else 0."""
    pattern = F.concat(F.lit(r"(?iuU)\b"), quoted(col(term)), F.lit(P.BOOST_VERBS))
    return F.when((F.coalesce(col(term), F.lit("")) != "") & F.rlike(col(text), pattern), F.lit(0.1)).otherwise(F.lit(0.0))


def numbered(c: Column | str) -> Column:
    """Holds an item numbered 1 to 9."""
    return col(c).rlike(r"(?U)\b[1-9][.)]\s")


def definition_in(text: Column | str, term: Column | str) -> Column:
    """struct(priority, place, sentence): the strongest definition of a term in shown text, null if there is none."""
    text, term = col(text), col(term)
    colon = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?iuU)(?:^|(?<=[\s\-–—.!?(]))\b"), quoted(term), F.lit(r"\b\s*:\s*([^\n.!?]{5,250})")), F.lit(1))
    # a sentence that doesn't name the term needs no closer look
    kept = F.filter(display_sentences(text), lambda s: F.contains(F.lower(s), F.lower(term)) & ~header_like(s))

    def names(verbs: str) -> Column:
        return F.concat(F.lit(r"(?iuU)\b"), quoted(term), F.lit(rf"\b[^.!?\n]{{0,80}}?\b(?:{verbs})\b"))

    def ranked(s: Column, i: Column) -> Column:
        rank = None
        for n, verb in enumerate(P.DEFINITION_VERBS, 1):
            hit = F.rlike(s, names(verb))
            rank = F.when(hit, n) if rank is None else rank.when(hit, n)
        # one pattern for all verbs first: most sentences hold none
        return F.struct(F.when(F.rlike(s, names("|".join(P.DEFINITION_VERBS))), rank).alias("priority"), (i + 1).alias("place"), s.alias("sentence"))

    best = F.array_min(F.filter(F.transform(kept, ranked), lambda x: x["priority"].isNotNull()))
    direct = let(colon, lambda c: F.when(c != "", F.struct(F.lit(0).alias("priority"), F.lit(0).alias("place"), F.concat(term, F.lit(": "), strip(c)).alias("sentence"))))
    return F.when((term != "") & (text != "") & F.contains(F.lower(text), F.lower(term)), F.coalesce(direct, best))


def expand_to_sentence(fragment: Column | str, context: Column | str) -> Column:
    """The sentence of the context around the first occurrence of a fragment; the fragment if it isn't there."""
    fragment, context = col(fragment), col(context)

    def around(at: Column) -> Column:
        before = F.regexp_extract(F.substring(context, F.lit(1), at - 1), r"(?s)([^.!?\n]*)$", 1)
        after = F.regexp_extract(F.substring(context, at + F.length(fragment), F.length(context)), r"(?s)^([^.!?]*[.!?]?)", 1)
        whole = strip(F.concat(before, F.substring(context, at, F.length(fragment)), after))
        return F.when((at > 0) & (fragment != ""), F.coalesce(F.nullif(whole, F.lit("")), fragment)).otherwise(fragment)

    return let(F.position(F.lower(fragment), F.lower(context)), around)


def polish(c: Column | str) -> Column:
    """Final form of an answer: cleaned, no leading bullet, capital first, full stop last unless it is a list."""
    a = F.regexp_replace(clean_display(c), r"(?U)(^|\n|\s{2,})o\s+(?=[A-Za-z])", "$1• ")
    a = strip(F.regexp_replace(a, r"(?U)^[\s•\-*]+", ""))
    first = lambda a: F.when(a.rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(a, 1, 1)), F.substring(a, F.lit(2), F.length(a)))).otherwise(a)
    last = lambda a: F.when((a == "") | a.rlike(r"[.!?]$") | F.contains(F.substring_index(a, "\n", -1), F.lit("•")), a).otherwise(F.concat(a, F.lit(".")))
    return let(let(a, first), last)


def shortened(c: Column | str, length: int = 35) -> Column:
    """A label of at most ``length`` characters, cut after a whole word; up to five characters more are let pass."""
    s = col(c)
    cut = F.substring(s, 1, length - 3)
    whole = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(F.length(s) <= length + 5, s).otherwise(F.concat(whole, F.lit("...")))


def allowed_file(c: Column | str) -> Column:
    """The last extension is pdf or txt."""
    return F.contains(col(c), F.lit(".")) & F.lower(F.substring_index(col(c), ".", -1)).isin("pdf", "txt")


def safe_name(c: Column | str) -> Column:
    """A file name without path parts and unusual characters."""
    flat = F.regexp_replace(F.regexp_replace(col(c), r"[/\\]+", " "), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(flat, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")
