"""Shared pieces of the named queries: tables once per key without deleted rows, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.functions import patterns as P
from docsift.operators.store import live
from docsift.sources.tables import KEYS, table


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A store table once per key, without deleted rows."""
    return live(table(spark, sf_dir, name), name)


def cte(*names: str) -> str:
    """``WITH`` clause that gives tables under the short names below."""
    short = {"app_user": "u", "doc_catalog": "d", "document_section": "s", "user_query": "q", "retrieval_result": "r", "answer": "a"}
    parts = []
    for n in names:
        where = "" if n == "app_user" else " WHERE deleted_at IS NULL"
        parts.append(f"{short[n]} AS (SELECT * FROM (SELECT DISTINCT ON ({KEYS[n]}) * FROM {n} ORDER BY {KEYS[n]}, loaded_at){where})")
    return "WITH RECURSIVE " + ", ".join(parts)


#: White space as RE2 understands it, the same characters as the Unicode class of the Spark side.
WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word character.
WC = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> ''))"


def fingerprint(x: str) -> str:
    return f"regexp_replace(lower({strip(squeeze(f'{x}[1:100]'))}), '^[0-9]{{1,3}}{WS}+', '')"


def _rules(x: str) -> str:
    for a, b in P.BROKEN_WORDS:
        x = rf"regexp_replace({x}, '\b{a}\b', '{b}', 'gi')"
    x = rf"regexp_replace({x}, '\b(soft|hard|fire|net|data|mal|cyber){WS}+(ware|wall|work|base|icious|security)\b', '\1\2', 'gi')"
    for a in (f"({WC}){WS}+-{WS}+({WC})", f"({WC}){WS}+-({WC})", f"({WC})-{WS}+({WC})"):
        x = rf"regexp_replace({x}, '{a}', '\1-\2', 'g')"
    x = f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '{WS}+([.,;:!?])', '\1', 'g')")


_BULLETS = P.BULLETS[0]


def clean_ingest(x: str) -> str:
    x = f"regexp_replace(replace(coalesce({x}, ''), chr(65533), ''), '{_BULLETS}', '• ', 'g')"
    x = f"regexp_replace({x}, '(?m)^{WS}*[0-9]{{1,3}}{WS}*$', '', 'g')"
    return _rules(rf"regexp_replace({x}, '{WS}*\([AB]\){WS}*', ' ', 'g')")


def clean_display(x: str) -> str:
    x = strip(f"replace(coalesce({x}, ''), chr(65533), '')")
    x = rf"regexp_replace({x}, '^[0-9]{{1,3}}{WS}+([A-Z])', '\1')"
    x = f"regexp_replace({x}, '{_BULLETS}', '• ', 'g')"
    return _rules(rf"regexp_replace({x}, '{WS}*\([AB]\){WS}*', ' ', 'g')")


def sentences(x: str) -> str:
    """List of sentences longer than ten characters."""
    marked = rf"regexp_replace(replace({x}, chr(10), ' '), '([.?!]){WS}+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: {strip('z')}), lambda z: length(z) > 10)"


def shown_sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.?!]){WS}+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda z: {strip('z')}), lambda z: z <> '')"


def header_like(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return rf"(length({s}) < 20 OR regexp_matches({s}, '\([AB]\){WS}*$') OR (length(regexp_replace({s}, '[^\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace({s}, '[^\p{{Lu}}]', '', 'g')) > 0.7 * length(regexp_replace({s}, '[^\p{{L}}]', '', 'g'))))"


def is_definition(x: str) -> str:
    return (
        rf"(regexp_matches(coalesce({x}, ''), '(?i)^{WS}*(what{WS}+is|what{WS}+are|what{WS}+does|define|meaning{WS}+of|definition{WS}+of)\b') OR "
        rf"regexp_matches(coalesce({x}, ''), '(?i)\b(stands?{WS}+for|means?|refers?{WS}+to|definition{WS}+of|meaning{WS}+of)\b'))"
    )


def is_list(x: str) -> str:
    return (
        rf"(regexp_matches(coalesce({x}, ''), '(?i)\b(what{WS}+are|list|types?{WS}+of|kinds?{WS}+of|examples?{WS}+of|categories{WS}+of|approaches{WS}+to|steps{WS}+(?:in|of|to|taken|that|which|the)|phases{WS}+of|ways{WS}+to|services{WS}+of|benefits?{WS}+of|symptoms?{WS}+of|disadvantages{WS}+of|advantages{WS}+of|requirements{WS}+(?:in|of|for))\b') OR "
        rf"regexp_matches(coalesce({x}, ''), '(?i)\b(protocols|services|types|kinds|examples|approaches|phases|benefits|methods|techniques|ways|requirements|symptoms|disadvantages|advantages|features|categories|properties|functionalities|aspects|fields|steps){WS}*\??{WS}*$'))"
    )


def key_term(x: str) -> str:
    q = strip(rf"regexp_replace({strip(f'coalesce({x}, chr(32))')}, '[?!.]+$', '')")
    for p in (
        rf"(?i)^{WS}*(what{WS}+is|what{WS}+are|what{WS}+does|define|meaning{WS}+of|definition{WS}+of){WS}+", rf"(?i)^{WS}*(a|an|the){WS}+",
        rf"(?i){WS}+(stand{WS}+for|stands{WS}+for|mean|means|refer{WS}+to|refers{WS}+to).*$", rf"(?i){WS}+(?:in|inside|within|used{WS}+in|used{WS}+by){WS}+{WC}+(?:{WS}+{WC}+)?{WS}*$",
    ):
        q = f"regexp_replace({q}, '{p}', '')"
    q = strip(f"regexp_replace({strip(q)}, '^[\"'']+|[\"'']+$', '', 'g')")
    ws = f"list_filter(regexp_split_to_array({q}, '{WS}+'), lambda w: w <> '')"
    return (
        rf"CASE WHEN regexp_extract({q}, '\b([A-Z]{{2,6}})\b', 1) <> '' THEN regexp_extract({q}, '\b([A-Z]{{2,6}})\b', 1) "
        f"WHEN lower(({ws})[1]) IN ('a', 'an', 'the') THEN array_to_string(({ws})[2:4], ' ') ELSE array_to_string(({ws})[1:3], ' ') END"
    )


# ---- lists and definitions, without look-around: what an assertion would look at is matched and put back ----

#: White space without the line end, and anything but white space.
_BLANK = WS.replace(r"\n", "")
_SOLID = "[^" + WS[1:]
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def _bulleted(x: str) -> str:
    return rf"regexp_replace({x}, '(^|{WS})o{WS}+([A-Z])', '\1• \2', 'g')"


def _topic(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(P.LIST_STOP_WORDS))
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '{WC}+')), lambda w: length(w) > 2 AND w NOT IN ({stop}))"


def _lines(x: str) -> str:
    # twice, for a mark may follow right behind another
    for _ in range(2):
        x = rf"regexp_replace({x}, '({_SOLID}){_BLANK}+(•|[0-9]+[.)]{WS})', '\1' || chr(10) || '\2', 'g')"
    return f"string_split({x}, chr(10))"


def _items(lines: str, longest: int, whole: bool) -> str:
    """Items of a list of lines."""
    raw = strip(rf"regexp_extract({strip('z')}, '^(?:•|[-*]|[0-9]+[.)]){WS}*([^\n]+)$', 1)")
    raws = f"list_transform({lines}, lambda z: {raw})"
    if not whole:
        first = rf"regexp_extract(z, '^([^\n]{{5,250}}?[.!?])(?:{WS}+[A-Z]|{WS}*$)', 1)"
        raws = f"list_transform({raws}, lambda z: CASE WHEN {first} <> '' THEN {first} ELSE z END)"
    trimmed = rf"list_transform({raws}, lambda z: regexp_replace({strip('z')}, '[.,;:]+$', ''))"
    return f"list_filter({trimmed}, lambda z: length(z) > 2 AND length(z) < {longest})"


def plain_items(x: str) -> str:
    return _items(_lines(_bulleted(x)), P.LIST_PLAIN_LONGEST, True)


def list_steps(source: str, keep: str) -> str:
    """CTEs that end in ``listed``: the columns ``keep`` and items of (query_text, cleaned) rows of ``source``."""
    lead = rf"regexp_replace(norm, '(^|[.!?]{WS})([A-Z][^\n.!?]{{4,150}}?):({WS}+)', '\1{_OPEN}\2{_CLOSE}\3', 'g')"
    lead = rf"regexp_replace({lead}, '{_OPEN}([^{_OPEN}{_CLOSE}]*\b[0-9]+[.)]{WS}[^{_OPEN}{_CLOSE}]*){_CLOSE}', '\1:', 'g')"
    opener = rf"(?is)^.*\b(?:(?:some{WS}+)?types?{WS}+of{WS}+{WC}+|kinds?{WS}+of{WS}+{WC}+|examples?{WS}+of{WS}+{WC}+|categories{WS}+of{WS}+{WC}+|are{WS}+as{WS}+follows|include[s]?|are){WS}*:{WS}*"
    # a full stop before white space stands twice, so that it may end one item and precede the next
    body = rf"regexp_replace(regexp_replace(cleaned, '{opener}', ''), '([.!?])({WS})', '\1\1\2', 'g')"
    inline = rf"(?:^|[.!?]{WS})([A-Z][A-Za-z](?:{WC}|{WS}|[-/]){{1,40}}):{WS}+([^.!?]{{10,250}}?[.!?])"
    titles = f"list_transform(regexp_extract_all(body, '{inline}', 1), lambda z: {strip('z')})"
    said = rf"list_transform(regexp_extract_all(body, '{inline}', 2), lambda z: regexp_replace(regexp_replace({strip('z')}, '[.!?]+$', ''), '{WS}+$', ''))"
    pairs = f"list_filter(list_transform(range(1, len(ts) + 1), lambda i: {{'t': ts[i], 's': ss[i]}}), lambda x: {word_count('x.t')} <= {P.LIST_TITLE_WORDS})"
    flat = f"list_filter(list_transform({pairs}, lambda x: x.t || ': ' || x.s), lambda z: length(z) > 8 AND length(z) < {P.LIST_INLINE_LONGEST})[1:{P.LIST_MOST}]"
    return f"""l0 AS (SELECT *, {_bulleted('cleaned')} AS norm, {_topic('query_text')} AS asked FROM {source}),
l1 AS (SELECT *, list_filter(string_split({lead}, '{_OPEN}'), lambda x: contains(x, '{_CLOSE}')) AS parts, {body} AS body FROM l0),
l2 AS (SELECT *, list_max(list_transform(parts, lambda p, i: {{'shared': len(list_intersect(asked, {_topic(f"string_split(p, '{_CLOSE}')[1]")})), 'early': -i, 'body': regexp_replace(string_split(p, '{_CLOSE}')[2], '^{WS}+', '')}})) AS best, {titles} AS ts, {said} AS ss FROM l1),
l3 AS (SELECT *, CASE WHEN best.shared > 0 THEN best.body ELSE norm END AS part, {flat} AS inline FROM l2),
l4 AS (SELECT *, {_items(_lines('part'), P.LIST_LONGEST, False)} AS marked FROM l3),
listed AS (SELECT {keep}, CASE WHEN len(marked) > 1 THEN marked WHEN len(inline) > 1 THEN inline ELSE marked END AS items FROM l4)"""


_VERBS = (rf"stands?{WS}+for", rf"refers?{WS}+to", rf"can{WS}+be{WS}+defined{WS}+as", "means?", rf"is{WS}+a\b|is{WS}+an\b|is{WS}+the\b|is{WS}+defined", rf"are{WS}+a\b|are{WS}+the\b|are{WS}+defined", "is|are")


def definition_steps(source: str, keep: str) -> str:
    """CTEs that end in ``defined``: ``keep``, priority, place and sentence of (term, cleaned) rows of ``source`` that define the term."""
    colon = rf"regexp_extract(cleaned, '(?i)(?:^|[\t\n\x0b\x0c\r \x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}–—.!?(-])\b' || e || '\b{WS}*:{WS}*([^\n.!?]{{5,250}})', 1)"
    ranks = " ".join(rf"WHEN regexp_matches(z, '(?i)\b' || e || '\b[^.!?\n]{{0,80}}?\b(?:{v})\b') THEN {n}" for n, v in enumerate(_VERBS, 1))
    kept = f"list_filter({shown_sentences('cleaned')}, lambda z: contains(lower(z), lower(term)) AND NOT {header_like('z')})"
    rated = f"list_filter(list_transform(kept, lambda z, i: {{'priority': CASE {ranks} END, 'place': i, 'sentence': z}}), lambda x: x.priority IS NOT NULL)"
    return f"""d0 AS (SELECT *, regexp_escape(term) AS e FROM {source} WHERE term <> '' AND contains(lower(cleaned), lower(term))),
d1 AS (SELECT *, {colon} AS colon, {kept} AS kept FROM d0),
d2 AS (SELECT *, CASE WHEN colon <> '' THEN {{'priority': 0, 'place': 0, 'sentence': term || ': ' || {strip('colon')}}} ELSE list_min({rated}) END AS d FROM d1),
defined AS (SELECT {keep}, d.priority AS priority, d.place AS place, d.sentence AS sentence FROM d2 WHERE d IS NOT NULL)"""


def polish_steps(source: str, column: str, keep: str) -> str:
    """CTEs that end in ``polished``: ``keep`` and the polished text of a column."""
    return rf"""c0 AS (SELECT *, {clean_display(column)} AS z0 FROM {source}),
c1 AS (SELECT *, {strip(f"regexp_replace(regexp_replace(z0, '(^|{chr(92)}n|{WS}{{2,}})o{WS}+([A-Za-z])', '{chr(92)}1• {chr(92)}2', 'g'), '^(?:{WS}|[•*-])+', '')")} AS z1 FROM c0),
c2 AS (SELECT *, CASE WHEN regexp_matches(z1, '^\p{{Ll}}') THEN upper(z1[1:1]) || z1[2:] ELSE z1 END AS z2 FROM c1),
polished AS (SELECT {keep}, CASE WHEN z2 = '' OR regexp_matches(z2, '[.!?]$') OR contains(string_split(z2, chr(10))[-1], '•') THEN z2 ELSE z2 || '.' END AS polished FROM c2)"""
