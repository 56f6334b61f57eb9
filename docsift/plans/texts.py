"""Queries over texts: cleaning, sentences, chunks, intents, terms and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as X
from docsift.operators import chunk as C
from docsift.operators import embed as E
from docsift.operators import retrieve as R
from docsift.plans import base as B
from docsift.plans.base import cte, t
from docsift.sources.files import check_uploads
from docsift.sources.tables import table


def _section(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "document_section").select("section_id", "section_text")


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", ["doc_id", "text"])


def clean_ingest(s, d):
    return _section(s, d).select("section_id", X.clean_ingest("section_text").alias("cleaned"))


def clean_display(s, d):
    return _section(s, d).select("section_id", X.clean_display("section_text").alias("cleaned"))


def sentences(s, d):
    return _documents(s, d).select("doc_id", F.posexplode(X.sentences("text")).alias("n", "sentence")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "sentence")


def word_counts(s, d):
    return _section(s, d).select("section_id", X.word_count("section_text").cast("long").alias("words"))


def chunks_fixed(s, d):
    return _documents(s, d).select("doc_id", F.posexplode(C.fixed_chunks("text")).alias("n", "chunk")).select("doc_id", (F.col("n") + 1).cast("long").alias("pos"), "chunk")


def chunks_overlap(s, d):
    return C.overlap_chunks(_documents(s, d), "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


def chunks_paged(s, d):
    return C.overlap_chunks(C.paged(_documents(s, d), "text"), "text").select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.col("pos").cast("long").alias("pos"), "chunk")


def chunk_stats(s, d):
    rows = C.overlap_chunks(_documents(s, d), "text").groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(X.word_count("chunk")).alias("words"))
    return rows


def fingerprint_dedup(s, d):
    rows = _section(s, d).select("section_id", X.fingerprint("section_text").alias("fp"))
    return rows.groupBy("fp").agg(F.min("section_id").alias("section_id"), F.count("*").alias("copies"))


def intent_flags(s, d):
    return t(s, d, "user_query").select("query_id", X.is_definition("query_text").alias("definition"), X.is_list("query_text").alias("list"))


def key_terms(s, d):
    return t(s, d, "user_query").select("query_id", X.key_term("query_text").alias("term"))


def definition_boost(s, d):
    return R.boosts(_section(s, d), "section_id", "section_text", t(s, d, "user_query"), "query_id", "query_text")


def header_sentences(s, d):
    rows = _section(s, d).select("section_id", F.posexplode(X.display_sentences(X.clean_display("section_text"))).alias("n", "sentence"))
    return rows.groupBy("section_id").agg(F.count("*").alias("sentences"), F.count_if(X.header_like("sentence")).alias("headers"))


def polish(s, d):
    return t(s, d, "answer").select("answer_id", X.polish("answer_text").alias("polished"))


def allowed_files(s, d):
    rows = check_uploads(t(s, d, "doc_catalog").select("document_id", F.col("document_name").alias("file_name")))
    return rows.select("document_id", F.col("reject").isNull().alias("allowed"))


def short_names(s, d):
    return t(s, d, "user_query").select("query_id", X.shortened("query_text").alias("label"))


def hashed_embedding(s, d):
    return E.sparse(_section(s, d), "section_id", "section_text").select("section_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


def expand_fragment(s, d):
    rows = _section(s, d).withColumn("words", X.words("section_text")).filter(F.size("words") >= 6)
    fragment = F.array_join(F.slice("words", 4, 2), " ")
    return rows.select("section_id", X.expand_to_sentence(fragment, X.squeeze("section_text")).alias("sentence"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_ingest, clean_display, sentences, word_counts, chunks_fixed, chunks_overlap, chunks_paged, chunk_stats, fingerprint_dedup, intent_flags, key_terms, definition_boost,
        header_sentences, polish, allowed_files, short_names, hashed_embedding, expand_fragment,
    )
}


def _chunk_sql(source: str, keys: str) -> str:
    """Sentence-aware chunks of (keys, text) rows by recursion over first and last sentences."""
    on = " AND ".join(f"x.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""
sent AS (SELECT {keys}, {B.sentences('text')} AS ss FROM {source}),
cum AS (SELECT {keys}, ss, list_transform(ss, lambda z: {B.word_count('z')}) AS ws FROM sent WHERE len(ss) > 0),
sums AS (SELECT {keys}, ss, ws, list_transform(range(1, len(ws) + 1), lambda i: list_sum(ws[1:i])) AS cs FROM cum),
chunk AS (
  SELECT {keys}, 1::BIGINT AS pos, 1::BIGINT AS a, greatest(1, len(list_filter(cs, lambda v: v <= 150)))::BIGINT AS b FROM sums
  UNION ALL
  SELECT {keys}, pos, a, greatest(b + 1, len(list_filter(cs, lambda v: v - before <= 150)))::BIGINT AS b FROM (
    SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.pos + 1 AS pos, n.a, x.cs, c.b, x.cs[n.a] - x.ws[n.a] AS before
    FROM chunk c JOIN sums x ON {on},
    LATERAL (SELECT coalesce(list_min(list_filter(range(c.a, c.b + 1), lambda i: x.cs[c.b] - (x.cs[i] - x.ws[i]) <= 50)), c.b + 1) AS a) n
    WHERE c.b < len(x.ss))
), chunks AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.pos, {B.strip("array_to_string(x.ss[c.a:c.b], ' ')")} AS chunk FROM chunk c JOIN sums x ON {on})
"""


_S = cte("document_section")
_FIXED = f"""list_filter(regexp_split_to_array(text, '{B.WS}+'), lambda w: w <> '')"""
_SHOWN = B.shown_sentences(B.clean_display("section_text"))
_BLOCKS = rf"string_split(regexp_replace(coalesce(text, ''), '\n[ \t]*\n', chr(2), 'g'), chr(2))"
_WORDS = f"list_filter(regexp_split_to_array(section_text, '{B.WS}+'), lambda w: w <> '')"

SQL = {
    "clean_ingest": f"{_S} SELECT section_id, {B.clean_ingest('section_text')} AS cleaned FROM s",
    "clean_display": f"{_S} SELECT section_id, {B.clean_display('section_text')} AS cleaned FROM s",
    "sentences": f"SELECT doc_id, unnest(range(1, len(ss) + 1)) AS n, unnest(ss) AS sentence FROM (SELECT doc_id, {B.sentences('text')} AS ss FROM documents)",
    "word_counts": f"{_S} SELECT section_id, {B.word_count('section_text')} AS words FROM s",
    "chunks_fixed": f"SELECT doc_id, i AS pos, array_to_string(ws[(i - 1) * 150 + 1 : i * 150], ' ') AS chunk FROM (SELECT doc_id, ws, unnest(range(1, (len(ws) + 149) // 150 + 1)) AS i FROM (SELECT doc_id, {_FIXED} AS ws FROM documents))",
    "chunks_overlap": f"WITH RECURSIVE {_chunk_sql('documents', 'doc_id')} SELECT doc_id, pos, chunk FROM chunks",
    "chunks_paged": f"WITH RECURSIVE pages AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS page_number, unnest(ps) AS text FROM (SELECT doc_id, {_BLOCKS} AS ps FROM documents)), {_chunk_sql('pages', 'doc_id, page_number')} SELECT doc_id, page_number, pos, chunk FROM chunks",
    "chunk_stats": f"WITH RECURSIVE {_chunk_sql('documents', 'doc_id')} SELECT doc_id, count(*) AS sections, sum({B.word_count('chunk')})::BIGINT AS words FROM chunks GROUP BY doc_id",
    "fingerprint_dedup": f"{_S} SELECT fp, min(section_id) AS section_id, count(*) AS copies FROM (SELECT section_id, {B.fingerprint('section_text')} AS fp FROM s) GROUP BY fp",
    "intent_flags": f"{cte('user_query')} SELECT query_id, {B.is_definition('query_text')} AS definition, {B.is_list('query_text')} AS list FROM q",
    "key_terms": f"{cte('user_query')} SELECT query_id, {B.key_term('query_text')} AS term FROM q",
    "definition_boost": f"""{cte('document_section', 'user_query')}, terms AS (SELECT query_id, term, regexp_escape(term) AS e FROM (SELECT query_id, {B.key_term('query_text')} AS term FROM q WHERE {B.is_definition('query_text')}) WHERE term <> ''),
low AS (SELECT section_id, section_text, lower(section_text) AS l FROM s)
SELECT query_id, section_id FROM terms JOIN low ON contains(l, lower(term)) WHERE regexp_matches(section_text, '(?i)\\b' || e || '{B.WS}+(?:is|are|stands{B.WS}+for|refers{B.WS}+to|can{B.WS}+be{B.WS}+defined{B.WS}+as|means)\\b')""",
    "header_sentences": f"{_S} SELECT section_id, count(*) AS sentences, count(*) FILTER ({B.header_like('x')}) AS headers FROM (SELECT section_id, unnest({_SHOWN}) AS x FROM s) GROUP BY section_id",
    "polish": f"{cte('answer')}, {B.polish_steps('a', 'answer_text', 'answer_id')} SELECT answer_id, polished FROM polished",
    "allowed_files": f"{cte('doc_catalog')} SELECT document_id, coalesce(trim(document_name) <> '' AND contains(document_name, '.') AND lower(string_split(document_name, '.')[-1]) IN ('pdf', 'txt'), false) AS allowed FROM d",
    "short_names": f"{cte('user_query')} SELECT query_id, CASE WHEN length(query_text) <= 40 THEN query_text ELSE regexp_replace(query_text[1:32], ' [^ ]*$', '') || '...' END AS label FROM q",
    "hashed_embedding": f"""{_S}, w AS (SELECT section_id, ('0x' || md5(tok)[1:8])::UBIGINT % 384 AS bucket FROM (SELECT section_id, unnest(regexp_split_to_array(lower(section_text), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM s) WHERE tok <> ''),
n AS (SELECT section_id, bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT section_id, bucket::BIGINT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY section_id)), 6) AS weight FROM n""",
    "expand_fragment": f"""{_S}, f AS (SELECT section_id, {B.squeeze('section_text')} AS x, array_to_string(ws[4:5], ' ') AS f FROM (SELECT section_id, section_text, {_WORDS} AS ws FROM s) WHERE len(ws) >= 6),
p AS (SELECT *, position(lower(f) IN lower(x)) AS k FROM f)
SELECT section_id, {B.strip("regexp_extract(x[1:k - 1], '([^.!?\\n]*)$', 1) || x[k:k + length(f) - 1] || regexp_extract(x[k + length(f):], '^([^.!?]*[.!?]?)', 1)")} AS sentence FROM p""",
}
