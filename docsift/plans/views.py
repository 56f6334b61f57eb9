"""Queries over the store's relations and over retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.functions import patterns as P
from docsift.functions import text as X
from docsift.functions import lists as L
from docsift.operators import answer as A
from docsift.operators import retrieve as R
from docsift.operators import store as S
from docsift.plans import base as B
from docsift.plans.base import cte, t
from docsift.sources.tables import table
from docsift.stage import Stage

# ---- store ---------------------------------------------------------------------


def documents_by_owner(s, d):
    return S.documents_by_owner(t(s, d, "doc_catalog")).select("user_id", F.col("place").cast("long").alias("place"), "document_id", "document_name", F.date_format("upload_date", "yyyy-MM-dd").alias("upload_date"))


def recent_queries(s, d):
    return S.recent_queries(t(s, d, "user_query")).select("user_id", F.col("place").cast("long").alias("place"), "query_id", "query_text")


def ownership_check(s, d):
    """Who asked for which document: owners of a document with one number less ask for it too, and are refused unless it is theirs."""
    docs = t(s, d, "doc_catalog").select("document_id", "user_id")
    requests = docs.unionByName(docs.select((F.col("document_id") + 1).alias("document_id"), "user_id"))
    return S.owned(docs, requests).distinct()


def register_conflicts(s, d):
    """Users whose name or address, in lower case and without blanks around, is one that a user already has."""
    users = t(s, d, "app_user").select("user_id", "username", "email")
    new = users.select("user_id", F.lower(F.trim("username")).alias("username"), F.lower(F.trim("email")).alias("email")).filter("length(username) > 0")
    return S.register_conflicts(users, new)


def chat_history(s, d):
    h = S.history(t(s, d, "user_query"), t(s, d, "answer"))
    return h.select("query_id", F.col("place").cast("long").alias("place"), "shown_id", "shown_text", "answer_text")


def answer_lookup(s, d):
    q = t(s, d, "user_query").select("query_id", "user_id")
    return q.join(S.answer_of(t(s, d, "answer")), "query_id")


def _provenance(s, d) -> DataFrame:
    return S.provenance(t(s, d, "retrieval_result"), t(s, d, "document_section"), t(s, d, "doc_catalog"))


def provenance(s, d):
    return _provenance(s, d).select("query_id", "document_id", "document_name", "file_type", F.concat_ws(",", F.transform("pages", lambda p: p.cast("string"))).alias("pages"))


def page_labels(s, d):
    return _provenance(s, d).select("query_id", "document_id", S.page_label("pages").alias("label"))


def source_overflow(s, d):
    return S.source_line(_provenance(s, d)).select("query_id", "sources", F.col("more").cast("long").alias("more"))


def _deleted(s, d) -> dict[str, DataFrame]:
    """Every owner deletes the first document they have."""
    tables = {n: t(s, d, n) for n in ("doc_catalog", "document_section", "retrieval_result", "user_query", "answer")}
    first = tables["doc_catalog"].groupBy("user_id").agg(F.min("document_id").alias("document_id"))
    return S.delete_documents(tables, first)


def delete_results(s, d):
    return _deleted(s, d)["retrieval_result"].select("result_id", "query_id", "section_id")


def delete_orphans(s, d):
    return _deleted(s, d)["orphans"].select("query_id")


def delete_survivors(s, d):
    out = _deleted(s, d)
    names = ("doc_catalog", "document_section", "retrieval_result", "user_query", "answer")
    counts = None
    for n in names:
        one = out[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows")
        counts = one if counts is None else counts.union(one)
    return counts


def document_names(s, d):
    return S.name_filter(t(s, d, "doc_catalog"), " Report ").select("document_id", "document_name")


def selection_labels(s, d):
    """Per owner: how many of their documents are PDF files, as the selector would say it."""
    g = t(s, d, "doc_catalog").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.lower("file_type") == "pdf").alias("k"))
    return g.select("user_id", S.selection_label(F.col("k"), F.col("n")).alias("label"))


def section_counts(s, d):
    return t(s, d, "document_section").groupBy("document_id").agg(F.count("*").alias("sections"))


# ---- vectors ---------------------------------------------------------------------


def _vector(s, d, vec_id: int) -> list[float]:
    return table(s, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def vector_topk(s, d):
    out = R.vector_topk(table(s, d, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding", _vector(s, d, 0))
    return out.select("vec_id", F.round("score", 6).alias("score"))


def _vector_batch(s, d, group: str | None) -> DataFrame:
    """Vectors whose key is divisible by twenty as questions against all vectors."""
    v = table(s, d, "embeddings", ["vec_id", "embedding", "label"])
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = R.retrieve_vectors(v, q, "vec_id", "embedding", "query_id", "q", group=group)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def vector_topk_batch(s, d):
    return _vector_batch(s, d, None)


def vector_topk_dedup(s, d):
    return _vector_batch(s, d, "label")


def scoped_topk(s, d):
    """The largest owner's first two documents as scope: their sections nearest to the first usable vector among them."""
    docs, sections = t(s, d, "doc_catalog"), t(s, d, "document_section")
    owner = docs.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    ids = [str(r[0]) for r in docs.filter(F.col("user_id") == owner).orderBy("document_id").limit(2).select("document_id").collect()]
    mine = R.scoped(sections, docs, F.lit(owner), F.lit(", ".join([*ids, "x", "999999999"])))
    usable = mine.filter((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    q = usable.orderBy("section_id").first()
    out = R.vector_topk(usable, "section_id", "embedding", q["embedding"])
    return out.select("section_id", F.round("score", 6).alias("score"))


# ---- retrieval and answers -------------------------------------------------------


def _retrieved(s, d) -> DataFrame:
    """Stored retrieval results as ranked sections: one row per question and section, best score first."""
    rows = t(s, d, "retrieval_result").filter("query_id is not null and section_id is not null").groupBy("query_id", "section_id").agg(F.max("similarity_score").alias("score"))
    rows = rows.join(t(s, d, "document_section").select("section_id", "section_text"), "section_id").filter("section_text is not null")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "section_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= P.TOP_K)


def relative_gate(s, d):
    return A.relevant(_retrieved(s, d)).select("query_id", "section_id", F.col("rank").cast("long").alias("rank"))


def numbered_sections_first(s, d):
    rows = A.cleaned_results(A.relevant(_retrieved(s, d)), t(s, d, "document_section"))
    return A.numbered_first(rows).select("query_id", "section_id", F.col("place").cast("long").alias("place"))


def context_prefix(s, d):
    return A.context(A.cleaned_results(_retrieved(s, d), t(s, d, "document_section"))).select("query_id", "context", F.col("words").cast("long").alias("words"))


def content_sentences(s, d):
    rows = A.cleaned_results(A.relevant(_retrieved(s, d)), t(s, d, "document_section"))
    return A.content_sentences(A.numbered_first(rows))


def first_section(s, d):
    return A.first_section(_retrieved(s, d).select("query_id", "section_id", "rank"), t(s, d, "document_section"))


def doc_retrieval(s, d):
    out = R.retrieve(t(s, d, "document_section").filter("section_text is not null"), t(s, d, "user_query"))
    return out.select("query_id", "section_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def doc_retrieval_plain(s, d):
    """The first variant of retrieval: five best, no boost, no removal of near-duplicates, no threshold."""
    out = R.retrieve(t(s, d, "document_section").filter("section_text is not null"), t(s, d, "user_query"), k=P.TOP_K_FIRST, least=-2.0, boost=False, dedup=False)
    return out.select("query_id", "section_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _asked(s, d) -> DataFrame:
    """Ranked results with cleaned text and the question, written once."""
    rows = A.cleaned_results(_retrieved(s, d).drop("section_text"), t(s, d, "document_section")).join(t(s, d, "user_query").select("query_id", "query_text"), "query_id")
    return Stage(s, "asked").save(rows, "retrieved")


def definition_sentence(s, d):
    """Every section is asked what the first thing is that it says something about, with the strongest sentence it has on it."""
    about = lambda c: F.concat(F.lit("What is "), F.regexp_extract(c, r"(?U)\b(\p{L}{3,}) (?:is|are|means|stands for|refers to)\b", 1), F.lit("?"))
    answer = lambda c: X.let(X.key_term(about(c)), lambda term: F.struct(term.alias("term"), X.definition_in(c, term).alias("d")))
    # exploded rather than filtered, for a filter would compute everything a second time
    rows = t(s, d, "document_section").select("section_id", F.explode(F.filter(F.array(X.let(X.clean_display("section_text"), answer)), lambda x: x["d"].isNotNull())).alias("x"))
    return rows.select("section_id", "x.term", F.col("x.d.priority").cast("long").alias("priority"), F.col("x.d.sentence").alias("sentence"))


def list_items(s, d):
    """The items that a retrieved section offers to a list question, in order."""
    rows = _asked(s, d).filter(X.is_list("query_text")).select("query_id", "section_id", F.posexplode(L.list_items("cleaned", "query_text")).alias("n", "item"))
    return rows.select("query_id", "section_id", (F.col("n") + 1).cast("long").alias("n"), "item")


def plain_list_items(s, d):
    """The simpler list rule over every section, without a question."""
    rows = t(s, d, "document_section").select("section_id", F.posexplode(L.plain_items(X.clean_display("section_text"))).alias("n", "item"))
    return rows.select("section_id", (F.col("n") + 1).cast("long").alias("n"), "item")


def best_section(s, d):
    rows = _asked(s, d)
    return A.best_section(rows, A.context(rows))


def answers(s, d):
    q = t(s, d, "user_query").filter("query_text is not null")
    return A.answers(q, _retrieved(s, d).select("query_id", "section_id", "score", "rank"), t(s, d, "document_section"))


QUERIES = {
    f.__name__: f
    for f in (
        documents_by_owner, recent_queries, ownership_check, register_conflicts, chat_history, answer_lookup, provenance, page_labels, source_overflow, delete_results, delete_orphans,
        delete_survivors, document_names, selection_labels, section_counts, vector_topk, vector_topk_batch, vector_topk_dedup, scoped_topk, relative_gate, numbered_sections_first,
        context_prefix, content_sentences, first_section, doc_retrieval, doc_retrieval_plain, definition_sentence, list_items, plain_list_items, best_section, answers,
    )
}

# ---- SQL -------------------------------------------------------------------------

_PROV = f"""{cte('document_section', 'doc_catalog', 'retrieval_result')},
pages AS (SELECT DISTINCT r.query_id, s.document_id, s.page_number AS p FROM r JOIN s USING (section_id)),
prov AS (SELECT query_id, g.document_id, d.document_name, d.file_type, g.pages FROM (SELECT query_id, document_id, coalesce(list_sort(list(p) FILTER (p IS NOT NULL)), []) AS pages FROM pages GROUP BY ALL) g JOIN d USING (document_id)),
runs AS (SELECT query_id, document_id, min(p) AS a, max(p) AS b FROM (SELECT query_id, document_id, p, p - row_number() OVER (PARTITION BY query_id, document_id ORDER BY p) AS k FROM pages WHERE p IS NOT NULL) GROUP BY query_id, document_id, k),
labels AS (SELECT query_id, document_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS l, sum(b - a + 1) AS n FROM runs GROUP BY ALL),
named AS (SELECT prov.*, CASE WHEN l IS NULL THEN '' WHEN n = 1 THEN 'p. ' || l ELSE 'pp. ' || l END AS label FROM prov LEFT JOIN labels USING (query_id, document_id))
"""
_DEL = f"""{cte('document_section', 'doc_catalog', 'retrieval_result', 'user_query', 'answer')},
gone AS (SELECT DISTINCT m.document_id FROM (SELECT user_id, min(document_id) AS document_id FROM d GROUP BY user_id) m JOIN d ON d.document_id = m.document_id AND d.user_id = m.user_id),
lost AS (SELECT section_id FROM s WHERE document_id IN (SELECT document_id FROM gone)),
affected AS (SELECT DISTINCT query_id FROM r WHERE section_id IN (SELECT section_id FROM lost)),
kept AS (SELECT * FROM r WHERE section_id IS NULL OR section_id NOT IN (SELECT section_id FROM lost)),
orphans AS (SELECT query_id FROM affected WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.query_id = affected.query_id))
"""
_VEC = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS f FROM v WHERE vec_id % 20 = 0),
sc AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(e, f), 9) AS score FROM v, q)
"""
_RET = f"""{cte('document_section', 'retrieval_result', 'user_query')},
best AS (SELECT query_id, section_id, max(similarity_score) AS score FROM r WHERE query_id IS NOT NULL AND section_id IS NOT NULL GROUP BY ALL),
ret AS (SELECT * FROM (SELECT query_id, section_id, section_text, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, section_id) AS rank FROM best JOIN s USING (section_id) WHERE section_text IS NOT NULL) WHERE rank <= 8),
top AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM ret WHERE rank <= 5),
rel AS (SELECT *, {B.clean_display('section_text')} AS cleaned FROM top WHERE score >= 0.8 * m OR rank = 1)
"""
_PLACED = rf"placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN regexp_matches(cleaned, '\b[1-9][.)]{B.WS}') THEN 0 ELSE 1 END, rank) AS place FROM rel)"

_ASKED = _RET + f", asked AS (SELECT query_id, section_id, rank, score, {B.clean_display('section_text')} AS cleaned, q.query_text FROM ret JOIN q USING (query_id))"
_SUMMARY = f"""sent AS (SELECT query_id, place, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS x FROM (SELECT query_id, place, {B.shown_sentences('cleaned')} AS l FROM placed)),
kept AS (SELECT *, lower({B.squeeze('x[1:80]')}) AS fp FROM sent WHERE NOT {B.header_like('x')}),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY place, n) AS k FROM kept) WHERE k = 1),
summary AS (SELECT query_id, string_agg(x, ' ' ORDER BY o) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, n) AS o FROM one) WHERE o <= 3 GROUP BY query_id)"""
_CONTEXT = f"""n AS (SELECT query_id, rank, cleaned, {B.word_count('cleaned')} AS w FROM asked WHERE rank <= 5), g AS (SELECT *, sum(w) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM n),
ctx AS (SELECT query_id, string_agg(cleaned, ' ' ORDER BY rank) AS context FROM g WHERE total <= 1500 GROUP BY query_id)"""
_BEST = f"""{_ASKED}, {_PLACED}, {_SUMMARY}, {_CONTEXT},
lq AS (SELECT asked.* FROM asked JOIN rel USING (query_id, section_id) WHERE {B.is_list('query_text')}), {B.list_steps('lq', 'query_id, rank')},
bullets AS (SELECT query_id, arg_min(items, rank) AS items FROM listed WHERE len(items) >= 2 GROUP BY query_id),
best_text AS (SELECT query_id, coalesce(array_to_string(list_transform(items[1:10], lambda i: '• ' || i), chr(10)), nullif(summary, ''), context) AS best
  FROM (SELECT DISTINCT query_id FROM asked) LEFT JOIN bullets USING (query_id) LEFT JOIN summary USING (query_id) LEFT JOIN ctx USING (query_id))"""


def _embed_sql(name: str, src: str) -> str:
    return f"""t{name} AS (SELECT id, ('0x' || md5(w)[1:8])::UBIGINT % 384 AS b, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM ({src})) WHERE w <> '' GROUP BY ALL),
{name} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM t{name})"""


_DOC = f"""{cte('document_section', 'user_query')},
{_embed_sql('sv', 'SELECT section_id AS id, section_text AS x FROM s WHERE section_text IS NOT NULL')},
{_embed_sql('qv', "SELECT query_id AS id, query_text AS x FROM q WHERE query_text IS NOT NULL AND trim(query_text) <> ''")},
raw AS (SELECT qv.id AS query_id, sv.id AS section_id, round(sum(qv.x * sv.x), 9) AS score FROM qv JOIN sv USING (b) GROUP BY ALL)
"""
_BOOST = f"""terms AS (SELECT query_id, term, regexp_escape(term) AS e FROM (SELECT query_id, {B.key_term('query_text')} AS term FROM q WHERE {B.is_definition('query_text')}) WHERE term <> ''),
low AS (SELECT section_id, section_text, lower(section_text) AS l FROM s),
boost AS (SELECT query_id, section_id FROM terms JOIN low ON contains(l, lower(term)) WHERE regexp_matches(section_text, '(?i)\\b' || e || '{B.WS}+(?:is|are|stands{B.WS}+for|refers{B.WS}+to|can{B.WS}+be{B.WS}+defined{B.WS}+as|means)\\b'))"""

SQL = {
    "documents_by_owner": f"{cte('doc_catalog')} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY upload_date DESC NULLS LAST, document_id) AS place, document_id, document_name, strftime(upload_date, '%Y-%m-%d') AS upload_date FROM d",
    "recent_queries": f"{cte('user_query')} SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY query_id DESC) AS place, query_id, query_text FROM q) WHERE place <= 10",
    "ownership_check": f"{cte('doc_catalog')} SELECT DISTINCT x.document_id, x.user_id FROM (SELECT document_id, user_id FROM d UNION ALL SELECT document_id + 1, user_id FROM d) x JOIN d ON d.document_id = x.document_id AND d.user_id = x.user_id",
    "register_conflicts": f"{cte('app_user')}, n AS (SELECT user_id, lower(trim(username)) AS username, lower(trim(email)) AS email FROM u WHERE length(lower(trim(username))) > 0) SELECT DISTINCT user_id, username, email FROM n WHERE username IN (SELECT username FROM u WHERE username IS NOT NULL) OR email IN (SELECT email FROM u WHERE email IS NOT NULL)",
    "chat_history": f"""{cte('user_query', 'answer')}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY query_id) AS k FROM q), f AS (SELECT query_id, arg_min(answer_text, answer_id) AS answer_text FROM (SELECT query_id, answer_id, coalesce(answer_text, chr(3)) AS answer_text FROM a WHERE query_id IS NOT NULL) GROUP BY query_id)
SELECT x.query_id, row_number() OVER (PARTITION BY x.query_id ORDER BY y.query_id) AS place, y.query_id AS shown_id, y.query_text AS shown_text, nullif(f.answer_text, chr(3)) AS answer_text
FROM n x JOIN n y ON x.user_id IS NOT DISTINCT FROM y.user_id AND y.k BETWEEN x.k - 4 AND x.k LEFT JOIN f ON f.query_id = y.query_id""",
    "answer_lookup": f"{cte('user_query', 'answer')}, f AS (SELECT query_id, nullif(arg_min(coalesce(answer_text, chr(3)), answer_id), chr(3)) AS answer_text FROM a WHERE query_id IS NOT NULL GROUP BY query_id) SELECT q.query_id, q.user_id, f.answer_text FROM q JOIN f USING (query_id)",
    "provenance": _PROV + "SELECT query_id, document_id, document_name, file_type, coalesce(array_to_string(pages, ','), '') AS pages FROM prov",
    "page_labels": _PROV + "SELECT query_id, document_id, label FROM named",
    "source_overflow": _PROV + ", o AS (SELECT query_id, list(document_name || CASE WHEN label = '' THEN '' ELSE ' · ' || label END ORDER BY document_id) AS l FROM named GROUP BY query_id) SELECT query_id, array_to_string(l[1:2], ', ') AS sources, greatest(len(l) - 2, 0) AS more FROM o",
    "delete_results": _DEL + "SELECT result_id, query_id, section_id FROM kept",
    "delete_orphans": _DEL + "SELECT query_id FROM orphans",
    "delete_survivors": _DEL + """SELECT 'doc_catalog' AS table_name, count(*) AS rows FROM d WHERE document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT 'document_section', count(*) FROM s WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT 'retrieval_result', count(*) FROM kept
UNION ALL SELECT 'user_query', count(*) FROM q WHERE query_id NOT IN (SELECT query_id FROM orphans WHERE query_id IS NOT NULL)
UNION ALL SELECT 'answer', count(*) FROM a WHERE query_id IS NULL OR query_id NOT IN (SELECT query_id FROM orphans WHERE query_id IS NOT NULL)""",
    "document_names": f"{cte('doc_catalog')} SELECT document_id, document_name FROM d WHERE contains(lower(document_name), 'report')",
    "selection_labels": f"{cte('doc_catalog')}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (lower(file_type) = 'pdf') AS k FROM d GROUP BY user_id) SELECT user_id, CASE WHEN n = 0 THEN 'Upload documents' WHEN k = 0 THEN 'All documents' ELSE k || ' of ' || n END AS label FROM g",
    "section_counts": f"{cte('document_section')} SELECT document_id, count(*) AS sections FROM s GROUP BY document_id",
    "vector_topk": "SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings) WHERE score >= 0.25 ORDER BY score DESC, vec_id LIMIT 8",
    "vector_topk_batch": _VEC + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc WHERE score >= 0.25) WHERE rank <= 8",
    "vector_topk_dedup": _VEC + ", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS n FROM sc) WHERE n = 1) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM one WHERE score >= 0.25) WHERE rank <= 8",
    "scoped_topk": f"""{cte('document_section', 'doc_catalog')}, o AS (SELECT user_id FROM d GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1),
w AS (SELECT document_id FROM d WHERE user_id = (SELECT user_id FROM o) ORDER BY document_id LIMIT 2),
m AS (SELECT section_id, embedding::DOUBLE[] AS e FROM s WHERE document_id IN (SELECT document_id FROM w) AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT section_id, round(score, 6) AS score FROM (SELECT section_id, list_cosine_similarity(e, (SELECT e FROM m ORDER BY section_id LIMIT 1)) AS score FROM m) WHERE score >= 0.25 ORDER BY score DESC, section_id LIMIT 8""",
    "relative_gate": _RET + "SELECT query_id, section_id, rank FROM rel",
    "numbered_sections_first": _RET + f", {_PLACED} SELECT query_id, section_id, place FROM placed",
    "context_prefix": _RET + f", c AS (SELECT query_id, rank, {B.clean_display('section_text')} AS x FROM ret WHERE rank <= 5), n AS (SELECT *, {B.word_count('x')} AS w FROM c), g AS (SELECT *, sum(w) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM n) SELECT query_id, string_agg(x, ' ' ORDER BY rank) AS context, sum(w)::BIGINT AS words FROM g WHERE total <= 1500 GROUP BY query_id",
    "content_sentences": _RET + f""", {_PLACED},
sent AS (SELECT query_id, place, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS x FROM (SELECT query_id, place, {B.shown_sentences('cleaned')} AS l FROM placed)),
kept AS (SELECT *, lower({B.squeeze('x[1:80]')}) AS fp FROM sent WHERE NOT {B.header_like('x')}),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY place, n) AS k FROM kept) WHERE k = 1)
SELECT query_id, string_agg(x, ' ' ORDER BY o) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, n) AS o FROM one) WHERE o <= 3 GROUP BY query_id""",
    "first_section": _RET + "SELECT query_id, section_text AS answer FROM ret WHERE rank = 1",
    "doc_retrieval": _DOC + f""", {_BOOST},
scored AS (SELECT raw.query_id, raw.section_id, round(raw.score + CASE WHEN b.query_id IS NULL THEN 0 ELSE 0.1 END, 9) AS score, {B.fingerprint('s.section_text')} AS fp
  FROM raw JOIN s USING (section_id) LEFT JOIN boost b ON b.query_id = raw.query_id AND b.section_id = raw.section_id),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY score DESC, section_id) AS n FROM scored WHERE score >= 0.25) WHERE n = 1)
SELECT query_id, section_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM one) WHERE rank <= 8""",
    "doc_retrieval_plain": _DOC + """, every AS (SELECT q.query_id, s.section_id, coalesce(raw.score, 0) AS score FROM q JOIN s ON s.section_text IS NOT NULL LEFT JOIN raw ON raw.query_id = q.query_id AND raw.section_id = s.section_id WHERE trim(q.query_text) <> '')
SELECT query_id, section_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM every) WHERE rank <= 5""",
    "definition_sentence": f"""{cte('document_section')}, c AS (SELECT section_id, {B.clean_display('section_text')} AS cleaned FROM s),
n AS (SELECT *, 'What is ' || regexp_extract(cleaned, '\\b(\\p{{L}}{{3,}}) (?:is|are|means|stands for|refers to)\\b', 1) || '?' AS query_text FROM c), terms AS (SELECT section_id, cleaned, {B.key_term('query_text')} AS term FROM n),
{B.definition_steps('terms', 'section_id, term')} SELECT section_id, term, priority::BIGINT AS priority, sentence FROM defined""",
    "list_items": _ASKED + f", lq AS (SELECT * FROM asked WHERE {B.is_list('query_text')}), {B.list_steps('lq', 'query_id, section_id')} SELECT query_id, section_id, unnest(range(1, len(items) + 1)) AS n, unnest(items) AS item FROM listed",
    "plain_list_items": f"{cte('document_section')}, c AS (SELECT section_id, {B.clean_display('section_text')} AS cleaned FROM s), i AS (SELECT section_id, {B.plain_items('cleaned')} AS items FROM c) SELECT section_id, unnest(range(1, len(items) + 1)) AS n, unnest(items) AS item FROM i",
    "best_section": _BEST + " SELECT query_id, best FROM best_text",
    "answers": _BEST + f""",
firsts AS (SELECT query_id, cleaned AS top FROM asked WHERE rank = 1),
terms AS (SELECT query_id, rank, cleaned, {B.key_term('query_text')} AS term FROM asked WHERE rank <= 5 AND {B.is_definition('query_text')}),
{B.definition_steps('terms', 'query_id, rank')},
defs AS (SELECT query_id, arg_min(sentence, (priority, rank, place)) AS definition FROM defined GROUP BY query_id),
routed AS (SELECT q.query_id, top, definition, best,
  CASE WHEN coalesce(length(context), 0) < 20 THEN 'not_found' WHEN {B.is_list('q.query_text')} THEN 'list' WHEN definition IS NOT NULL THEN 'definition' ELSE 'fallback' END AS route
  FROM q LEFT JOIN ctx USING (query_id) LEFT JOIN firsts USING (query_id) LEFT JOIN best_text USING (query_id) LEFT JOIN defs USING (query_id) WHERE q.query_text IS NOT NULL),
raw AS (SELECT query_id, route, top, CASE WHEN route = 'definition' THEN definition ELSE best END AS raw FROM routed),
{B.polish_steps('raw', 'raw', 'query_id, route, top')}
SELECT query_id, route, CASE WHEN route = 'not_found' THEN '{P.NOT_FOUND}' ELSE polished END AS answer, CASE WHEN route IN ('list', 'definition') THEN top ELSE '' END AS context FROM polished""",
}
