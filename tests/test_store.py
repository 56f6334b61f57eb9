"""Relational views on a small store, orphan references, and retrieval edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsift.operators import answer as A
from docsift.operators import embed as E
from docsift.operators import retrieve as R
from docsift.operators import store as S
from docsift.operators.orphans import Reference, orphan_counts, orphans
from docsift.sources.files import check_uploads, read_txt


@pytest.fixture(scope="module")
def store(spark):
    f = spark.createDataFrame
    return {
        "doc_catalog": f([(1, 1, "a.pdf", "pdf"), (2, 1, "b.txt", "txt"), (3, 2, "c.pdf", "pdf")], "document_id long, user_id long, document_name string, file_type string"),
        "document_section": f([(11, 1, 3), (12, 1, 4), (13, 1, 4), (14, 1, 7), (21, 2, None), (31, 3, 1)], "section_id long, document_id long, page_number int"),
        "user_query": f([(100, 1), (101, 1), (102, 1), (103, 2)], "query_id long, user_id long").withColumn("query_text", F.lit("q")),
        "retrieval_result": f([(1, 100, 11), (2, 100, 12), (3, 100, 13), (4, 100, 14), (5, 101, 11), (6, 101, 21), (7, 103, 31)], "result_id long, query_id long, section_id long"),
        "answer": f([(1, 100, "x"), (2, 101, "y"), (3, 103, "z")], "answer_id long, query_id long, answer_text string"),
    }


def test_provenance(store):
    p = S.provenance(store["retrieval_result"], store["document_section"], store["doc_catalog"])
    got = {(r.query_id, r.document_name): r.label for r in p.withColumn("label", S.page_label("pages")).collect()}
    assert got == {(100, "a.pdf"): "pp. 3-4, 7", (101, "a.pdf"): "p. 3", (101, "b.txt"): "", (103, "c.pdf"): "p. 1"}
    lines = {r.query_id: (r.sources, r.more) for r in S.source_line(p).collect()}
    assert lines[101] == ("a.pdf · p. 3, b.txt", 0)


def test_history(store):
    rows = S.history(store["user_query"], store["answer"]).filter("query_id = 102").orderBy("place").collect()
    assert [(r.shown_id, r.answer_text) for r in rows] == [(100, "x"), (101, "y"), (102, None)]


def test_delete(spark, store):
    out = S.delete_documents(store, spark.createDataFrame([(1, 1)], "document_id long, user_id long"))
    ids = {k: sorted(r[0] for r in df.select(df.columns[0] if k != "orphans" else "query_id").collect()) for k, df in out.items()}
    assert sorted(r[0] for r in out["retrieval_result"].select("result_id").collect()) == [6, 7]
    assert sorted(r[0] for r in out["user_query"].select("query_id").collect()) == [101, 102, 103]
    assert ids["orphans"] == [100]
    assert sorted(r[0] for r in out["document_section"].select("section_id").collect()) == [21, 31]
    none = S.delete_documents(store, spark.createDataFrame([(3, 1)], "document_id long, user_id long"))
    assert none["doc_catalog"].count() == 3 and none["retrieval_result"].count() == 7


def test_scope(spark, store):
    def keys(text):
        return {r.section_id for r in R.scoped(store["document_section"], store["doc_catalog"], F.lit(1), F.lit(text)).collect()}

    assert keys("2,x, 3") == {21}
    assert keys("3") == keys("") == {11, 12, 13, 14, 21, 31}


def test_append_with_ids(spark):
    old = spark.createDataFrame([(7,)], "id long")
    new = spark.createDataFrame([(c,) for c in "dacb"], "x string")
    got = sorted((r.x, r.id) for r in S.append_with_ids(old, new, "id", ["x"]).collect())
    assert got == [("a", 8), ("b", 9), ("c", 10), ("d", 11)]


def test_conflicts_and_uploads(spark):
    users = spark.createDataFrame([(1, "ann", "a@x"), (2, "bob", None)], "user_id long, username string, email string")
    new = spark.createDataFrame([(8, "ann", "n@x"), (9, "eve", "a@x"), (10, "zoe", None)], "user_id long, username string, email string")
    assert {r.user_id for r in S.register_conflicts(users, new).collect()} == {8, 9}
    names = spark.createDataFrame([("../a b.PDF",), ("x.exe",), ("",), (None,)], "file_name string")
    got = {r.file_name: (r.safe_name, r.reject) for r in check_uploads(names).collect()}
    assert got["../a b.PDF"] == ("a_b.PDF", None) and got["x.exe"][1] == "file type" and got[""][1] == "no name" and got[None][1] == "no file"


def test_read_txt(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Fire wall \xff caf".encode("latin-1") + "é".encode())
    row = read_txt(spark, str(tmp_path)).first()
    assert row.text == "Firewall café"


def test_embedders_agree(spark):
    texts = ["The the cat sat", "", None, "été à Łódź 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    m = E.hashed_matrix(texts)
    for r in E.sparse(df, "i", "x").collect():
        assert abs(m[r.i, r.bucket] - r.weight) < 1e-9
    dense = [r[0] for r in df.orderBy("i").select(E.hashed(F.coalesce("x", F.lit("")))).collect()]
    assert abs(m - dense).max() < 1e-9


def test_retrieve_edges(spark):
    sections = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "delta"), (4, None), (5, "")], "section_id long, section_text string").filter("section_text is not null")
    asked = spark.createDataFrame([(9, "alpha beta"), (10, " "), (11, None)], "query_id long, query_text string")
    rows = R.retrieve(sections, asked).collect()
    assert [(r.query_id, r.section_id, r.rank) for r in rows] == [(9, 1, 1)]
    assert R.retrieve(sections, asked.limit(0)).count() == 0
    assert R.retrieve(sections.limit(0), asked).count() == 0
    batch = R.retrieve(sections, asked, dedup=False, least=-1.0, k=2).orderBy("rank").collect()
    assert [r.section_id for r in batch] == [1, 2]


def test_boosts_by_whole_terms(spark):
    sections = spark.createDataFrame([(1, "The ½relay is round. A gate is means to shut."), (2, "A switch relay is red, a plain relay  IS not."), (3, "the C++ is old; a-b c-d e-f means it"), (4, None)], "section_id long, section_text string")
    asked = spark.createDataFrame([(1, "What is relay?"), (2, "What is switch relay?"), (3, "define is"), (4, "What is a-b c-d e-f?"), (5, "define a gate"), (6, "What is tower relay?")], "query_id long, query_text string")
    got = {(r.query_id, r.section_id) for r in R.boosts(sections, "section_id", "section_text", asked, "query_id", "query_text").collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (3, 1), (4, 3), (5, 1)}
    # only keys of whole terms meet: the last word alone brings no other term
    assert {k for k, _ in R._before_verbs("a tower relay is high")} == {"relay", "tower relay", "a tower relay"}


def _small_store(spark):
    import random

    rnd = random.Random(3)
    words = ["relay", "gate", "is", "the", "tower", "means", "pump", "a", "valve", "seal", "mast", "rope"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice((3, 8, 30)))) for _ in range(300)]
    texts += texts[:40] + ["pump " * 300 + "valve", "", "..."] + [f"{'mast ' * 25} {w}" for w in words]
    sections = spark.createDataFrame(list(enumerate(texts, 5)), "section_id long, section_text string")
    asked = [rnd.choice(("What is ", "define a ", "how does the ")) + " ".join(rnd.choices(words, k=rnd.choice((1, 2)))) + rnd.choice(("", "?")) for _ in range(120)]
    questions = spark.createDataFrame(list(enumerate([*asked, "???", " ", None, "unknown", "pump " * 300])), "query_id long, query_text string")
    return sections, questions


def _without_driver(monkeypatch):
    """Questions may not be brought to the driver nor meet every section as a dense vector."""

    def fail(*_):
        raise AssertionError("questions come to the driver")

    monkeypatch.setattr(R, "_blocks", fail)


def test_retrieve_by_counts(spark, monkeypatch):
    sections, questions = _small_store(spark)
    want = sorted(map(tuple, R.retrieve(sections, questions, encode=lambda x: E.hashed_matrix(x)).collect()))
    _without_driver(monkeypatch)
    got = sorted(map(tuple, R.retrieve(sections, questions).collect()))
    assert got == want and len({r[0] for r in got}) > 100


def test_plain_retrieval_by_counts(spark, monkeypatch):
    sections, questions = _small_store(spark)
    options = {"k": 5, "least": -2.0, "boost": False, "dedup": False}
    want = sorted(map(tuple, R.retrieve(sections, questions, encode=lambda x: E.hashed_matrix(x), **options).collect()))
    _without_driver(monkeypatch)
    got = sorted(map(tuple, R.retrieve(sections, questions, **options).collect()))
    # a question without known words has the five smallest keys
    assert got == want and [r[1] for r in got if r[0] == 120] == [5, 6, 7, 8, 9]


def test_scan_of_several_blocks(spark, monkeypatch, tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from docsift.operators import hashed as H

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = sorted((" ".join(rnd.choices(words, k=rnd.choice((3, 8, 30)))) for _ in range(400)), key=lambda x: H._length2(H.hashed_buckets(x, {})))
    monkeypatch.setattr(H, "BLOCK", 64)
    rows = next(H._section_rows([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts), pa.array([i // 3 for i in range(400)])], ["k", "t", "fp"])]))
    rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array([[7] if i % 9 == 0 else None for i in range(400)], pa.list_(pa.int64()))], [*rows.schema.names, "terms"])
    blocks = list(H._blocks([rows.slice(0, 150), rows.slice(150)]))
    pq.write_table(pa.Table.from_batches(blocks), tmp_path / "b.parquet")
    asked = [" ".join(rnd.choices(words, k=n % 5)) for n in range(60)]
    buckets = sorted({b for x in asked for b in H.hashed_buckets(x, {})})
    coded = sorted(sorted(buckets.index(b) for b in H.hashed_buckets(x, {})) for x in asked)
    batch = pa.RecordBatch.from_arrays([pa.array(coded, pa.list_(pa.int32())), pa.array([7] * 60), pa.array([[i] for i in range(60)])], ["words", "term", "ids"])
    out = [r for b in H._scan([f"file://{tmp_path}/b.parquet"], buckets, 5, 0.25, True)([batch]) for r in b.column(1).to_pylist()]
    m = E.hashed_matrix(texts)
    for x, found in zip(coded, out):
        q = [0.0] * E.DIM
        for w in x:
            q[buckets[w]] += 1
        norm = sum(v * v for v in q) ** 0.5 or 1
        score = [round(round(float(m[i] @ q) / norm, 9) + 0.1 * (i % 9 == 0), 9) for i in range(400)]
        best: dict = {}
        for s, i in sorted((-s, i) for i, s in enumerate(score) if s >= 0.25):
            best.setdefault(i // 3, (i, -s))
        assert [(r["k"], r["score"]) for r in found] == list(best.values())[:5]
    assert len(blocks) == 7


def test_plain_scan_looks_into_few_sections(monkeypatch, tmp_path):
    import random

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docsift.operators import hashed as H

    rnd = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    texts = sorted((" ".join(rnd.choices(words, k=rnd.choice((5, 20, 60)))) for _ in range(3000)), key=lambda x: H._length2(H.hashed_buckets(x, {})))
    rows = next(H._section_rows([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts), pa.array([0] * 3000)], ["k", "t", "fp"])]))
    rows = pa.RecordBatch.from_arrays([*rows.columns, pa.array([None] * 3000, pa.list_(pa.int64()))], [*rows.schema.names, "terms"])
    pq.write_table(pa.Table.from_batches(H._blocks([rows])), tmp_path / "b.parquet")
    asked = [" ".join(rnd.choices(words, k=4)) for _ in range(100)]
    buckets = sorted({b for x in asked for b in H.hashed_buckets(x, {})})
    coded = sorted((sorted(buckets.index(b) for b in H.hashed_buckets(x, {})), x) for x in asked)
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in coded], pa.list_(pa.int32())), pa.array([None] * 100, pa.int64()), pa.array([[i] for i in range(100)])], ["words", "term", "ids"])
    sizes = [0]
    best = H._best
    monkeypatch.setattr(H, "_best", lambda score, *rest: sizes.append(len(score)) or best(score, *rest))
    out = [r for b in H._scan([f"file://{tmp_path}/b.parquet"], buckets, 5, -2.0, False)([batch]) for r in b.column(1).to_pylist()]
    m, q = E.hashed_matrix(texts), E.hashed_matrix([x for _, x in coded])
    for scores, found in zip(np.round(q @ m.T, 9), out):
        assert [r["k"] for r in found] == np.lexsort((np.arange(3000), -scores))[:5].tolist()
    # no threshold and no limit yet: still not all sections of the first block are ranked for each question
    assert max(sizes) < 1000


def test_answers(spark):
    sections = spark.createDataFrame(
        [
            (1, "PGP is open source and widely used by people. It is said that PGP stands for Pretty Good Privacy."),
            (2, "The steps are: 1) open the box. 2) close the box. 3) go home."),
            (3, "A long sentence about firewalls that has content. Another one follows with more content in it. The third one says something else. And a fourth."),
        ],
        "section_id long, section_text string",
    )
    asked = spark.createDataFrame([(1, "What is PGP?"), (2, "list the steps"), (3, "How do firewalls work?"), (4, "Where is it?")], "query_id long, query_text string")
    got = spark.createDataFrame([(1, 1, 0.9, 1), (2, 2, 0.9, 1), (3, 3, 0.8, 1)], "query_id long, section_id long, score double, rank int")
    rows = {r.query_id: r for r in A.answers(asked, got, sections).collect()}
    assert rows[1].route == "definition" and rows[1].answer == "It is said that PGP stands for Pretty Good Privacy."
    assert rows[2].route == "list" and rows[2].answer == "Open the box\n• close the box\n• go home"
    assert rows[3].route == "fallback" and rows[3].answer.startswith("A long sentence") and rows[3].answer.endswith("something else.") and rows[3].context == ""
    assert rows[4].route == "not_found" and "do not contain enough" in rows[4].answer
    read = A.answers(asked, got, sections, reader=lambda df: df.withColumn("span", F.lit("Another")))
    r3 = {r.query_id: r for r in read.collect()}[3]
    assert r3.route == "reader" and r3.answer == "Another one follows with more content in it."


D = dt.datetime


def _reference(spark, src, dst):
    s = spark.createDataFrame(src, "id long, ref long, loaded_at timestamp, deleted_at timestamp, dst_first string")
    t = spark.createDataFrame(dst, "key long, loaded_at timestamp, deleted_at timestamp, hit string")
    return [Reference("src", s, "id", "ref", t, "key")]


def test_orphans(spark):
    day = lambda n: D(2024, 1, n)
    src = [(1, 10, day(1), None, "x"), (1, 10, day(9), None, "x"), (2, 20, day(1), None, "x"), (3, 30, day(1), None, "x"), (4, 40, day(1), None, "x"), (5, 99, day(1), None, "x"), (6, None, day(1), None, "x"), (7, 99, day(1), day(2), "x"), (None, 99, day(1), None, "x"), (8, 50, None, None, "x")]
    dst = [(10, day(5), None, "y"), (10, day(2), None, "y"), (20, day(3), None, "y"), (30, day(1), day(9), "y"), (40, day(1), None, "y"), (50, day(9), None, "y"), (None, day(1), None, "y")]
    refs = _reference(spark, src, dst)
    assert {(r.record_id, r.reason) for r in orphans(refs).collect()} == {(2, "late"), (3, "deleted"), (5, "missing")}
    assert {(r.month, r.reason, r.records) for r in orphan_counts(refs).collect()} == {("2024-01", "late", 1), ("2024-01", "deleted", 1), ("2024-01", "missing", 1)}
    empty = _reference(spark, src[:0], dst[:0])
    assert orphans(empty).count() == 0 and orphan_counts(empty).count() == 0
    gone = _reference(spark, src, dst[:0])
    assert {r.reason for r in orphans(gone).collect()} == {"missing"}


def test_orphans_hot_key(spark):
    src = [(i, 1 if i % 3 else i, D(2024, 1, 1 + i % 28), None, "x") for i in range(3000)]
    refs = _reference(spark, src, [(1, D(2024, 1, 15), None, "y")])
    found = orphans(refs).collect()
    late = sum(1 for i in range(3000) if i % 3 and 15 - (1 + i % 28) > 1)
    assert sum(r.reason == "late" for r in found) == late and sum(r.reason == "missing" for r in found) == 1000
    assert sum(r.records for r in orphan_counts(refs).collect()) == len(found)


def test_missing_vectors(spark):
    df = spark.createDataFrame([(1, "cat", [1.0, 0.0]), (2, "dog", None), (3, None, None)], "id long, x string, v array<float>")
    got = {r.id: r.v for r in E.with_vectors(df, "x", "v").collect()}
    assert got[1] == [1.0, 0.0] and len(got[2]) == E.DIM and sum(got[3]) == 0


def test_small_views(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 1], "ann")], "a array<int>, b array<int>, n string")
    r = S.stamped(df, "day", F.to_date(F.lit("2024-02-03"))).select(S.kept_selection(F.col("a"), F.col("b")).alias("k"), "day", S.initial("n").alias("i")).first()
    assert (r.k, r.day, r.i) == ([1, 3], dt.date(2024, 2, 3), "A")
    assert S.one(df.limit(0)) is None
    labels = spark.createDataFrame([(0, 0), (0, 3), (2, 3)], "k int, n int").select(S.selection_label(F.col("k"), F.col("n"))).collect()
    assert [x[0] for x in labels] == ["Upload documents", "All documents", "2 of 3"]


def test_once_leaves_texts_in_place(spark, monkeypatch):
    from docsift.sources import tables as T

    rows = [(i, f"text {i}", i) for i in range(300)] + [(i, f"text {i}", 900 + i) for i in range(0, 300, 7)] + [(None, "a", 1), (None, "a", 1)]
    df = spark.createDataFrame(rows, "section_id long, section_text string, loaded_at long")
    small = sorted(map(str, T.once(df, "section_id").collect()))
    monkeypatch.setattr(T, "one_split", lambda df: False)
    assert sorted(map(str, T.once(df, "section_id").collect())) == small and len(small) == 302
    plan = T.once(df, "section_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and T.once(df.limit(0), "section_id").count() == 0
