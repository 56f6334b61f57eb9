"""Text functions against known cases."""

import pytest
from pyspark.sql import functions as F

from docsift.functions import lists
from docsift.functions import text as X
from docsift.operators import chunk as C
from docsift.operators import store as S

BOTH = [
    ("● one ● two", "• one • two"), ("\uf0b7 one \uf0d8 two", "• one • two"), ("Keys (A) are used", "Keys are used"), ("MALICI OUS soft ware", "malicious software"), ("Fire wall and e -mail", "Firewall and email"),
    ("word - word", "word-word"), ("a - b - c", "a-b - c"), ("x -5", "x-5"), ("infor-\nmation", "infor-mation"), ("end .  Next ,ok", "end. Next,ok"), ("�x", "x"), ("café - bar", "café-bar"), (None, ""), ("", ""),
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_cleaning(spark):
    values = [a for a, _ in BOTH]
    assert column(spark, values, X.clean_ingest) == [b for _, b in BOTH]
    assert column(spark, values, X.clean_display) == [b for _, b in BOTH]
    only = ["A\n12\nB", "A\n1234\nB", "12 Abc def"]
    assert column(spark, only, X.clean_ingest) == ["A\n\nB", "A\n1234\nB", "12 Abc def"]
    assert column(spark, only, X.clean_display) == ["A\n12\nB", "A\n1234\nB", "Abc def"]


def test_terms_and_intents(spark):
    asked = ["What is PGP?", "What does SSL stand for?", "What is a firewall?", "what is hooking in rootkits", "what is the meaning of X", 'define "symmetric key"', None, ""]
    assert column(spark, asked, X.key_term) == ["PGP", "SSL", "firewall", "hooking", "meaning of X", "symmetric key", "", ""]
    q = ["What is PGP?", "What are the types of intruders?", "secure socket layer protocols", "How does SSL work?", "SSL stands for", "listing files", "What does it mean?", None]
    assert column(spark, q, X.is_definition) == [True, True, False, False, True, False, True, False]
    assert column(spark, q, X.is_list) == [False, True, True, False, False, False, False, False]


def test_small_functions(spark):
    assert column(spark, ["12  Hello\n World", "Hello World ", "HELLO   world"], X.fingerprint) == ["hello world"] * 3
    titles = ["Short one.", "THIS IS A SECTION TITLE", "Message security topics (B)", "This is a real sentence.", "12345678901234567890", None]
    assert column(spark, titles, X.header_like) == [True, True, True, False, False, True]
    raw = ["• alpha\n• beta", "hello world", "Done!", "o apple", "12 Abc", "•", None]
    assert column(spark, raw, X.polish) == ["Alpha\n• beta", "Hello world.", "Done!", "Apple.", "Abc.", "", ""]
    assert column(spark, ["a.PDF", "b.txt", "c.doc", "pdf"], X.allowed_file) == [True, True, False, False]
    assert column(spark, [None, "", " a  b\tc "], X.word_count)[1:] == [0, 3]


def test_definition(spark):
    df = spark.createDataFrame(
        [
            ("PGP", "PGP is open source and widely used here. It is said that PGP stands for Pretty Good Privacy."),
            ("Hooking", "Intro here – Hooking: changing applicant's execution flow"),
            ("none", "nothing of that kind"),
            ("a(b", "The a(b is a thing with an odd name in it."),
            ("", "x is a y"),
        ],
        "t string, x string",
    )
    got = [r.d for r in df.select(X.definition_in("x", "t").alias("d")).collect()]
    assert (got[0].priority, got[0].sentence) == (1, "It is said that PGP stands for Pretty Good Privacy.")
    assert (got[1].priority, got[1].sentence) == (0, "Hooking: changing applicant's execution flow")
    assert got[2] is None and got[4] is None


def test_lists(spark):
    two = "Its properties are: • fast • small. Following are the steps taken at the sender: 1) sign it. 2) send it. All is done."
    inline = "Some types of alerts: Handshake failure: the parties could not agree. Bad record: a record did not verify."
    cases = [
        ("Following are the steps: 1) open it. 2) close it.", "steps", ["open it", "close it"]), (two, "what are the steps at the sender", ["sign it", "send it"]), (inline, "", ["Handshake failure: the parties could not agree", "Bad record: a record did not verify"]),
        (None, "x", []), ("", None, []), (two, None, ["fast", "small", "sign it", "send it"]),
    ]
    df = spark.createDataFrame([(i, x, q) for i, (x, q, _) in enumerate(cases)], "i int, x string, q string")
    assert [r[0] for r in df.orderBy("i").select(lists.list_items("x", "q")).collect()] == [c[2] for c in cases]
    # a lead-in that swallowed a numbered item is none
    assert column(spark, ["Types of Intruders 1) Masquerader: one who steals access.", "It is so. The steps: 1) a. Then the ways: 2) b."], lists.parts) == [[], [("The steps", "1) a. "), ("Then the ways", "2) b.")]]
    assert column(spark, ["o First thing.\n- second; and more.\n3) " + "x" * 250, None], lists.plain_items) == [["First thing", "second; and more"], []]


@pytest.mark.parametrize(
    "counts, chunks",
    [
        ([75, 75], [[75, 75]]), ([75, 76], [[75], [76]]), ([100, 30, 20, 40], [[100, 30, 20], [30, 20, 40]]), ([200], [[200]]), ([40, 120, 10], [[40], [40, 120], [10]]),
        ([60] * 4, [[60, 60], [60, 60]]), ([20] * 9, [[20] * 7, [20] * 4]),
    ],
)
def test_chunk_fold(spark, counts, chunks):
    df = spark.createDataFrame([(counts,)], "c array<int>")
    bounds = df.select(C.chunk_bounds(F.col("c"))).first()[0]
    assert [counts[b.a - 1 : b.b] for b in bounds] == chunks


def test_chunks_keep_text(spark):
    text = " ".join(f"This is sentence number {i} of the text and it has some words." for i in range(60))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "too short")], "k int, text string")
    rows = C.overlap_chunks(df, "text").orderBy("k", "pos").collect()
    assert {r.k for r in rows} == {1}
    assert all(len(r.chunk.split()) <= 150 for r in rows)
    for a, b in zip(rows, rows[1:]):
        shared = next(n for n in range(len(b.chunk), -1, -1) if a.chunk.endswith(b.chunk[:n]))
        assert 0 < len(b.chunk[:shared].split()) <= 50
    fixed = df.select("k", F.size(C.fixed_chunks("text")).alias("n")).collect()
    assert {r.k: r.n for r in fixed}[1] == 6


def test_page_labels(spark):
    pages = [[], [3], [3, 4, 5, 7], [1, 2], [1, 3, 5]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p array<int>")
    got = [r[0] for r in df.orderBy("i").select(S.page_label("p")).collect()]
    assert got == ["", "p. 3", "pp. 3-5, 7", "pp. 1-2", "pp. 1, 3, 5"]
