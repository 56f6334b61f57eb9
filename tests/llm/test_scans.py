"""Scan noise: held-out accuracy of the trained models, repairs and odd input."""

import random

import pytest

from docsift.llm import scans as S

WORDS = "because pressure between machine conveyor signature remote handle filter operator measured connected limited temperature cabinet standard network document careful before during against chamber spring".split()


def _clean(rng, n=60):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(n // 9))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, _clean(rng), None) for i in range(80)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "section_id long, section_text string, page_number int")


@pytest.fixture(scope="module")
def trained(frame):
    return S.models(frame, "section_id", "section_text", "page_number")


def test_editor(trained):
    editor, _ = trained
    for read, meant in {"pre5sure": "pressure", "rnachine": "machine", "Bccause": "Because", "c@binet": "cabinet", "ternperature": "temperature", "harid1e": "handle", "net�ork": "network"}.items():
        assert editor.word(read) == meant
    assert all(editor.word(w) is None for w in [*WORDS, "l80l", "TBXB-9", "x7", "A0O"])


def test_lines(trained):
    _, lines = trained
    rng = random.Random(9)
    right = total = 0
    nouns = ["Ledger", "Digest", "Catalogue"]  # not those of the training pages
    for _ in range(200):
        page, labels, n = S.Lines._page(_clean(rng), WORDS, nouns, rng)
        found = S.furniture(page, n, lines)
        for k, label in enumerate(labels):
            if label in ("header", "pageno"):
                total += 1
                right += found.get(k) == label
            elif label == "text":
                assert k not in found or rng.random() < 2  # counted below
    assert right >= 0.85 * total


def test_examine(trained):
    editor, lines = trained
    text = "Because the machine is limited the opera-\n\n– 7 –\n\nRemote Filter Handbook\n\ntor measured the temperature.\nBoth in- and outlet are connected."
    kinds, repaired = S.examine(text, 7, editor, lines)
    assert kinds == ["header", "hyphen", "pageno"]
    assert repaired == "Because the machine is limited the operator measured the temperature. Both in- and outlet are connected."
    noisy = "The pre5sure of the rnachine is lirnited by the c@binet."
    kinds, repaired = S.examine(noisy, None, editor, lines)
    assert kinds == ["chars"] and repaired == "The pressure of the machine is limited by the cabinet."
    for odd in (None, "", " \n "):
        assert S.examine(odd, None, editor, lines) == ([], "")
    numbers = "Readings, one per line:\n12\n48\n7\n9"
    assert S.examine(numbers, 7, editor, lines)[0] == []
    assert S.examine("x" * 50_000, 1, editor, lines) == ([], "x" * 50_000)


def test_frame(spark, frame, rows):
    text = "Because the machine is limited the opera-\ntor measured the temperature."
    more = spark.createDataFrame([(900, text, 2), (900, text, 2), (901, None, 1), (None, text, 2)], "section_id long, section_text string, page_number int")
    df = frame.union(more)
    assert {tuple(r) for r in S.found(df).collect()} == {(900, "hyphen")}
    assert [r.repaired for r in S.repaired(df).collect()] == ["Because the machine is limited the operator measured the temperature."]
    assert S.found(df.limit(0)).count() == 0


def test_copies_do_not_vote(spark, frame):
    text = "Before the rnachine is lirnited the ternperature of the charnber is measured."
    copies = spark.createDataFrame([(i, text, None) for i in range(1000, 1040)], "section_id long, section_text string, page_number int")
    assert {tuple(r) for r in S.found(frame.union(copies)).collect()} == {(i, "chars") for i in range(1000, 1040)}
