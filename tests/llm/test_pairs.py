"""Defects of answers, by rule and as a whole."""

import pytest

from docsift.llm import pairs as P

Q = "How does the wireless pump work?"


@pytest.mark.parametrize(
    "question, answer, want",
    [
        (Q, None, "empty"), (Q, " \n", "empty"), (Q, "...", "empty"), (Q, "<p></p>", "empty"), (Q, "[]", "empty"), (Q, "N/A", "empty"), (Q, "null", "empty"), (Q, "Nobody", None), (Q, "No", None),
        (Q, Q, "copied"), (Q, f"Q: {Q}", "copied"), (Q, f"{Q} {Q}", "copied"), (Q, "how does the wireless pump work", "copied"), (Q, f"{Q} In short: it turns the wheel of the mill.", None),
        ("什么是喷嘴？", "什么是喷嘴？", "copied"),
        (Q, "I am sorry, but I cannot help with that.", "refusal"), (Q, "Hello! I don't know.", "refusal"), (Q, "No relevant passage was found for your question. Please try again with another question.", "refusal"),
        (Q, "The files you uploaded say nothing about this, I'm afraid.", "refusal"), (Q, "As a document assistant, I must decline to answer.", "refusal"),
        (Q, "Sorry states such as a stuck pump are cleared as soon as the valve opens.", None), (Q, "Unable to open means that the pump is stopped.", None), (Q, "Nothing may be placed on the pump while it runs.", None),
        (Q, "The pump cannot be opened by the user; only the vendor can do so.", None),
        ("Wozu dient die Ladung?", "Leider kann ich diese Frage nicht beantworten.", "refusal"), ("¿Qué es?", "No se encontró ningún pasaje útil.", "refusal"), ("什么是喷嘴？", "所选文件中没有相关内容。", "refusal"),
        ("什么是喷嘴？", "如果没有垫片，则垫片无法充电。", None), ("放熱器とは何ですか？", "申し訳ありませんが、お答えできません。", "refusal"),
        (Q, "Die Glaskammer ist mit der Pumpe durch einen leichten Träger verbunden.", "language"), (Q, "所述薄膜通过多孔部件与薄膜连接。", "language"), ("What do they call the pump in Spanish?", "Se dice «válvula» o también «bobina».", None),
        (Q, "The pump is driven by the", "truncated"), (Q, "It turns. Then the wheel of the mi", "truncated"), (Q, "The ratio of the pump to the …", "truncated"), (Q, "It is set (see the list", "truncated"), (Q, "```\ncode", "truncated"),
        (Q, "Pump\n• wheel\n• valve", None), (Q, "About 84.7 µm", None), (Q, "The shift lead (weekly)", None),
    ],
)
def test_verdict(question, answer, want):
    assert P.verdict(question, answer)[0] == want


def test_parser():
    assert P.open_at_end("a (b [c] d) “e” `f`") == [] and P.open_at_end("a (b [c") == ["(", "["] and P.open_at_end("<b>x") == ["<b"] and P.open_at_end("<br>x") == []


def test_tiling():
    assert P.tile("a b c a b".split(), "a b c".split()) == [True] * 5 and P.tile("a x".split(), "a b".split()) == [False, False]


def test_frame(spark):
    answers = [(1, 1, None), (2, 1, "It is a pump that turns the wheel."), (2, 1, "It is a pump that turns the wheel."), (3, 99, None), (4, None, None), (5, 2, ""), (None, 1, None), (6, 3, "x y.")]
    a = spark.createDataFrame([(*r, "x") for r in answers], "answer_id long, query_id long, answer_text string, query_text string")
    q = spark.createDataFrame([(1, Q), (1, Q), (2, None), (3, ""), (None, Q)], "query_id long, query_text string")
    assert {tuple(r) for r in P.defects(a, q).collect()} == {(1, "empty"), (5, "empty")}
    assert P.defects(a.limit(0), q).count() == 0 and P.defects(a, q.limit(0)).count() == 0


def test_statistics_decide_lone_phrases(spark):
    whole = [(i, 1, f"Three of the {w} units failed because the pump was stopped.") for i, w in enumerate("red green blue small large old new wide tall thin".split())]
    odd = [(100, 1, "Three of the red units failed"), (101, 1, "Once every week"), (102, 1, "Three of the red units fai")]
    a = spark.createDataFrame(whole + odd, "answer_id long, query_id long, answer_text string")
    q = spark.createDataFrame([(1, Q)], "query_id long, query_text string")
    assert {r.answer_id for r in P.defects(a, q).collect()} == {100, 102}


def test_copies_of_a_truncated_answer(spark):
    whole = [(i, 1, f"The pump number {i} moves the water of the tank to the boiler.") for i in range(8)]
    cut = [(i, 1, "The pump moves the water towards some distant vessel") for i in range(20, 30)]
    answers = spark.createDataFrame(whole + cut, "answer_id long, query_id long, answer_text string")
    questions = spark.createDataFrame([(1, "What does the pump do?")], "query_id long, query_text string")
    assert {tuple(r) for r in P.defects(answers, questions).collect()} == {(i, "truncated") for i in range(20, 30)}
