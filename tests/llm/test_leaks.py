"""Leaks against brute force, edited copies and odd input."""

import random

from docsift.llm import leaks as L
from docsift.llm.words import words


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 300)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(4, 50))) for i in range(30)]
    docs = []
    for d in range(120):
        t = text(rng.randint(0, 80))
        if d % 3 == 0:
            p = items[rng.randrange(30)][1].split()
            k = rng.randint(0, max(0, len(p) - 10))
            t += " " + " ".join(p[k : k + rng.randint(10, 20)]).upper() + ", " + text(10)
        docs.append((d, t))
    grams = {}
    for i, p in items:
        w = words(p)
        for k in range(len(w) - 14):
            grams.setdefault(tuple(w[k : k + 15]), set()).add(i)
    want = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - 14):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 15]), ())}
    got = L.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_edited_copy_and_odd_input(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven green birds watch from a tall old tree near the river bank"
    edited = passage.replace("lazy", "very lazy").replace("seven ", "").replace("tall", "high")
    docs = spark.createDataFrame([(1, edited, 0), (2, None, 0), (3, "", 0), (None, passage, 0), (4, passage, 0), (4, passage, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, passage), (8, None), (9, "too short"), (None, passage)], "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r for r in L.leaks(docs, items).collect()}
    assert set(got) == {(1, 7), (4, 7)}
    assert got[4, 7].coverage == 1.0 and got[4, 7].run == 23 and 0.7 < got[1, 7].coverage < 1 and got[1, 7].run < 15
    assert L.found(docs, items.limit(0)).count() == 0 and L.found(docs.limit(0), items).count() == 0


def test_edited_copy_in_many_documents(spark):
    passage = [f"p{i}" for i in range(42)]
    edited = " ".join(f"x{i}" if i % 7 == 6 else w for i, w in enumerate(passage))  # runs of six words
    docs = spark.createDataFrame([(d, f"d{d} begins {edited} and ends") for d in range(50)], "doc_id long, text string")
    got = L.leaks(docs, spark.createDataFrame([(7, " ".join(passage))], "item_id long, passage string")).collect()
    assert {r.doc_id for r in got} == set(range(50)) and all(r.run == 6 and r.coverage > 0.5 for r in got)


def test_many_shifts(monkeypatch):
    index = L.Passages([(i, f"a b c d e f g h i j k{i}".split()) for i in range(20)])
    texts = ["a b c d e f g h i j k3", None, "x", *["y a b c d e f g"] * 9, "a b c d e f g h i j k7 " * 30]
    want = L._leaks_of_batch(list(range(len(texts))), texts, index)
    monkeypatch.setattr(L, "SHIFTS", 50)
    monkeypatch.setattr(L, "CELLS", 40)
    assert sorted(zip(*L._leaks_of_batch(list(range(len(texts))), texts, index))) == sorted(zip(*want)) and len(want[0]) == 11 * 20
