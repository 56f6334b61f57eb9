"""Packing: no overfull bin, every document once, fullest combinations, and odd input."""

import itertools
import random

from docsift.llm import pack as P


def test_fullest_is_fullest():
    rng = random.Random(3)
    for _ in range(100):
        have = sorted(((rng.randint(1, 20), rng.randint(1, 3)) for _ in range(rng.randint(1, 5))), reverse=True)
        have = list(dict(have).items())
        room = rng.randint(0, 40)
        got = P.fullest(have, room)
        best = max(sum(n * k for (n, _), k in zip(have, ks)) for ks in itertools.product(*[range(c + 1) for _, c in have]) if sum(n * k for (n, _), k in zip(have, ks)) <= room)
        assert sum(n * k for n, k in got.items()) == best
        assert all(k <= dict(have)[n] for n, k in got.items())


def test_patterns_use_everything():
    counts = {2048: 3, 1000: 7, 700: 5, 48: 11, 1: 4}
    left = dict(counts)
    for combo, times in P.patterns(counts):
        assert times > 0 and sum(n * k for n, k in combo.items()) <= P.CAPACITY
        for n, k in combo.items():
            left[n] -= k * times
    assert not any(left.values())


def _packed(spark, counts, capacity):
    df = spark.createDataFrame(list(counts.items()), "doc_id long, tokens int") if counts else spark.createDataFrame([], "doc_id long, tokens int")
    return P.packed(df, capacity).collect()


def test_packed(spark):
    rng = random.Random(5)
    counts = {i: 30 if i % 3 == 0 else rng.choice([1, 5, 30, 64, 99, 100, 101, 250, 1000]) for i in range(600)}
    rows = _packed(spark, counts, 100)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
    assert total == counts
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_no, []).append((r.position, r.tokens))
    for parts in bins.values():
        at = 0
        for p, n in sorted(parts):
            assert p == at
            at += n
        assert at <= 100
    assert sorted(bins) == list(range(len(bins)))
    split = {r.doc_id for r in rows if sum(x.doc_id == r.doc_id for x in rows) > 1}
    assert split == {d for d, n in counts.items() if n > 100}
    assert len(bins) <= 1.02 * sum(counts.values()) / 100 + 1


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (1, "hello world", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (4, "漢字 " * 3000, 0)], "doc_id long, text string, tokens int")
    got = {r.doc_id: r.tokens for r in P.token_counts(df).collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] > 2048
    assert _packed(spark, {}, 100) == []
