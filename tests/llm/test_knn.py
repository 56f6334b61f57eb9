"""Neighbour graph against brute force, copies and odd input."""

import numpy as np

from docsift.llm import knn as K


def _data(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    for i in range(0, n - 1, 6):
        x[i + 1] = x[i] + 0.15 * rng.standard_normal(64)
    return x * rng.uniform(0.5, 2, (n, 1))


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "section_id long, embedding array<float>")


def _truth(x):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :5]


def test_recall(spark, monkeypatch):
    for name, value in {"LEAF": 64, "FULL_LEAF": 128, "WALK_LEAF": 128}.items():
        monkeypatch.setattr(K, name, value)
    x = _data(900)
    s, top = _truth(x)
    df = _frame(spark, x)
    got = {}
    for r in K.neighbours(df).collect():
        got.setdefault(r.section_id, {})[r.neighbour_id] = r.similarity
    recall = np.mean([len(set(top[i]) & set(got[i])) / 5 for i in range(len(x))])
    assert recall >= 0.9
    assert all(abs(s[i, j] - v) < 1e-5 for i in got for j, v in got[i].items())
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if i < j and i in top[j] and s[i, j] >= 0.9}
    found = {tuple(r) for r in K.mutual(df).collect()}
    assert found <= want and len(found) >= 0.98 * len(want)
    asked = {}
    for r in K.search(df, lambda k: k % 20 == 0).collect():
        asked.setdefault(r.section_id, set()).add(r.neighbour_id)
    assert set(asked) == set(range(0, 900, 20))
    assert np.mean([len(set(top[i]) & asked[i]) / 5 for i in asked]) >= 0.9


def test_copies_and_odd_input(spark):
    x = _data(40, 1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(100 + i, rows[3][1]) for i in range(9)] + [(3, rows[3][1])]
    rows += [(200, None), (201, []), (202, [0.0] * 64), (203, [float("nan")] * 64), (204, [1.0] * 63), (205, [None] + [1.0] * 63), (None, rows[0][1])]
    df = spark.createDataFrame([(k, e, "x") for k, e in rows], "section_id long, embedding array<float>, cls string")
    got = {}
    for r in K.neighbours(df).orderBy("section_id", "rank").collect():
        got.setdefault(r.section_id, []).append(r.neighbour_id)
    assert set(got) == set(range(40)) | {100 + i for i in range(9)}
    assert got[3] == [100, 101, 102, 103, 104] and got[100] == [3, 101, 102, 103, 104] and got[108] == [3, 100, 101, 102, 103]
    pairs = {tuple(r) for r in K.mutual(df).collect()}
    six = [3, 100, 101, 102, 103, 104]
    assert {(a, b) for a in six for b in six if a < b} <= pairs and not any(b > 104 for _, b in pairs)
    assert K.mutual(df.limit(0)).count() == 0 and K.neighbours(df.limit(0)).count() == 0 and K.search(df.limit(0), lambda k: k > 0).count() == 0
    assert K.mutual(df.filter("section_id = 5")).count() == 0
