"""Near-duplicate join against brute force, groups of copies and odd input."""

import random

import pytest

from docsift.llm import neardup as N


def _texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            out.append(" ".join(w) or "x")
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))))
    return out


def _brute(texts, n, similarity, least):
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in enumerate(texts) if len(w := t.split()) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12}


@pytest.mark.parametrize("bucket", [1000, 4])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(N, "BUCKET", bucket)  # 4: every larger bucket is split again, and the last in blocks
    monkeypatch.setattr(N, "DEPTH", 2)
    texts = _texts(1, 150)
    got = {tuple(r) for r in N.found(spark.createDataFrame(list(enumerate(texts)), "section_id long, section_text string")).collect()}
    want = _brute(texts, 3, 0.6, 20)
    assert got <= want and len(got) >= 0.98 * len(want) and want


def test_copies_and_odd_input(spark):
    a, b = _texts(2, 1)[0], _texts(3, 1)[0]
    near = a + " extra"
    rows = [(i, a) for i in range(4)] + [(4, near)] + [(10 + i, b.upper() + "!") for i in range(7)] + [(20, b + " more")]
    rows += [(0, a), (30, None), (31, ""), (32, "too few words"), (None, a)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "section_id long, section_text string, cls string")
    got = {tuple(r) for r in N.found(df, expand=5).collect()}
    within = {(i, j) for i in range(4) for j in range(i + 1, 4)} | {(i, 4) for i in range(4)}
    star = {(10, 10 + i) for i in range(1, 7)} | {(10, 20)}
    assert got == within | star
    links = {r.section_id: (r.class_id, r.copies, r.links) for r in N.links(df, n=3, similarity=0.6).collect()}
    assert links[3] == (0, 4, 1) and links[4] == (4, 1, 1) and links[16] == (10, 7, 1) and 32 not in links or links[32] == (32, 1, 0)
    assert N.found(df.limit(0)).count() == 0 and N.links(df.limit(0)).count() == 0


def test_recall_of_the_tokens():
    """Drawn agreements of pairs at the threshold, with the tokens that splits really use again, against the computation."""
    import numpy as np

    rng = np.random.default_rng(3)
    for similarity in (0.4, 0.6, 0.8):
        for depth in (1, 3, 6):
            first, trials = N.roots(similarity, depth), 4000
            split = rng.random((trials, N.SPLITS)) < similarity
            kept = np.zeros(trials, bool)
            for _ in range(first):
                live = np.ones((trials, 1), bool)
                for _ in range(depth):
                    picks = rng.integers(0, N.SPLITS, (trials, live.shape[1] * 2))
                    live = np.repeat(live, 2, 1) & np.take_along_axis(split, picks, 1)
                kept |= live.any(1) & (rng.random(trials) < similarity)
            assert kept.mean() >= N.RECALL - 0.003 and N.missed(similarity, first, depth) <= 1 - N.RECALL


def test_levels_are_written(spark, monkeypatch):
    """No plan holds several levels of splits: pairs are read off written tables."""
    from docsift.stage import Stage

    monkeypatch.setattr(N, "BUCKET", 4)
    monkeypatch.setattr(N, "DEPTH", 2)
    df = spark.createDataFrame(list(enumerate(_texts(1, 100))), "section_id long, section_text string")
    stage = Stage(spark, "test")
    reps = stage.save(N.sketched(df, "section_id", "section_text", 3, 20, N.SPLITS + N.roots(0.6, 2)), "reps")
    out, depth = N._run(reps, stage, 0.6, 0, N.roots(0.6, 1))[:2]
    assert depth == 2 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_further_tokens_only_where_needed(spark, monkeypatch):
    from docsift.stage import Stage

    monkeypatch.setattr(N, "BUCKET", 4)
    monkeypatch.setattr(N, "DEPTH", 2)
    texts, saved = _texts(1, 60), {}
    base = texts[0].split()
    texts += [" ".join([*base, f"x{i}", f"y{i}"]) for i in range(12)] + [f"a{i} " * 4 + " ".join(f"b{i}c{j}" for j in range(20)) for i in range(40)]
    save = Stage.save

    def keep(self, df, label="t"):
        saved[label] = save(self, df, label)
        if label in ("again", "sketched"):
            saved[label + " rows"] = saved[label].select("k", "tokens").collect()
        return saved[label]

    monkeypatch.setattr(Stage, "save", keep)
    df = spark.createDataFrame(list(enumerate(texts)), "section_id long, section_text string")
    got = {tuple(r) for r in N.found(df).collect()}
    want = _brute(texts, 3, 0.6, 20)
    assert got <= want and len(got) >= 0.98 * len(want)
    first, again = saved["sketched rows"], saved["again rows"]
    assert {len(r.tokens) for r in first} == {N.SPLITS + N.tokens_at_first(0.6)} and len({len(r.tokens) for r in again}) == 1
    # copies of one text share all their buckets, others none
    assert set(range(60, 72)) <= {r.k for r in again} and not {r.k for r in again} & set(range(72, 112)) and len(again[0].tokens) > len(first[0].tokens)
