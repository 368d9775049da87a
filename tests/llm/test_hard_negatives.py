"""Hard negatives against brute force, and the bounds of product quantisation."""

import math

import numpy as np

from weftwork.llm.hard_negatives import Tables, _Best, encode, fit_codebook, hard_negatives, index, scores, window

SCHEMA = "vec_id long, embedding array<double>, label int, score string, dim string"


def brute(rows, every=50, positives=5, negatives=3):
    fine = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = min(fine.get(i, (label, v)), (label, v))
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in fine.items()}
    out = []
    for a, (label, v) in q.items():
        if a % every:
            continue
        s = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in q.items() if i != a and len(w) == len(v)}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if q[i][0] == label][:positives]:
            hits = [i for i in order if q[i][0] != label and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:negatives]
            out += [(a, p, r, i, s[p], s[i]) for r, i in enumerate(hits, 1)]
    return sorted(out)


def table(seed=0, n=1500, dim=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(6, dim))
    rows = [(i, (c[i % 6] * rng.uniform(0.3, 1.2) + rng.normal(size=dim) * 0.6).round(2).tolist(), int(rng.integers(0, 3)) if i % 3 else 1, "x", "y") for i in range(n)]
    rows += [(n + i, rows[50][1], i % 2, "", "") for i in range(40)]  # equal vectors: ties
    rows += [rows[100], rows[200], (100, rows[7][1], 2, "", ""), (-50, rows[9][1], 0, "", ""), (None, rows[3][1], 1, "", "")]
    rows += [(9001, None, 1, "", ""), (9002, [], 1, "", ""), (9050, [1.0, None], 1, "", ""), (9003, [math.nan] * dim, 1, "", ""), (9004, [math.inf] * dim, 0, "", ""), (9100, rows[2][1], None, "", "")]
    rows += [(9150, [1.0, 2.0], 0, "", ""), (9151, [2.0, 2.5], 0, "", ""), (9152, [1.5, 1.0], 1, "", ""), (9153, [0.0, 0.0], 1, "", ""), (9200, [0.0, 0.0], 1, "", "")]
    return rows


def test_equals_brute_force(spark):
    rows = table()
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_several_passes_give_the_same(spark, monkeypatch):
    rows = table(1, 700)
    monkeypatch.setattr("weftwork.llm.hard_negatives.ANCHOR_BYTES", 600)
    monkeypatch.setattr("weftwork.llm.hard_negatives.ROWS", 64)
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_empty_table_and_one_row(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives(spark.createDataFrame([(0, [1.0], 1, "", "")], SCHEMA)).collect() == []


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(8, 32))[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 32)) * 0.15)).astype(np.int64)
    for book in (fit_codebook(x[:500].astype(float)), fit_codebook(np.zeros((0, 32)))):
        codes, left = encode(x.astype(float), book)
        total, error = Tables(x[:60].astype(float), book).bounds(codes, left)
        exact = x @ x[:60].T
        assert (np.abs(total.astype(float) - exact) <= error).all()
        huge = Tables(x[:60] * 1e12, [(a, b, c * 1e12) for a, b, c in book])
        total, error = huge.bounds(codes, left * np.float32(1e12))
        assert (np.abs(total - exact * 1e24) <= error).all()
    book = fit_codebook(x.astype(float))
    total, error = Tables(x[:60].astype(float), book).bounds(*encode(x.astype(float), book))
    fifth = np.sort(total - error, axis=0)[-5]
    assert (total + error >= fifth).mean() < 0.3


def test_index_has_every_fine_row(spark):
    rows = table(2, 300)
    found, books = index(spark.createDataFrame(rows, SCHEMA))
    fine = {i for i, v, label, *_ in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    assert {r["vec_id"] for r in found.collect()} == fine and found.count() == len(fine) and set(books) == {2, 12}


def test_windows_and_large_scores():
    for s in (0, 1, 7, 199, -3, 10**12 + 1, 2**62):
        lo, hi = window(s, 50, 95)
        assert 100 * lo >= 50 * s > 100 * (lo - 1) and 100 * hi <= 95 * s < 100 * (hi + 1)
    big = np.array([[2**62, 3]], np.int64)
    assert scores(big, big).tolist() == [2**63 - 1]
    assert scores(np.array([[2**31, 5]]), np.array([[2**31 - 1, -5]])).tolist() == [2**31 * (2**31 - 1) - 25]
    best = _Best(1, 2)
    for s, i in ((2**60, 9), (2**60 + 1, 8), (2**60 + 1, 3)):
        best.add(np.array([0]), np.array([s]), np.array([i]))
    assert best.id.tolist() == [3, 8] and best.last[0] <= 2**60 + 1
