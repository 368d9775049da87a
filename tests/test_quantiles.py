"""Exact quantiles against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftwork.operators import corpus
from weftwork.operators.quantiles import exact_quantiles

PS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]


def sorted_quantile(values, p):
    v = sorted(values, key=lambda x: (x != x, x))
    at = p * (len(v) - 1)
    k = math.floor(at)
    a, b = v[k], v[min(k + 1, len(v) - 1)]
    return a if a == b or at == k else a + (b - a) * (at - k)


@pytest.mark.parametrize("most", [20, 50_000])
def test_equals_sorting(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([0.0, 1.0, rng.gauss(0, 1), rng.expovariate(0.01)]), rng.randint(0, 3), 0) for _ in range(6000)]
    rows += [("one", 5.0, None, 0), ("none", None, None, 0), ("two", 1.0, 2, 0), ("two", math.inf, 4, 0), ("nan", math.nan, 1, 0), ("nan", 3.0, 1, 0), ("same", 7.0, 7, 0), ("same", 7.0, 7, 0), ("-inf", -math.inf, 1, 0), ("-inf", -math.inf, 1, 0)]
    got = {(r["by"], r["column"], r["p"]): r["value"] for r in exact_quantiles(spark.createDataFrame(rows, "by string, x double, y int, column int").repartition(5), ["by"], ["x", "y"], PS, most).collect()}
    want = {}
    for by in {r[0] for r in rows}:
        for i, c in ((1, "x"), (2, "y")):
            v = [float(r[i]) for r in rows if r[0] == by and r[i] is not None]
            want |= {(by, c, p): sorted_quantile(v, p) for p in PS if v}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, nan_ok=True, rel=1e-12), k


def test_without_groups_and_rows(spark):
    df = spark.range(1, 1002).select(F.col("id").alias("x"))
    assert {r["p"]: r["value"] for r in exact_quantiles(df, [], ["x"], [0.5, 0.999], 10).collect()} == {0.5: 501.0, 0.999: 1000.0}
    assert exact_quantiles(df.limit(0), [], ["x"], [0.5]).collect() == []
    r = corpus.describe(df, "x").first()
    assert (r["n"], r["p10"], r["p50"], r["high"]) == (1001, 101.0, 501.0, 1001)
    assert corpus.describe(df.limit(0), "x").first()["p50"] is None


def test_no_report_keeps_the_values_of_a_group_in_one_place(spark):
    docs = spark.createDataFrame([("s", 5, 30, True), ("s", 40, 200, False), (None, 7, 9, False)], "source string, words int, chars int, switching boolean")
    report = corpus.source_report(docs)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    assert {r["source"]: (r["documents"], r["median_words"], r["median_chars"]) for r in report.collect()} == {"s": (2, 22.5, 115.0), None: (1, 7.0, 9.0)}
