"""Spans of any length against ``in`` over all pairs, and the small repairs beside them."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftwork.operators import spans
from weftwork.plans import queries
from weftwork.sources import adapters


def flat(text):
    return re.sub(r"[\s\x1c-\x1f]+", " ", text).strip(" ")


@pytest.mark.parametrize("sent", [1_000_000, 3])
def test_equals_in_over_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(spans, "SENT", sent)
    monkeypatch.setattr(spans, "AT_ONCE", 300)
    rng = random.Random(sent)
    words = ["a", "an", "the", "their", "é", "日本", "x" * 40, "of", "and", "hand", "band"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(n))
    docs = [(i if i else None, text(rng.randint(0, 60)), "") for i in range(120)] + [(500, None, ""), (501, "", ""), (502, " \n ", ""), (502, "the end", ""), (503, "long " * 3000 + "needle in hay", "")]
    items = [(i, rng.choice([text(1), text(2), text(3), text(12), flat(text(30))[3:-4]]), "") for i in range(60)]
    items += [(100, "a", ""), (101, "he", ""), (102, "d a", ""), (103, "日", ""), (104, None, ""), (105, " ", ""), (106, "needle  in\nhay", ""), (100, "and", ""), (107, "nowhere to be found at all in any of these", "")]
    for d in docs[:5]:
        items.append((200, (d[1] or "x")[4:90], ""))
    got = spans.contained(spark.createDataFrame(docs, "doc long, text string, item string").repartition(4), spark.createDataFrame(items, "n int, text string, m string"), "doc", "n")
    want = [(d, i, flat(t), flat(s)) for d, t, _ in docs for i, s, _ in items if t is not None and s is not None and flat(s) and flat(s) in flat(t)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 500


def test_no_items_and_no_documents(spark):
    docs, items = spark.createDataFrame([(1, "x")], "d long, text string"), spark.createDataFrame([(1, "x")], "i long, text string")
    assert spans.contained(docs, items.limit(0), "d", "i").collect() == [] == spans.contained(docs.limit(0), items, "d", "i").collect()
    assert [tuple(r) for r in spans.contained(docs, items, "d", "i").collect()] == [(1, 1, "x", "x")]


def test_radius_pairs_of_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [1.0]), (7, [2.0]), (8, [1e-200, 1e-201]), (9, []), (10, [None, 1.0]), (11, [math.inf, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r["a"], r["b"]) for r in queries.embedding_radius_pairs(spark, str(tmp_path)).collect()) == [(1, 2), (1, 8), (2, 8), (6, 7)]
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.embedding_radius_pairs(spark, f"{tmp_path}/none").collect() == []


def test_hits_of_one_second_are_not_lost():
    from datetime import UTC, datetime

    hits = [{"objectID": str(k), "created_at_i": 1_700_000_000 + k // 7} for k in range(1500)]

    def get(url, query, tags, hitsPerPage, numericFilters):
        if tags == "comment":
            return adapters.Reply({"hits": []})
        most = re.search(r"created_at_i<=(\d+)", numericFilters)
        found = [h for h in reversed(hits) if not most or h["created_at_i"] <= int(most[1])]
        return adapters.Reply({"hits": found[:hitsPerPage]})

    since = datetime(2020, 1, 1, tzinfo=UTC)
    for cap in (10, 50, 1000):
        assert sorted(int(x["external_id"]) for x in adapters.hackernews("q", since, 0, get, cap=cap)) == list(range(1500))
    with pytest.raises(ValueError, match="seconds with 5 hits"):
        list(adapters.hackernews("q", since, 0, get, cap=5))


def test_spread_runs_nothing(spark):
    from weftwork.session import spread

    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        runs.add(1)
        return x

    spread(spark.range(100).groupBy((F.col("id") % 3).alias("k")).agg(F.max(seen("id")).alias("m")))
    assert runs.value == 0
