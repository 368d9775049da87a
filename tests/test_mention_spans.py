"""Mentions by windows against the sweep over batches."""

import random

import pytest
from pyspark.sql import functions as F

from weftwork.functions.rules import PLATFORMS, Ambiguous, Rules
from weftwork.operators import mentions
from weftwork.operators.mention_spans import find_mentions
from weftwork.plans.queries import RULES
from weftwork.session import table

SCHEMA = "id long, body string, title string, text string"


def compare(spark, docs, rules, title="title"):
    got, rejected = find_mentions(docs, rules, title=title)
    found = mentions.with_mentions(docs, rules, title=title)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = rows(mentions.mention_rows(found))
    assert rows(got.select("document_id", "entity", "mention_count", "first_char_offset")) == want
    lost = rows(mentions.rejection_rows(found))
    assert rows(rejected.select("document_id", "entity", "term", "reason", "snippet")) == lost
    return want, lost


def made(rng, pieces, n):
    text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(pieces) + rng.choice([" ", "  ", "\n", ", ", ". ", ""]) for _ in range(rng.randint(0, 25)))
    return [(i if i else None, text(), rng.choice([text(), text(), None, "the", "same"]), "") for i in range(n)] + [(n, "same the", "same the", ""), (n, "token to of the" * 400, "to", "")]


def test_equals_the_sweep_on_made_texts(spark):
    rng = random.Random(4)
    pieces = ["the", "The", "to", "To", "TO", "of", "of the", "to the", "token", "password", "=", "licensed under", "all rights reserved", "released under the MIT license", "tokens", "étoile", "ofto", "le", "x" * 30]
    want, lost = compare(spark, spark.createDataFrame(made(rng, pieces, 150), SCHEMA).repartition(4), RULES)
    assert len(want) > 200 and {r[3] for r in lost} == {"excluded", "no_context"}


def test_equals_the_sweep_with_platform_rules(spark):
    rng = random.Random(6)
    words = [a.term for a in PLATFORMS.ambiguous] + [p for ps in PLATFORMS.aliases.values() for p in ps] + [p for _, p in PLATFORMS.excluded]
    plain = {w.replace("\\b", "").replace("\\s+", " ").replace("\\", "").replace("?", "") for w in words}
    pieces = sorted(w for w in plain if w.replace(" ", "").replace("-", "").isalnum()) + ["data", "warehouse", "cloud", "sql", "lakehouse", "spark", "Fabric", "Spark", "AWS", "table", "of", "the"]
    want, lost = compare(spark, spark.createDataFrame(made(rng, pieces, 250), SCHEMA).repartition(4), PLATFORMS)
    assert len(want) > 200 and lost


def test_equals_the_sweep_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.lit(None).cast("string").alias("title"))
    assert len(compare(spark, docs, RULES)[0]) > 100


@pytest.mark.parametrize("rules", [Rules(aliases={"a": (r"\bx\b",)}), Rules(ambiguous=(Ambiguous("w", r"\bx\b", 5, ()),)), Rules(excluded=(("e", r"\bx y\b"),))])
def test_rules_of_one_tier_and_no_texts(spark, rules):
    docs = spark.createDataFrame([(1, "x y x", None, ""), (1, "x", "x x", ""), (2, "nothing", None, "")], SCHEMA)
    compare(spark, docs, rules)
    compare(spark, docs.limit(0), rules)
    compare(spark, docs, rules, title=None)


def test_no_python_worker_sees_a_text(spark):
    got, rejected = find_mentions(spark.createDataFrame([(1, "the token", None, "")], SCHEMA), RULES)
    for df in (got, rejected):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "InPandas", "InArrow"))
