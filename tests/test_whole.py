"""Whole results: sinks that commit or leave the old, fingerprints, gates and nested maps."""

import json

import pytest
from pyspark.sql import functions as F

from weftwork.operators import labels, merge
from weftwork.plans import findings
from weftwork.sources.whole import Whole


def test_a_failing_task_leaves_the_old_table_whole(spark, tmp_path):
    spark.dataSource.register(Whole)
    put = lambda df, **o: df.write.format("whole").options(path=f"{tmp_path}/t", **o).mode("overwrite").save()
    read = lambda: sorted(json.loads(x)["id"] for p in (tmp_path / "t").glob("*.json") for x in p.read_text().splitlines())
    put(spark.range(0, 100, 1, 4).select("id", F.lit(None).cast("string").alias("none")))
    assert read() == list(range(100)) and '"none": null' in next((tmp_path / "t").glob("*.json")).read_text()
    with pytest.raises(Exception, match="broken"):
        put(spark.range(0, 1000, 1, 4).withColumn("x", F.when(F.col("id") == 777, F.raise_error(F.lit("broken"))).otherwise("")))
    assert read() == list(range(100)) and [p.name for p in tmp_path.iterdir()] == ["t"]
    put(spark.range(5))
    assert read() == list(range(5)) and [p.name for p in tmp_path.iterdir()] == ["t"]
    put(spark.range(0))
    assert read() == []


def test_one_file_is_replaced_by_one_rename(spark, tmp_path):
    spark.dataSource.register(Whole)
    df = spark.createDataFrame([(1, 'a "quoted", é'), (2, None), (3, "line\nfeed")], "n int, s string")
    put = lambda d: d.write.format("whole").options(path=f"{tmp_path}/t.csv", kind="csv", one_file="true").mode("overwrite").save()
    put(df.coalesce(1))
    assert (tmp_path / "t.csv").read_text() == 'n,s\n1,"a ""quoted"", é"\n2,\n3,"line\nfeed"\n'
    with pytest.raises(Exception, match="one file was asked for"):
        put(df.repartition(3))
    assert (tmp_path / "t.csv").read_text().startswith("n,s\n1,") and len(list(tmp_path.iterdir())) == 1
    put(df.limit(1).coalesce(1))
    assert (tmp_path / "t.csv").read_text().count("\n") == 2
    with pytest.raises(Exception, match="kind must be"):
        df.write.format("whole").options(path=f"{tmp_path}/u", kind="xml").mode("overwrite").save()


def test_fingerprints_tell_rows_and_repeats(spark):
    rows = [(1, "a", None), (2, None, 1.5), (2, None, 1.5), (3, "", float("nan"))]
    frame = lambda r: spark.createDataFrame(r, "a int, b string, c double")
    one = frame(rows)
    assert merge.equal(one, frame(rows[::-1]).repartition(3).select("c", "a", F.col("b"))) and merge.equal(one, one.withColumn("a", F.col("a").cast("long")))
    for other in (rows[:3], [*rows, rows[0]], [rows[0], *rows[1:2] * 2, rows[0], rows[3]], [(1, "a", 0.0), *rows[1:]], [(1, None, None), *rows[1:]], [(2, "a", None), (1, None, 1.5), (2, None, 1.5), rows[3]]):
        assert not merge.equal(one, frame(other))
    assert not merge.equal(frame([(1, "x", None), (1, "x", None)]), frame([])) and merge.equal(frame([]), frame([]))


def test_findings_refuse_changed_labels_and_wrong_quotes(spark):
    docs = spark.createDataFrame([(1, "it  was too\nslow for us"), (2, "fine")], "id long, body string")
    schema = "document_id long, taxonomy_code string, evidence_span string"
    good = spark.createDataFrame([(1, "cost", "too slow"), (2, "none", " ")], schema)
    stored, gate = findings.passed(good, good.select("taxonomy_code", "document_id"), docs, ["document_id", "taxonomy_code"])
    assert gate == {"labels": 2, "quotes": 1} and merge.equal(stored, good)
    changed = spark.createDataFrame([(1, "lock-in", "too slow"), (2, "none", "")], schema)
    with pytest.raises(ValueError, match="lock-in"):
        findings.passed(changed, good, docs, ["document_id", "taxonomy_code"])
    with pytest.raises(ValueError, match="findings don't hold"):
        findings.passed(good.union(good.limit(1)), good, docs, ["document_id", "taxonomy_code"])
    for quote, doc in (("too fast", 1), ("too slow", 9)):
        bad = spark.createDataFrame([(doc, "cost", quote)], schema)
        with pytest.raises(ValueError, match=quote):
            findings.passed(bad, bad, docs, ["document_id", "taxonomy_code"])


def test_nested_maps_have_zeros_and_totals(spark):
    rows = [("cost", "hn", "s1"), ("cost", "hn", "s1"), ("cost", "se", None), ("speed", "hn", "s2"), ("none", "devto", "s1"), (None, "hn", "s1")]
    r = labels.reason_maps(spark.createDataFrame(rows, "taxonomy_code string, source string, sample string")).first()
    empty = {"s1": 0, "s2": 0, "null": 0}
    assert r["n"] == 4 and set(r["reasons"]) == {"cost", "speed"} and r["reasons"]["cost"]["n"] == 3
    cost = {k: (v["n"], v["samples"]) for k, v in r["reasons"]["cost"]["sources"].items()}
    assert cost == {"hn": (2, empty | {"s1": 2}), "se": (1, empty | {"null": 1}), "devto": (0, empty)}
    assert r["reasons"]["speed"]["sources"]["hn"]["samples"] == empty | {"s2": 1}
    none = labels.reason_maps(spark.createDataFrame(rows[4:5], "taxonomy_code string, source string, sample string")).first()
    assert none["n"] == 0 and none["reasons"] == {}
    assert labels.reason_maps(spark.createDataFrame([], "taxonomy_code string, source string, sample string")).first()["n"] == 0
