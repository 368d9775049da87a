"""Keyed state, merges by buckets, the replayed source and the table function, against their batch forms."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from weftwork.functions.rules import Ambiguous, Rules
from weftwork.operators import mentions, merge
from weftwork.operators.buckets import Buckets
from weftwork.plans.queries import RULES
from weftwork.session import table
from weftwork.sources.replay import Envelopes, Replay
from weftwork.streaming.latest import refresh

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


# --- keyed state -----------------------------------------------------------------------

EVENTS = "user string, at timestamp, n long, value double, extra string"


def test_stream_equals_batch_after_restarts_and_late_rows(spark, tmp_path):
    events = table(spark, DATA, "events").select(F.col("user_id").cast("string").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("n"), "value", F.col("props").alias("extra"))
    parts = [events.where(f"n % 4 = {k}") for k in (2, 0, 3, 1)]  # mixed in time: each part has rows older than the state
    into = Buckets(f"{tmp_path}/table", ("user",), 16)
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        refresh(stream, into, ["at", "n"], f"{tmp_path}/checkpoint").awaitTermination()  # each round is a restart
        so_far = parts[0]
        for p in parts[1 : k + 1]:
            so_far = so_far.unionByName(p)
        assert rows(into.read(spark).select(*events.columns)) == rows(merge.latest(so_far, ["user"], [F.col("at"), F.col("n")]))
    before = files(tmp_path / "table")
    refresh(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), into, ["at", "n"], f"{tmp_path}/checkpoint").awaitTermination()
    events.where("n = 0").withColumn("at", F.lit("1999-01-01").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
    refresh(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), into, ["at", "n"], f"{tmp_path}/checkpoint").awaitTermination()
    assert files(tmp_path / "table") == before  # nothing new, then a late row: nothing is written


def test_state_bears_nulls_ties_and_nan(spark, tmp_path):
    data = [(None, None, 1, 1.0, "x"), (None, None, None, 2.0, "y"), ("a", None, 5, math.nan, "p"), ("a", None, 5, 9.0, "q"), ("b", None, 7, 1.0, "m"), ("b", None, 7, 1.0, "k"), ("b", None, 7, 1.0, "m")]
    spark.createDataFrame(data, EVENTS).repartition(3).write.parquet(f"{tmp_path}/in")
    into = Buckets(f"{tmp_path}/table", ("user",), 4)
    refresh(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), into, ["n", "value"], f"{tmp_path}/c", ttl_seconds=3600).awaitTermination()
    got = {r["user"]: (r["n"], r["extra"]) for r in into.read(spark).collect()}
    assert got == {None: (1, "x"), "a": (5, "p"), "b": (7, "m")}


# --- buckets ---------------------------------------------------------------------------


def test_a_small_merge_touches_only_its_buckets(spark, tmp_path):
    orders = table(spark, DATA, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    t = Buckets(f"{tmp_path}/orders", ("o_orderkey",), 128)
    t.create(orders)
    keys = [r[0] for r in orders.select("o_orderkey").orderBy("o_orderkey").limit(max(1, orders.count() // 100)).collect()]
    new = orders.where(F.col("o_orderkey").isin(keys)).withColumn("o_orderstatus", F.lit("N")).withColumn("o_custkey", F.lit(0).cast("long"))
    new = new.unionByName(new.limit(1).withColumn("o_orderkey", F.lit(10**9).cast("long"))).withColumn("o_orderkey", F.col("o_orderkey").cast("decimal(12,0)"))
    before = files(tmp_path / "orders")
    touched = t.merge(new, ["o_orderstatus"])
    after = files(tmp_path / "orders")
    assert 0 < len(touched) <= len(keys) + 1 < 128
    name = {f"_bucket={b}/" for b in touched}
    inside = lambda f: any(f.startswith(n) for n in name)
    assert {f for f in before if not inside(f)} == {f for f in after if not inside(f)}
    assert not {f for f in before if inside(f)} & after  # the old versions of touched buckets are gone
    scan = t.read(spark, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in scan or "_bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows(t.read(spark)) == rows(merge.merge(orders, new.withColumn("o_orderkey", F.col("o_orderkey").cast("long")), ["o_orderkey"], ["o_orderstatus"]))
    assert t.merge(new.limit(0), ["o_orderstatus"]) == [] and files(tmp_path / "orders") == after


def test_a_merge_that_was_interrupted_is_run_again(spark, tmp_path, monkeypatch):
    old = spark.range(200).select("id", F.lit("old").alias("v"))
    new = spark.range(100, 300).select("id", F.lit("new").alias("v"))
    t = Buckets(f"{tmp_path}/t", ("id",), 8)
    t.create(old)
    some = [b for b in t.touched(new) if b % 2]
    half = merge.merge(t.read(spark, some), new.where(t._bucket().isin(some)), ["id"], ["v"]).withColumn("_bucket", t._bucket())
    half.localCheckpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(t.path)  # as if it had stopped here
    t.merge(new, ["v"])
    assert rows(t.read(spark)) == rows(merge.merge(old, new, ["id"], ["v"]))


def test_rejections_are_replaced_for_each_document(spark, tmp_path):
    """What a document's rejections were goes when it is matched again, even if it has none any more."""
    docs = spark.createDataFrame([(1, "a token here", None), (2, "another token", None), (None, "token", None)], "id long, body string, title string")
    one = Rules(ambiguous=(Ambiguous("secret", r"\btoken\b", 60, (r"=",)),))
    t = Buckets(f"{tmp_path}/rejections", ("document_id",), 8)
    t.create(mentions.rejection_rows(mentions.with_mentions(docs, one)))
    assert t.read(spark).count() == 3
    again = spark.createDataFrame([(2, "token = x", None), (None, "token token", None)], "id long, body string, title string")
    t.replace(mentions.rejection_rows(mentions.with_mentions(again, one)), again.select(F.col("id").alias("document_id")))
    assert sorted(str(r["document_id"]) for r in t.read(spark).collect()) == ["1", "None", "None"]
    t.replace(t.read(spark).limit(0), spark.createDataFrame([(1,)], "document_id int"))
    assert {r["document_id"] for r in t.read(spark).collect()} == {None}


# --- replayed source -------------------------------------------------------------------


def line(i):
    return json.dumps({"source": "reddit", "kind": "comment", "external_id": i, "fetched_at": "2024-01-01T00:00:00Z", "query": "q", "raw": {"body": "é" * (i % 50)}})


def test_replay_goes_on_without_loss_or_repeat(spark, tmp_path):
    spark.dataSource.register(Envelopes)
    at = tmp_path / "in"
    at.mkdir()
    go = lambda: spark.readStream.format("envelopes").options(path=str(at), split="700").load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = lambda: sorted(int(r[0]) for r in spark.read.parquet(f"{tmp_path}/out").where("error is null").select("external_id").collect())
    (at / "a.jsonl").write_text("".join(line(i) + "\n" for i in range(100)) + line(100)[:20])
    (at / "_hidden.jsonl").write_text(line(999) + "\n")
    go()
    assert got() == list(range(100))  # the unfinished line waits
    with (at / "a.jsonl").open("a") as f:
        f.write(line(100)[20:] + "\n\nnot json\n")
    (at / "b.jsonl").write_text("".join(line(i) + "\n" for i in range(101, 180)))
    go()
    go()
    assert got() == list(range(180))
    assert spark.read.parquet(f"{tmp_path}/out").where("error is not null").count() == 1


def test_replay_reads_again_what_a_failed_batch_has_read(spark, tmp_path):
    spark.dataSource.register(Envelopes)
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.jsonl").write_text("".join(line(i) + "\n" for i in range(50)))
    stream = spark.readStream.format("envelopes").option("path", str(at)).load()
    seen = []

    def fails(batch, n):
        seen.append(sorted(int(r["external_id"]) for r in batch.collect()))
        if len(seen) == 1:
            raise RuntimeError("lost")

    run = lambda: stream.writeStream.foreachBatch(fails).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    (at / "b.jsonl").write_text(line(50) + "\n")
    run()
    run()
    assert seen[0] == seen[1] == list(range(50)) and seen[2:] == [[50]]


@pytest.mark.parametrize("split", [1, 7, 100, 10**6])
def test_ranges_share_the_lines(tmp_path, split):
    lines = [line(i) for i in range(40)]
    (tmp_path / "x.json").write_text("\n".join(lines) + "\n")
    r = Replay({"path": str(tmp_path), "split": str(split)})
    end = r.latestOffset()
    assert end == {"x.json": (tmp_path / "x.json").stat().st_size}
    assert [int(x[2]) for p in r.partitions({}, end) for x in r.read(p)] == list(range(40))
    assert r.partitions(end, end) == [] and Replay({"path": str(tmp_path / "none")}).latestOffset() == {}


# --- table function --------------------------------------------------------------------


def test_table_function_equals_mention_rows(spark):
    docs = table(spark, DATA, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.substring("text", 1, 30).alias("title"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None), (-2, "", "the"), (-3, "the token = the", None)], docs.schema))
    mentions.register_mentions(spark, RULES, "found")
    got = spark.sql("SELECT d.id, m.* FROM {docs} d, LATERAL found(d.body, d.title) m", docs=docs)
    assert rows(got) == rows(mentions.mention_rows(mentions.with_mentions(docs, RULES)))
    one = spark.sql("SELECT m.entity, m.mention_count FROM {docs} d, LATERAL found(d.body) m WHERE d.id = -3", docs=docs)
    assert ("english", 2) in rows(one)
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM {docs} d, LATERAL found(d.id)", docs=docs).collect()
