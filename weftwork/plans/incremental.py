"""Queries of what is kept up to date: keyed state, merges by buckets, a replayed source, and a table function."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftwork.functions.rules import Rules
from weftwork.operators import mentions
from weftwork.operators.buckets import Buckets
from weftwork.plans.queries import ORACLES, RULES, _envelopes, _snapshots, _t, query
from weftwork.session import shared_dir
from weftwork.sources import raw
from weftwork.sources.replay import Envelopes
from weftwork.streaming.latest import refresh


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT user_id, event_id, epoch_us(ts) AS at, event_type, CAST(value AS DOUBLE) AS value FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def refreshed_events(spark, d):
    """The last event of each user, as a stream of all events leaves it."""
    events = _t(spark, d, "events")
    at = _place(spark, "refresh")
    # As a pattern, as a stream takes a plain path for a folder.
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    table = Buckets(f"{at}/table", ("user_id",), 64)
    refresh(stream, table, ["ts", "event_id"], f"{at}/checkpoint").awaitTermination()
    return table.read(spark).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", F.col("value").cast("double").alias("value"))


@query(ORACLES["keyed_merge"])
def bucket_merge(spark, d):
    """``keyed_merge`` into a table of buckets, in three batches."""
    old, new = _snapshots(spark, d)
    table = Buckets(_place(spark, "orders"), ("o_orderkey",), 64)
    table.create(old)
    for n in range(3):
        table.merge(new.where(F.col("o_orderkey") % 3 == n), ["o_orderstatus", "o_totalprice"], [F.col("o_totalprice")])
    return table.read(spark)


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem WHERE l_orderkey % 50 <> 0
 UNION ALL SELECT l_orderkey, -l_linenumber, CAST(l_quantity AS DOUBLE) + 1 FROM lineitem WHERE l_orderkey % 50 = 0 AND l_linenumber <= 2 AND l_orderkey % 100 <> 0""")
def bucket_children(spark, d):
    """Lines of every fiftieth order are replaced by new ones; every hundredth has none any more."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    table = Buckets(_place(spark, "lines"), ("l_orderkey",), 64)
    table.create(lines)
    some = lines.where("l_orderkey % 50 = 0")
    new = some.where("l_linenumber <= 2 and l_orderkey % 100 <> 0").select("l_orderkey", (-F.col("l_linenumber")).alias("l_linenumber"), (F.col("l_quantity") + 1).alias("l_quantity"))
    table.replace(new, some.select("l_orderkey"))
    return table.read(spark)


@query(ORACLES["ingested_documents"])
def replayed_documents(spark, d):
    """``ingested_documents`` from recorded lines, replayed as a stream."""
    at = _place(spark, "replay")
    items = _envelopes(spark, d)
    items.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.json(f"{at}/lines")
    spark.dataSource.register(Envelopes)
    stream = spark.readStream.format("envelopes").options(path=f"{at}/lines", split=1 << 20).load().where("error is null")
    docs = raw.to_documents(stream.withColumn("fetched_at", F.to_timestamp("fetched_at")), "salt")
    docs.writeStream.format("parquet").option("path", f"{at}/documents").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    docs = spark.read.schema(docs.schema).parquet(f"{at}/documents")
    return docs.select("external_id", "url", "score", F.length("body").alias("chars"), F.unix_timestamp("posted_at").alias("posted"))


@query(ORACLES["alias_counts"])
def mentions_in_sql(spark, d):
    """``alias_counts`` by the table function, called from SQL."""
    some = Rules(aliases={e: RULES.aliases[e] for e in ("english", "french", "rights", "spanish")})
    mentions.register_mentions(spark, some, "weftwork_mentions")
    docs = _t(spark, d, "documents").where(mentions.maybe(F.col("text"), some))
    return spark.sql("SELECT d.doc_id AS document_id, m.entity, m.mention_count FROM {docs} d, LATERAL weftwork_mentions(d.text) m", docs=docs)
