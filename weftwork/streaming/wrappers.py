"""Structured Streaming forms of batch operators: the batch result is the standard.

Each works on micro-batches with a checkpoint, so a stream that is started again goes on where it
was and repeats nothing that is committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftwork.functions.rules import Rules
from weftwork.functions.text import content_hash
from weftwork.operators.mentions import with_mentions
from weftwork.operators.merge import latest, merge


def unique_documents(docs: DataFrame, at: str = "fetched_at", delay: str = "30 days", text: str = "body") -> DataFrame:
    """Documents whose content wasn't seen within ``delay`` of event time; state beyond it is dropped."""
    d = docs.withColumn("content_hash", content_hash(F.col(text))).withWatermark(at, delay)
    return d.dropDuplicatesWithinWatermark(["content_hash"])


def event_counts(events: DataFrame, by: list[str], at: str = "ts", window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events of each group and tumbling window; a window is final when the watermark passes its end."""
    w = events.withWatermark(at, delay).groupBy(F.window(at, window), *by).agg(F.count("*").alias("new"))
    return w.select(*by, F.col("window.start").alias("period_start"), "new")


def mentioned(docs: DataFrame, rules: Rules, id_col: str = "id", body: str = "body") -> DataFrame:
    """A row for each mention; stateless."""
    found = with_mentions(docs, rules, body, None)
    return found.select(F.col(id_col).alias("document_id"), F.explode("mentions").alias("m")).select("document_id", "m.*")


def month_counts(events: DataFrame, by: list[str], at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events of each group and calendar month, in update mode: a month's row comes again when its count grows."""
    m = events.withWatermark(at, delay).groupBy(*by, F.to_date(F.date_trunc("month", at)).alias("period_start"))
    return m.agg(F.count("*").alias("new"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a snapshot, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last finished version."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")


def merged(path: str, keys: list[str], update: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """For ``in_batches``: batch n merges its rows, of each key the last by ``order``, into version n of a snapshot.

    A batch that is run again starts from the version before it and writes its own anew, so nothing counts twice.
    """

    def process(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < n]
        new = latest(batch, keys, order)
        out = merge(spark.read.parquet(f"{path}/v{before[-1]}"), new, keys, update) if before else new
        out.write.mode("overwrite").parquet(f"{path}/v{n}")

    return process


def latest_by_key(path: str, keys: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """For ``in_batches``: the last row of each key by ``order`` so far; an older row that comes late changes nothing."""

    def process(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < n]
        rows = spark.read.parquet(f"{path}/v{before[-1]}").unionByName(batch) if before else batch
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v{n}")

    return process


def in_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``process(batch, number)`` over all that is there, batch by batch; it must bear a repeated batch."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
