"""Token-id files: whole texts encoded, packed by the range coder, and read back.

A store is a folder of parquet files. Its rows are segments in ascending order of ``(part, seq)``:
the doc_ids of a segment in ascending order, null first, the number of ids of each, and the packed
ids. A document never spans segments, and a segment's blocks are checksummed one by one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm import range_coder
from weftwork.llm.textbatch import chunks, relieve
from weftwork.llm.tokens import load
from weftwork.session import shared_dir

#: A segment is closed at so many ids; a longer document has one of its own. The blocks of one are coded in step, which pays if they are many.
SEGMENT_IDS = 8_000_000
_SCHEMA = "part int, seq int, doc_ids array<long>, counts array<long>, n_ids long, packed binary"


def _pack(path: str, end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = load(path), TaskContext.get().partitionId()
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size, seq = 0, 0

        def close() -> pa.RecordBatch:
            n, whole = np.concatenate(counts), np.concatenate(held)
            held.clear()
            packed = range_coder.encode(whole, block)
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_ids", "counts", "n_ids", "packed"])

        for batch in batches:
            for some in chunks(batch):
                names = some.column("doc_id").to_pylist()
                found, n = encoder.encode_array(some.column("text"))
                ends = np.cumsum(n)
                found, n = np.insert(found, ends, end_id), n + 1
                ends = np.cumsum(n)
                a = 0
                while a < len(n):
                    # Up to the document that fills the segment.
                    before = int(ends[a - 1]) if a else 0
                    b = min(int(np.searchsorted(ends, before + SEGMENT_IDS - size)) + 1, len(n))
                    ids += names[a:b]
                    counts.append(n[a:b])
                    held.append(found[before : ends[b - 1]])
                    size += int(ends[b - 1]) - before
                    a = b
                    if size >= SEGMENT_IDS:
                        yield close()
                        ids, counts, held, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()
        encoder.rest()

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, block: int = range_coder.BLOCK) -> str:
    """Encode ``docs(doc_id, text, ...)`` into a store and return its path.

    Every whole text is encoded without special tokens and ends with ``end_id``; a null text is
    empty. Documents are dealt out by ranges of doc_id and sorted within; rows with one doc_id stay
    together, in no order that is known if their texts differ. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    d.mapInArrow(_pack(tokenizer, end_id, block), _SCHEMA).write.parquet(path)
    return path


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store, with ``start``: the ids in all segments before."""
    s = spark.read.schema(_SCHEMA).parquet(path)
    sums = s.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = s.select("part", "seq", "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = inside.join(sums, "part").select("part", "seq", (F.col("ahead") + F.col("in_part")).alias("start"))
    return s.join(starts, ["part", "seq"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    relieve()
    for batch in batches:
        for i in range(batch.num_rows):
            ids = range_coder.decode(batch.column("packed")[i].as_py()).astype("<u4", copy=False)
            counts = np.array(batch.column("counts")[i].as_py(), np.int64)
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            start = batch.column("start")[i].as_py() + ends - counts
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(start), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Decode a store: ``(doc_id, start, n_tokens, ids_crc32)`` of each document."""
    s = segments(spark, path).select("doc_ids", "counts", "packed", "start")
    return s.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    relieve()
    for batch in batches:
        for i in range(batch.num_rows):
            ids = range_coder.decode(batch.column("packed")[i].as_py()).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(batch.column("counts")[i].as_py())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode a store: ``(doc_id, ids)``, each document's ids with the end id."""
    return spark.read.schema(_SCHEMA).parquet(path).select("doc_ids", "counts", "packed").mapInArrow(_unpack, "doc_id long, ids array<long>")
