"""Where short texts occur in long ones, word for word or not, whatever their length.

Items are classed by the largest power of two of bytes that they have, and stand for by the hash of
that many of their first bytes. The hash of every stretch of a class's length in a document rolls up
from that of half of it, over whole Arrow batches: stretches whose hash is an item's become rows,
once for each document and hash, and are joined to the items. What is joined is verified on the
texts themselves, so that a hash decides only what is compared. Hashes of ``SENT`` items go to the
tasks; with more of them every stretch of their classes is joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import collapsed
from weftwork.session import materialize, spread

#: Bytes of the longest class; hashes of items that are sent to the tasks, at most; bytes of text that are hashed at once, but for longer texts.
LONGEST, SENT, AT_ONCE = 32, 1_000_000, 1 << 20

_BYTE = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _rolled(data: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the stretch of that length from each byte on), for powers of two."""
    h, n, base = _BYTE[data], 1, _BASE
    while n <= longest and len(h):
        yield n, h
        h = h[:-n] * np.uint64(base) + h[n:]
        n, base = 2 * n, base * base % 2**64


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of some rows."""
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(offs, offs[at] + AT_ONCE, "right")) - 1))
        yield at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, text)`` of items -> ``(id, class, hash)``."""
    for b in batches:
        for first, data, offs in _slices(b.column(1)):
            size = np.diff(offs)
            for n, h in _rolled(data):
                mine = np.flatnonzero((size >= n) & ((size < 2 * n) | (n == LONGEST)))
                if len(mine):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + mine)), pa.array(np.full(len(mine), n, np.int32)), pa.array(h[offs[mine]].view(np.int64))], ["id", "class", "hash"])


def _stretches(known: dict[int, np.ndarray] | None, classes: set[int]) -> Callable:
    """``(id, text)`` of documents -> ``(id, class, hash)``, distinct in a document, of hashes that are ``known`` or of all."""

    def run(batches):
        for b in batches:
            for first, data, offs in _slices(b.column(1)):
                row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                for n, h in _rolled(data, max(classes)):
                    if n not in classes:
                        continue
                    at = np.flatnonzero(row[: len(h)] == row[n - 1 :])
                    if known is not None:
                        sorted_ = known[n]
                        k = np.searchsorted(sorted_, h[at])
                        at = at[sorted_[np.minimum(k, len(sorted_) - 1)] == h[at]]
                    if len(at):
                        order = np.lexsort((h[at], row[at]))
                        at = at[order]
                        new = np.r_[True, (h[at][1:] != h[at][:-1]) | (row[at][1:] != row[at][:-1])]
                        at = at[new]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + row[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(h[at].view(np.int64))], ["id", "class", "hash"])

    return run


def contained(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", item: str = "text") -> DataFrame:
    """``(doc_id, item_id, text, item)`` of all pairs of which the one text is in the other, white space collapsed in both.

    It may begin or end inside of a word. Null texts, and items of white space only, are in no pair. Rows of one id are rows of
    their own; a null id is one like any other. Extra columns don't matter.
    """
    d = docs.select(F.col(doc_id).alias("d_id"), collapsed(F.col(text)).alias("d")).where("d is not null")
    i = materialize(items.select(F.monotonically_increasing_id().alias("n"), F.col(item_id).alias("i_id"), collapsed(F.col(item)).alias("i")).where("i <> ''"), "span-items")
    keys = materialize(i.select("n", "i").mapInArrow(_anchors, "id long, class int, hash long"), "span-anchors")
    d = materialize(spread(d).withColumn("m", F.monotonically_increasing_id()), "span-documents")
    classes = {r[0] for r in keys.select("class").distinct().collect()}
    if not classes:
        return d.select(F.col("d_id").alias(doc_id), F.lit(None).cast(i.schema["i_id"].dataType).alias(item_id), F.col("d").alias(text), F.lit("").alias("item")).limit(0)
    distinct = keys.select("class", "hash").distinct()
    known = None
    if distinct.count() <= SENT:
        rows = distinct.toPandas()
        known = {n: np.sort(g.to_numpy(np.int64).view(np.uint64)) for n, g in rows.groupby("class")["hash"]}
    hits = d.select("m", "d").mapInArrow(_stretches(known, classes), "id long, class int, hash long")
    pairs = hits.join(keys.withColumnRenamed("id", "n"), ["class", "hash"]).select(F.col("id").alias("m"), "n").distinct()
    both = pairs.join(i, "n").join(d, "m").where(F.contains("d", "i"))
    return both.select(F.col("d_id").alias(doc_id), F.col("i_id").alias(item_id), F.col("d").alias(text), F.col("i").alias("item"))

