"""The latest row of each key, as keyed state: a late row changes nothing, a restart goes on from the state.

The state of a key is its latest row, in a state store that writes what changes to the checkpoint; it
goes ``ttl`` after the key's last change, if one is given. Each micro-batch passes on only keys whose
row has changed, which are merged into their buckets of a table: neither the state nor the table is
ever rewritten as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from weftwork.operators.buckets import Buckets

#: Of the query only. State that expires by the clock would ask for empty micro-batches without end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


# The process that prepares state on the driver doesn't get this package: the processor goes there whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rank(values: tuple) -> tuple:
    """Comparable as Spark orders values: null first, NaN last."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


class _Latest(StatefulProcessor):
    def __init__(self, schema: StructType, order: list[str], ttl: int | None) -> None:
        self.schema, self.order, self.ttl = schema, [schema.fieldNames().index(c) for c in order], ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.schema, self.ttl)

    def _place(self, row: tuple) -> tuple:
        return _rank(tuple(row[i] for i in self.order))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.row.get() if self.row.exists() else None
        best = known
        for r in rows:
            row = tuple(r[c] for c in self.schema.fieldNames())
            if best is None:
                best = row
                continue
            new, old = self._place(row), self._place(best)
            if new > old or new == old and repr(row) > repr(tuple(best)):
                best = row
        if best is not known:
            self.row.update(tuple(best))
            yield Row(**dict(zip(self.schema.fieldNames(), best, strict=True)))

    def close(self) -> None:
        pass


def latest_rows(stream: DataFrame, keys: list[str], order: list[str], ttl_seconds: int | None = None) -> DataFrame:
    """In update mode, the row of a key whenever another one becomes its last by ``order``, ascending.

    Of rows equal in ``order`` the one whose printed form is larger counts, so that the result doesn't depend on
    micro-batches. Null keys are a key, null orders come first. Needs the RocksDB state store.
    """
    ttl = None if ttl_seconds is None else 1000 * ttl_seconds
    return stream.groupBy(*keys).transformWithState(_Latest(stream.schema, order, ttl), stream.schema, "update", "None" if ttl is None else "ProcessingTime")


def refresh(stream: DataFrame, into: Buckets, order: list[str], checkpoint: str, ttl_seconds: int | None = None) -> StreamingQuery:
    """Keep ``into`` at the latest row of each of its keys, over all that is there. A repeated micro-batch merges the same rows again."""
    spark = stream.sparkSession
    columns = [c for c in stream.columns if c not in into.keys]

    def put(batch: DataFrame, n: int) -> None:
        if into.exists(batch.sparkSession):
            into.merge(batch, columns)
        else:
            into.create(batch)

    before = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        changed = latest_rows(stream, list(into.keys), order, ttl_seconds)
        return changed.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
