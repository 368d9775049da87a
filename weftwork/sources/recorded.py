"""A Spark data source over recorded query results: a partition for each query, failures kept apart.

An adapter is a function ``(query, since, limit) -> list of envelopes``. Here it reads recordings, as
there is no network; a live one has the same form. A query that fails yields a row with ``error``
set, and the others go on.
"""

from __future__ import annotations

import io
import json
import random
import time
from collections.abc import Callable, Iterator
from typing import TextIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source string, kind string, external_id string, fetched_at string, query string, raw string, error string"


def with_retries(call: Callable[[], object], tries: int = 6, base: float = 2.0, cap: float = 300.0, sleep: Callable[[float], None] = time.sleep):
    """Try again after a random part of a doubling wait, or after the time that an error names as ``retry_after``."""
    for n in range(tries):
        try:
            return call()
        except OSError as e:
            if n + 1 == tries:
                raise
            named = getattr(e, "retry_after", None)
            sleep(named if named is not None else random.uniform(0, min(cap, base * 2**n)))
    raise RuntimeError("no tries")


def open_text(path: str) -> TextIO:
    """A text file by a local path, or by an address that Arrow's file systems know."""
    if "://" not in path:
        return open(path, encoding="utf-8")
    from pyarrow import fs

    found, at = fs.FileSystem.from_uri(path)
    return io.TextIOWrapper(found.open_input_stream(at), encoding="utf-8")


class _Query(InputPartition):
    def __init__(self, query: str, path: str) -> None:
        self.query, self.path = query, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.since, self.limit = options["path"], options.get("since", ""), int(options.get("limit", 0))
        self.queries = json.loads(options["queries"])

    def partitions(self) -> list[_Query]:
        return [_Query(q, f"{self.path}/{i}.jsonl") for i, q in enumerate(self.queries)]

    def read(self, partition: _Query) -> Iterator[tuple]:
        seen: set[str] = set()
        try:
            with open_text(partition.path) as f:
                for line in f:
                    if not line.strip():
                        continue
                    x = json.loads(line)
                    if x["fetched_at"] < self.since or x["external_id"] in seen:
                        continue
                    seen.add(x["external_id"])
                    yield (x["source"], x["kind"], x["external_id"], x["fetched_at"], partition.query, json.dumps(x["raw"]), None)
                    if self.limit and len(seen) >= self.limit:
                        return
        except (OSError, ValueError, KeyError) as e:
            yield (None, None, None, None, partition.query, None, f"{type(e).__name__}: {e}")


class Recorded(DataSource):
    """``spark.read.format("recorded").options(path=..., queries=json list, since=..., limit=...)``; file i holds query i."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
