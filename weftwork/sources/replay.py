"""A streaming source over recorded envelopes: folders of JSON lines that grow, by lines or by files.

An offset says how many bytes of each file have been read. A micro-batch is the whole lines between
two offsets, cut into ranges of ``split`` bytes, so that a large file is read by many tasks. Spark
keeps the offsets in the checkpoint: a stream that was stopped, or has failed, goes on where it was,
without loss or repeat. A line that isn't an envelope is a row with ``error`` set.
"""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weftwork.sources.recorded import SCHEMA

_TAIL = 1 << 16
# The process that plans a source on the driver doesn't get this package: the source goes there whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _files(path: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int) -> None:
        self.name, self.start, self.end = name, start, end


class Replay(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", 32 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The whole lines of each file; a file without any has none yet."""
        from pyarrow import fs

        system, at = _files(self.path)
        found = {}
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.is_file and f.base_name.endswith((".jsonl", ".json")) and not f.base_name.startswith(("_", ".")):
                end = self._whole(system, f)
                if end:
                    found[f.base_name] = end
        return dict(sorted(found.items()))

    @staticmethod
    def _whole(system, f) -> int:
        with system.open_input_file(f.path) as file:
            to = f.size
            while to > 0:
                at = max(0, to - _TAIL)
                file.seek(at)
                newline = file.read(to - at).rfind(b"\n")
                if newline >= 0:
                    return at + newline + 1
                to = at
        return 0

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for name, to in end.items():
            at = start.get(name, 0)
            out += [_Range(name, a, min(to, a + self.split)) for a in range(at, to, self.split)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        """The lines that begin in a range."""
        system, at = _files(self.path)
        with io.BufferedReader(system.open_input_file(f"{at}/{partition.name}")) as f:
            # A range begins behind a line feed, or in the middle of a line that the range before has.
            place = max(0, partition.start - 1)
            f.seek(place)
            if partition.start:
                place += len(f.readline())
            while place < partition.end:
                line = f.readline()
                if not line:
                    return
                place += len(line)
                if line.strip():
                    yield self._row(partition.name, line)

    @staticmethod
    def _row(name: str, line: bytes) -> tuple:
        try:
            x = json.loads(line)
            raw = x["raw"]
            return (x["source"], x["kind"], str(x["external_id"]), x["fetched_at"], x.get("query"), raw if isinstance(raw, str) else json.dumps(raw), None)
        except (ValueError, KeyError, TypeError) as e:
            return (None, None, None, None, name, None, f"{type(e).__name__}: {e}")

    def commit(self, end: dict) -> None:
        pass


class Envelopes(DataSource):
    """``spark.readStream.format("envelopes").options(path=..., split=bytes of a task)``; register with ``spark.dataSource.register(Envelopes)``."""

    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Replay:
        return Replay(self.options)
