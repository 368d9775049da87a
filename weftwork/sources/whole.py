"""A sink that replaces a file or a folder as a whole, or leaves the old one as it was.

Tasks write beside the target. Once all have succeeded the driver puts what they wrote in its place:
a single part as a file, by one rename; several parts as a folder, which is moved in when the old one
has been moved aside, and the old one is deleted last. If a task or the commit fails, what was
written is deleted and the old result stays, or comes back. Repeated attempts of a task write files of their own, of
which one counts.
"""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row


# The process that commits on the driver doesn't get this package: the sink goes there whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class Whole(DataSource):
    """``df.write.format("whole").options(path=..., kind="json" or "csv").mode("overwrite").save()``; register with ``spark.dataSource.register(Whole)``.

    JSON is an object a line, with nulls; CSV has a header in each part, and quotes where they are needed. ``one_file`` asks for
    a single file, which the data must come in one partition for.
    """

    @classmethod
    def name(cls) -> str:
        return "whole"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.fieldNames(), overwrite)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        self.path, self.kind = options["path"].rstrip("/"), options.get("kind", "json")
        self.one, self.columns, self.overwrite = options.get("one_file", "false") == "true", columns, overwrite
        if self.kind not in ("json", "csv"):
            raise ValueError(f"kind must be json or csv, not {self.kind}")
        self.beside = f"{self.path}.new-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        context = TaskContext.get()
        number = context.partitionId()
        system, at = _system(self.beside)
        system.create_dir(at, recursive=True)
        name = f"part-{number:05}-{context.taskAttemptId()}.{self.kind}"
        rows = 0
        with io.TextIOWrapper(system.open_output_stream(f"{at}/{name}"), encoding="utf-8", newline="") as f:
            table = csv.writer(f, lineterminator="\n")
            if self.kind == "csv":
                table.writerow(self.columns)
            for row in iterator:
                rows += 1
                if self.kind == "csv":
                    table.writerow(["" if v is None else v for v in row])
                else:
                    f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
        return Part(number, name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        system, at = _system(self.beside)
        target = _system(self.path)[1]
        try:
            if self.one and len(parts) > 1:
                raise ValueError(f"one file was asked for, but the data has {len(parts)} partitions")
            old = system.get_file_info(target)
            if old.type != fs.FileType.NotFound and not self.overwrite:
                raise FileExistsError(self.path)
            if self.one and parts:
                if old.type == fs.FileType.Directory:
                    system.delete_dir(target)
                system.move(f"{at}/{parts[0].path}", target)
                system.delete_dir(at)
                return
            system.create_dir(at, recursive=True)
            kept = {p.path for p in parts}
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.base_name not in kept:  # of an attempt that doesn't count
                    system.delete_file(f.path)
            aside = f"{at}-old"
            if old.type != fs.FileType.NotFound:
                system.move(target, aside)
            try:
                system.move(at, target)
            except OSError:
                if old.type != fs.FileType.NotFound:
                    system.move(aside, target)
                raise
            if old.type == fs.FileType.Directory:
                system.delete_dir(aside)
            elif old.type == fs.FileType.File:
                system.delete_file(aside)
        except BaseException:
            self._clear()
            raise

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, at = _system(self.beside)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)
