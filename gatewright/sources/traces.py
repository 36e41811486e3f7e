"""A data source for call traces, format `calltrace`.

A trace is a folder of text files, a call a line: `<unix ms> <session> <tool> <call> <args as JSON>`,
with `-` for a missing session or tool. Files are named `<day>[-<part>].trace`, and a file
is a partition. Filters on `day`, by equality or bounds, are taken by the source: files of other days
are not opened. As a stream, new files are read in the order of their names, and the
offset is the last name, so a restarted query neither repeats nor loses any; a file must
sort behind those that came before it. Lines that do not parse have nulls and their text in `corrupt`.

The files must be on a path that driver and workers share.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "day date, call_id long, session_id long, ts timestamp, tool_id string, args_json string, corrupt string"
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class TraceFile(NamedTuple):
    name: str
    day: datetime.date


class _Partition(InputPartition):
    def __init__(self, path: str, file: TraceFile):
        super().__init__(file.name)
        self.path, self.file = path, file


def files_of(path: str) -> list[TraceFile]:
    """The trace files of a folder, by name; others are passed over."""
    out = []
    for name in sorted(os.listdir(path)):
        try:
            if name.endswith(".trace"):
                out.append(TraceFile(name, datetime.date.fromisoformat(name[:10])))
        except ValueError:
            continue
    return out


def parse(line: str) -> tuple:
    """(call_id, session_id, ts, tool_id, args_json, corrupt) of a line."""
    parts = line.split(" ", 4)
    try:
        at, session, tool, call, args = parts
        json.loads(args)
        ts = datetime.datetime.fromtimestamp(int(at) / 1000, datetime.timezone.utc)
        return int(call), None if session == "-" else int(session), ts, None if tool == "-" else tool, args, None
    except ValueError:
        return None, None, None, None, None, line


def _read(partition: _Partition) -> Iterator[tuple]:
    with open(os.path.join(partition.path, partition.file.name), encoding="utf-8", errors="replace") as file:
        for line in file:
            if line := line.rstrip("\n"):
                yield (partition.file.day, *parse(line))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.days = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _TESTS.get(type(f))
            if test is not None and f.attribute == ("day",) and f.value is not None:
                self.days.append((test, f.value))
            else:
                yield f

    def partitions(self) -> list[_Partition]:
        return [_Partition(self.path, f) for f in files_of(self.path) if all(test(f.day, value) for test, value in self.days)]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        # a folder without files of these days is one empty partition
        return _read(partition) if isinstance(partition, _Partition) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = files_of(self.path)
        return {"after": files[-1].name if files else ""}

    def partitions(self, start: dict, end: dict) -> list[_Partition]:
        return [_Partition(self.path, f) for f in files_of(self.path) if start["after"] < f.name <= end["after"]]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        return _read(partition) if isinstance(partition, _Partition) else iter(())

    def commit(self, end: dict) -> None:
        pass


class CallTrace(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calltrace"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._path())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self._path())


def register(spark: SparkSession) -> None:
    """Make `spark.read.format("calltrace")` and `readStream` known, with filters pushed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CallTrace)
