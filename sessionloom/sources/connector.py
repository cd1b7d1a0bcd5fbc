"""Session logs as one data source: ``spark.read.format("session_log")`` and, following files that grow, ``readStream``.

Options: path (several are split at commas), glob (``*.jsonl``), splitBytes (64 MB), counts (a range is one row, k its lines),
tasks (how many there should be, as far as there are ranges; 64).
Columns are those of the schema asked for, of COLUMNS, so a reader that wants no stamps parses nothing. Files are read by
byte ranges: a line belongs to the range in which it begins, so a file of any size is read by many tasks and a task holds
a line at a time. Small ranges are packed: a task takes ranges in turn, of TASK_BYTES at most with OPEN_BYTES for each, but no
more than leave every core some tasks (tasks), so a store of many small files does not cost a task a file. ``at`` is the line's first byte, ``k`` its place among its range's lines, dropped ones included, by which
``numbered`` turns places into line numbers with one row a range.

Pushed filters: bounds on stamp_ms (lines at or below a floor never leave the reader), and source_file, which leaves other
files unopened. A stamp is ISO 8601 under ``timestamp``; a line without one has a null stamp. Bytes that are no UTF-8 are replaced; blank lines go.
A missing path has no lines. Places are read through Arrow's file systems, so a folder on HDFS or an object store works too.

A stream's offset is the bytes read of each file up to its last whole line: what is appended later is read then, and a line
that is still being written waits for its end. A file that became shorter was written anew and is read from its start.
The offset follows from the files alone, so a restart needs nothing else; it takes some 100 bytes a file.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from . import stores

COLUMNS = "source_file string, block bigint, at bigint, k bigint, stamp_ms bigint, value string"
SPLIT_BYTES, BATCH_BYTES, BUFFER = 64 << 20, 4 << 20, 1 << 20
TASK_BYTES, OPEN_BYTES, TASKS = 64 << 20, 1 << 16, 64


def stamp_of(line: bytes) -> int | None:
    """Milliseconds of an object's ``timestamp``; a stamp without a zone is UTC."""
    try:
        found = json.loads(line)
        at = datetime.fromisoformat(found["timestamp"].strip())
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // (datetime.resolution * 1000)


class Files:
    """The files of the options' paths and what is read of them."""

    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.glob = options.get("glob", "*.jsonl")
        self.split = max(1, int(options.get("splitbytes", SPLIT_BYTES)))
        self.tasks = max(1, int(options.get("tasks", TASKS)))
        self.counts = str(options.get("counts", "false")).lower() == "true"

    @staticmethod
    def place(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def sizes(self) -> dict[str, int]:
        """Bytes of every file, hidden ones left out, under the name by which it is opened again."""
        found = {}
        for path in self.paths:
            system, inner = self.place(path)
            head = path[: len(path) - len(inner)] if path.endswith(inner) else f"{system.type_name}://"
            top = system.get_file_info(inner)
            listed = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
            found |= {head + f.path: f.size for f in listed if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob) and not f.base_name.startswith((".", "_"))}
        return found

    def ranges(self, spans: dict[str, tuple[int, int]]) -> list[InputPartition]:
        """Byte ranges of spans of files, packed into tasks in the order of their files; a task's value is the name, start and
        stop of one range after the other."""
        found = [(name, k, min(k + self.split, stop)) for name, (start, stop) in sorted(spans.items()) for k in range(start, stop, self.split)]
        most = min(TASK_BYTES, sum(stop - start + OPEN_BYTES for _, start, stop in found) / self.tasks)
        packs, size = [], 0
        for name, start, stop in found:
            cost = stop - start + OPEN_BYTES
            if not packs or size + cost > most:
                packs.append([])
                size = 0
            packs[-1].extend((name, start, stop))
            size += cost
        return [InputPartition(tuple(pack)) for pack in packs]

    def whole(self, name: str, size: int) -> int:
        """The end of the last whole line within ``size`` bytes, looked for from the end; 0 without one."""
        system, inner = self.place(name)
        with system.open_input_file(inner) as file:
            stop = size
            while stop > 0:
                start = max(0, stop - BUFFER)
                file.seek(start)
                cut = file.read(stop - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                stop = start
        return 0

    def begun(self, name: str, start: int, stop: int) -> int:
        """How many lines begin in a range: one after each end of line before its last byte."""
        system, inner = self.place(name)
        with system.open_input_file(inner) as file:
            at, found = max(0, start - 1), int(start == 0)
            file.seek(at)
            while at < stop - 1 and (part := file.read(min(BUFFER, stop - 1 - at))):
                found += part.count(b"\n")
                at += len(part)
        return found

    def lines(self, name: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """First byte and bytes of each line that begins in a range."""
        system, inner = self.place(name)
        with system.open_input_file(inner) as raw:
            raw.seek(max(0, start - 1))
            file, at = io.BufferedReader(raw, BUFFER), max(0, start - 1)
            if start:
                at += len(file.readline())
            while at < stop and (line := file.readline()):
                yield at, line
                at += len(line)


def batches(files: Files, schema: T.StructType, partition: InputPartition | None, floor: int | None) -> Iterator[pa.RecordBatch]:
    """The lines of a task's ranges as batches of some megabytes. Without any range Spark asks once for none."""
    if partition is None:
        return
    wanted = [f.name for f in schema.fields]
    kinds = {"source_file": pa.string(), "value": pa.string()}
    stamps = floor is not None or "stamp_ms" in wanted
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = dict(zip(("source_file", "block", "at", "k", "stamp_ms", "value"), zip(*held, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) for c in wanted], names=wanted)

    for name, start, stop in itertools.batched(partition.value, 3):
        if files.counts:
            held.append((name, start, start, files.begun(name, start, stop), None, None))
            continue
        for k, (at, line) in enumerate(files.lines(name, start, stop)):
            stamp = stamp_of(line) if stamps else None
            text = line.removesuffix(b"\n").removesuffix(b"\r")
            if not text.strip() or floor is not None and (stamp is None or stamp <= floor):
                continue
            held.append((name, start, at, k, stamp, text.decode("utf-8", "replace")))
            size += len(line)
            if size >= BATCH_BYTES:
                yield batch()
                held.clear()
                size = 0
    if held:
        yield batch()


class LogReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.files, self.schema, self.floor, self.names = Files(options), schema, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("stamp_ms",):
                bound = f.value - isinstance(f, GreaterThanOrEqual)
                self.floor = bound if self.floor is None else max(self.floor, bound)
            elif isinstance(f, EqualTo | In) and f.attribute == ("source_file",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.files.ranges({n: (0, size) for n, size in self.files.sizes().items() if self.names is None or n in self.names})

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return batches(self.files, self.schema, partition, self.floor)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.files, self.schema = Files(options), schema
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The whole lines' end of each file; files whose size has not changed are not opened for it."""
        sizes = self.files.sizes()
        self.seen = {n: self.seen[n] if self.seen.get(n, (None,))[0] == size else (size, self.files.whole(n, size)) for n, size in sizes.items()}
        return {n: stop for n, (_, stop) in self.seen.items() if stop}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin = {n: start.get(n, 0) if start.get(n, 0) <= stop else 0 for n, stop in end.items()}
        return self.files.ranges({n: (begin[n], stop) for n, stop in end.items() if begin[n] < stop})

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return batches(self.files, self.schema, partition, None)

    def commit(self, end: dict) -> None:
        """Files are the store's own; nothing is dropped."""


class SessionLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LogReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return LogStream(self.options, schema)


def log(spark: SparkSession, path: str, columns: str = COLUMNS, stream: bool = False, **options: object) -> DataFrame:
    """The lines of session logs, with the columns asked for."""
    spark.dataSource.register(SessionLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    return (spark.readStream if stream else spark.read).format("session_log").schema(columns).options(**{"path": path, "tasks": 4 * spark.sparkContext.defaultParallelism} | options).load()


def numbered(spark: SparkSession, path: str, floor_ms: int | None = None, **options: object) -> DataFrame:
    """source_file, line (from 1) and value of lines above a floor, in their files' own numbers.

    Numbers come from one row a range, counted by a pass that parses nothing; lines are not shuffled for them.
    """
    rows = log(spark, path, "source_file string, block bigint, k bigint, value string" + (", stamp_ms bigint" if floor_ms is not None else ""), **options)
    rows = rows if floor_ms is None else rows.where(F.col("stamp_ms") > floor_ms)
    ends = log(spark, path, "source_file string, block bigint, k bigint", counts=True, **options).withColumnRenamed("k", "n")
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = ends.select("source_file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("begin"))
    return rows.join(begin, ["source_file", "block"]).select("source_file", (F.col("k") + F.col("begin")).alias("line"), "value")


def records(spark: SparkSession, source_id: str, path: str, floor_ms: int = 0, known_paths: list[str] = (), **options: object) -> DataFrame:
    """Records of a JSON-lines source above a floor; lines at or below it never leave the reader."""
    more = {"known_paths": known_paths} if source_id != "codex" else {}
    return stores.READERS[source_id](spark, numbered(spark, path, floor_ms, **options), floor_ms, **more)
