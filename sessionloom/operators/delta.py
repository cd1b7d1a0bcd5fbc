"""Tables that append: data parts that a numbered manifest names, merged on read, compacted by size, expired by age.

A commit writes its rows as a part of their own, then its manifest under a name that no reader looks at, and renames that to
its number without overwriting. Readers therefore see all of a commit or nothing, whichever step a writer fails in, and of
two writers that start from the same number only one can take the next. The folder must be on a file system whose rename is
atomic, as HDFS is; on a local disk two renames in the same instant are told apart by a check only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitLog:
    """JSON documents numbered from 1 in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path, spark.sparkContext._jvm
        hadoop = self.jvm.org.apache.hadoop
        self.hadoop, conf = hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        folder = self.hadoop(path)
        self.fs = folder.getFileSystem(conf)
        self.context = hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(folder).toUri(), conf)
        never = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        self.keep_old = spark.sparkContext._gateway.new_array(never, 1)
        self.keep_old[0] = never.NONE

    def place(self, number: int):
        return self.fs.makeQualified(self.hadoop(f"{self.path}/{number:012d}.json"))

    def numbers(self) -> list[int]:
        folder = self.hadoop(self.path)
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def newest(self) -> int:
        """0 before the first commit."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.place(number))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, number: int, document: dict) -> int:
        staged = self.fs.makeQualified(self.hadoop(f"{self.path}/.staged-{uuid.uuid4().hex}"))
        out = self.fs.create(staged, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        try:
            self.context.rename(staged, self.place(number), self.keep_old)
        except Exception as error:
            self.fs.delete(staged, False)
            if not self.fs.exists(self.place(number)):
                raise
            raise RuntimeError(f"another writer committed version {number}") from error
        return number


class DeltaReader:
    """Reads a table of parts; it has no way to write. ``merge`` makes current rows of all parts' rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge
        self.schema = T.StructType.fromDDL(schema)
        self.log = CommitLog(spark, f"{self.path}/_log")

    def document(self, number: int | None = None) -> dict:
        number = self.log.newest() if number is None else number
        return self.log.read(number) if number else {"parts": [], "batches": {}}

    def _rows(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p['name']}" for p in parts])

    def read(self, number: int | None = None) -> DataFrame:
        rows = self._rows(self.document(number)["parts"])
        return self.merge(rows) if self.merge else rows

    def between(self, low: int | None, high: int | None) -> DataFrame:
        """Rows, not merged, of the parts whose range of the range column meets this one."""
        if low is None:
            return self._rows([])
        return self._rows([p for p in self.document()["parts"] if p["low"] is not None and p["low"] <= high and p["high"] >= low])


class DeltaTable(DeltaReader):
    """A table of parts that takes rows. ``ranged`` names the column whose range a part's entry holds."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame] | None = None, ranged: str | None = None):
        super().__init__(spark, path, schema, merge)
        self.ranged = ranged

    def _write(self, rows: DataFrame) -> dict:
        """A part that no manifest names yet; its count and range are taken while it is written."""
        name, seen = f"part-{uuid.uuid4().hex}", Observation()
        span = [of(F.col(self.ranged) if self.ranged else F.lit(None).cast("bigint")).cast("bigint").alias(n) for of, n in ((F.min, "low"), (F.max, "high"))]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).observe(seen, F.count(F.lit(1)).alias("rows"), *span).write.parquet(f"{self.path}/{name}")
        size = self.log.fs.getContentSummary(self.log.hadoop(f"{self.path}/{name}")).getLength()
        return {"name": name, "bytes": size} | {k: seen.get[k] for k in ("rows", "low", "high")}

    def append(self, rows: DataFrame, stream: str | None = None, batch: int = 0, based_on: int | None = None) -> int:
        """One commit of rows; a batch of a stream that is there already adds nothing. ``based_on``: the number that the rows
        were made from, where they hang on what the table held; by default the newest."""
        number = self.log.newest() if based_on is None else based_on
        document = self.document(number)
        if stream is not None and document["batches"].get(stream, -1) >= batch:
            return number
        part = self._write(rows)
        parts = document["parts"] + ([part] if part["rows"] else [])
        return self.log.write(number + 1, {"parts": parts, "batches": document["batches"] | ({} if stream is None else {stream: batch})})

    def compact(self, ratio: float = 2.0) -> int:
        """Writes the newest parts as one, going back while the next part is not larger than ``ratio`` times those taken, so a
        row is written again as often as the logarithm of the table's size. Rows are merged only where all parts are taken."""
        number = self.log.newest()
        document = self.document(number)
        parts, taken, size = list(document["parts"]), [], 0
        while parts and (not taken or parts[-1]["bytes"] <= ratio * size):
            size += parts[-1]["bytes"]
            taken.insert(0, parts.pop())
        if len(taken) < 2:
            return number
        rows = self._rows(taken)
        files = max(1, size >> 27)
        merged = (self.merge(rows) if self.merge and not parts else rows).repartition(files)  # coalesce would have few tasks merge, too
        whole = self._write(merged)
        return self.log.write(number + 1, document | {"parts": [*parts, whole]})

    def expire(self, keep: int = 1, grace_ms: int = 86_400_000) -> list[str]:
        """Drops all manifests but the newest ``keep``, and the parts that none of these names; parts younger than the grace
        may belong to a commit under way and stay. Gives the names of what went."""
        numbers = self.log.numbers()
        used = {p["name"] for n in numbers[-keep:] for p in self.document(n)["parts"]}
        for n in numbers[:-keep]:
            self.log.fs.delete(self.log.place(n), False)
        now, gone = self.log.jvm.java.lang.System.currentTimeMillis(), []
        folder = self.log.hadoop(self.path)
        for s in self.log.fs.listStatus(folder) if self.log.fs.exists(folder) else ():
            name = s.getPath().getName()
            if name.startswith("part-") and name not in used and s.getModificationTime() <= now - grace_ms:
                self.log.fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
