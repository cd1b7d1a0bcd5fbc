"""Readers of the foreign session stores: JSON-lines trees and SQLite files as one normalised record schema.

Every reader gives RECORD rows and never fails on a bad line: text that is no JSON, or no object, is left out, and
``malformed`` counts it. ``line`` is the line's number in its file, so order within a file is a column and not an accident
of reading. A missing path gives an empty frame. Stamps are kept above a floor (``state.floor_ms``).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.plan import setting, written_once
from ..functions.text import cells, iso_to_ms, redact, safe_path
from ..operators import folders

RECORD = (
    "source_id string, native_id string, timestamp_ms bigint, record_type string, role string, project_path string, git_branch string, "
    "model string, content_excerpt string, tool_name string, error_text string, raw_meta string, source_file string, line bigint"
)
#: Excerpt length, and the keys that a source's records must carry.
EXCERPT = 200
FORMAT_KEYS = {"claude": ["timestamp", "type"], "codex": ["timestamp", "type", "payload"], "omp": ["timestamp", "type"], "pi": ["timestamp", "type"]}
#: Spark's setting for how many tasks list folders.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: File names that are read.
GLOB = "*.jsonl"


def blank() -> Column:
    return F.lit("")


def lines(spark: SparkSession, paths: list[str], glob: str = GLOB) -> DataFrame:
    """source_file, line (from 1) and value of every line that is not blank, of all files of that name under the paths.

    Spark splits large files by bytes and packs small ones, so no file is ever one row or one task. Folders are listed by a
    few tasks a core: by default each folder, up to 10,000, is a task of its own.
    """
    with setting(spark, LISTING, 4 * spark.sparkContext.defaultParallelism):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(paths)
    return numbered(files.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), "value"))


def numbered(rows: DataFrame) -> DataFrame:
    """source_file, block (first byte of its split) and value of each line, as numbered lines: a line's place in its split
    is where it was read, and a split's first number is one more than the lines of the splits before it. What is counted
    beforehand is one row a split. Every line finds its split, so the join is an outer one: Spark leaves it out, and the
    second reading of the files with it, where nothing asks for the number."""
    placed = rows.withColumn("k", F.monotonically_increasing_id())
    splits = placed.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = splits.select("source_file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    value = F.regexp_replace("value", r"\r$", "")
    return placed.join(begin, ["source_file", "block"], "left").where(F.trim(value) != "").select("source_file", (F.col("k") + F.col("shift")).alias("line"), value.alias("value"))


def there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _last_keys(lines: pd.Series) -> pd.Series:
    """JSON texts with only the last of repeated keys; null for null and for what is no JSON."""

    def once(line: str | None) -> str | None:
        try:
            return None if line is None else json.dumps(json.loads(line), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return lines.map(once, na_action="ignore")


def parsed(rows: DataFrame) -> DataFrame:
    """Adds v, the line as a variant; null where it is no JSON. Of repeated keys the last counts, whatever the session's
    settings: a line that the parser does not take, and no other, is written anew with its last keys. That function counts as not
    deterministic, so no filter on what a line holds moves below it: moved, it would parse each line again for each test."""
    again = F.pandas_udf(_last_keys, T.StringType()).asNondeterministic()
    tried = rows.withColumn("_v", F.try_parse_json("value")).withColumn("_again", again(F.when(F.col("_v").isNull(), F.col("value"))))
    return tried.withColumn("v", F.coalesce("_v", F.try_parse_json("_again"))).drop("_v", "_again")


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def field(path: str, v: str = "v", kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", kind)


def kind_of(path: str, v: str = "v") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.col(v), f"$.{path}", "variant")), F.lit("VOID"))


def string_at(path: str, v: str = "v") -> Column:
    """A string's value; '' for what is missing or no string."""
    return F.when(kind_of(path, v) == "STRING", field(path, v)).otherwise("")


def text_of(path: str, block: str, v: str = "v") -> Column:
    """Text of content that is a string or a list of blocks. block: SQL for a block's text over the variable x, null to skip."""
    listed = F.array_join(F.expr(f"filter(transform(try_variant_get({v}, '$.{path}', 'array<variant>'), x -> {block}), y -> y is not null)"), " ")
    return F.when(kind_of(path, v) == "STRING", field(path, v)).when(kind_of(path, v).startswith("ARRAY"), listed).otherwise("")


def record(df: DataFrame, source_id: str, **columns: Column) -> DataFrame:
    """Rows in the order of RECORD; what is not given is empty."""
    fields = T.StructType.fromDDL(RECORD).fields
    given = {"source_id": F.lit(source_id), "source_file": F.col("source_file"), "line": F.col("line")} | columns
    return df.select(*[F.coalesce(given.get(f.name, F.lit("") if f.name != "raw_meta" else F.lit("{}")).cast(f.dataType), F.lit("").cast(f.dataType) if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def excerpt(text: Column) -> Column:
    return F.substring(redact(text), 1, EXCERPT)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def stamped(spark: SparkSession, paths: list[str] | DataFrame, floor_ms: int, glob: str = GLOB) -> DataFrame | None:
    """Objects with a stamp above the floor: source_file, line, v, ms, type. paths: folders, or lines that are read already."""
    if isinstance(paths, DataFrame):
        found = paths
    else:
        known = [p for p in paths if there(spark, p)]
        if not known:
            return None
        found = lines(spark, known, glob)
    rows = parsed(found).where(F.col("v").isNotNull()).where(is_object(F.col("v")))
    rows = rows.withColumn("ms", iso_to_ms(string_at("timestamp"))).withColumn("type", string_at("type"))
    return rows.where((F.col("ms") > floor_ms) & (F.col("ms") > 0))


def malformed(spark: SparkSession, paths: list[str], glob: str = GLOB) -> DataFrame:
    """Per file: lines that are no JSON, the first of them, and lines that are no object."""
    known = [p for p in paths if there(spark, p)]
    if not known:
        return spark.createDataFrame([], "source_file string, malformed bigint, first_bad_line bigint, not_objects bigint")
    rows = parsed(lines(spark, known, glob))
    bad = F.col("v").isNull()
    return rows.groupBy("source_file").agg(F.count_if(bad).alias("malformed"), F.min(F.when(bad, F.col("line"))).alias("first_bad_line"), F.count_if(~bad & ~is_object(F.col("v"))).alias("not_objects"))


def topic_events(spark: SparkSession, path: str, since_ms: int = 0, topics: list[str] = (), most: int = 500, glob: str = GLOB) -> DataFrame:
    """The newest events of a folder of topic logs, at most ``most``; lines without a stamp have 0.

    Files are taken from the last name on until they hold ``most`` fitting lines; the rest is not looked at. Events of one
    stamp stand by file, the last name first, then by line. The files taken are at most ``most``, so they are broadcast.
    """
    shape = "ts_ms bigint, topic string, level string, msg string, project_id string, agent_type string, source_file string, line bigint"
    if not there(spark, path):
        return spark.createDataFrame([], shape)
    text = lambda name, default=None: F.coalesce(field(name), F.lit(default).cast("string")).alias(name)
    at = F.coalesce(field("ts_ms", kind="bigint"), F.lit(0).cast("bigint")).alias("ts_ms")
    rows = parsed(lines(spark, [path], glob)).where(is_object(F.col("v")))
    rows = rows.select(at, text("topic", ""), text("level", "INFO"), text("msg", ""), text("project_id"), text("agent_type"), "source_file", "line")
    rows = rows.where(F.col("ts_ms") >= since_ms)
    if topics:
        rows = rows.where(F.col("topic").isin(*topics))
    rows = written_once(rows)  # both steps below read it: files are read for it once
    files = rows.groupBy("source_file").agg(F.count("*").alias("n")).orderBy(F.desc("source_file")).limit(most)
    before = F.sum("n").over(Window.orderBy(F.desc("source_file")).rowsBetween(Window.unboundedPreceding, -1))
    taken = files.select("source_file", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < most).select("source_file")
    return rows.join(F.broadcast(taken), "source_file", "left_semi").select(*[c.split()[0] for c in shape.split(", ")]).orderBy(F.desc("ts_ms"), F.desc("source_file"), "line").limit(most)


#: What a requirement id, a gate row and a status cell look like.
REQUIREMENT = r"^[A-Z]{3,6}-\d{3}$"
GATE_ROW = r"^\|\s*(G\d+)\s*\|"
STATUS = r"(?i)^\*{0,2}(PASS|FAIL|BLOCKED)\*{0,2}$"


def gate_rows(markdown: DataFrame) -> DataFrame:
    """source_file, gate, status and requirement_ids of the gate rows of Markdown lines; of a gate's rows in one file the last
    counts. The status is the first cell that is one, else BLOCKED."""
    rows = markdown.where(F.col("value").rlike(GATE_ROW)).withColumn("c", cells(F.col("value")))
    status = F.upper(F.regexp_extract(F.get(F.filter("c", lambda x: x.rlike(STATUS)), F.lit(0)), STATUS, 1))
    ids = F.filter(F.transform(F.split(F.get("c", F.lit(1)), ","), lambda x: F.trim(x)), lambda x: x.rlike(REQUIREMENT))
    named = rows.select("source_file", "line", F.regexp_extract("value", GATE_ROW, 1).alias("gate"), F.struct(F.coalesce(status, F.lit("BLOCKED")).alias("status"), ids.alias("requirement_ids")).alias("row"))
    return named.groupBy("source_file", "gate").agg(F.max_by("row", "line").alias("row")).select("source_file", "gate", "row.status", "row.requirement_ids")


def requirement_ids(markdown: DataFrame) -> DataFrame:
    """source_file and id of the requirements that a table row defines, which is one that starts with the id."""
    rows = markdown.where(F.col("value").startswith("|")).select("source_file", cells(F.col("value")).alias("c"))
    return rows.where((F.size("c") >= 2) & F.get("c", F.lit(0)).rlike(REQUIREMENT)).select("source_file", F.get("c", F.lit(0)).alias("id")).distinct()


def with_folder(rows: DataFrame, segment: Column, known_paths: list[str], layout: str) -> DataFrame:
    """Adds folder: the path that a store folder's name stands for, among the known paths and what lies above them; '' where
    none are known or the name is malformed."""
    if not known_paths:
        return rows.withColumn("folder", blank())
    spark, named = rows.sparkSession, rows.withColumn("segment", segment)
    known = folders.ancestors(spark.createDataFrame([(p,) for p in known_paths], "path string"))
    names = folders.decode(named.select(F.col("segment").alias("name")).distinct(), known, layout)
    return named.join(names.select(F.col("name").alias("segment"), F.col("path").alias("folder")), "segment", "left").withColumn("folder", F.coalesce("folder", blank())).drop("segment")


def claude(spark: SparkSession, path: str | DataFrame, floor_ms: int = 0, known_paths: list[str] = (), glob: str = GLOB) -> DataFrame:
    """Messages and errors; files under a subagents folder are left out. known_paths: project paths for folder names."""
    rows = stamped(spark, path if isinstance(path, DataFrame) else [path], floor_ms, glob)
    if rows is None:
        return empty(spark)
    rows = rows.where(~F.col("source_file").contains("/subagents/"))
    rows = with_folder(rows, F.element_at(F.split("source_file", "/"), -2), list(known_paths), "claude")
    message = F.col("type").isin("user", "assistant")
    error = (F.col("type") == "system") & (string_at("subtype") == "error")
    block = "case when try_variant_get(x, '$.type', 'string') = 'text' then coalesce(try_variant_get(x, '$.text', 'string'), '') when try_variant_get(x, '$.type', 'string') = 'tool_use' then concat('[tool:', coalesce(try_variant_get(x, '$.name', 'string'), ''), ']') end"
    role = F.when(kind_of("message.role") == "STRING", field("message.role")).otherwise(F.col("type"))
    return record(
        rows.where(message | error), "claude",
        native_id=field("uuid"), timestamp_ms=F.col("ms"), record_type=F.when(message, "message").otherwise("error"),
        role=F.when(message, role).otherwise(""), project_path=safe_path(string_at("cwd"), F.col("folder")), git_branch=field("gitBranch"),
        model=F.when(message, field("message.model")), content_excerpt=F.when(message, excerpt(text_of("message.content", block))),
        error_text=F.when(error, excerpt(F.coalesce(field("hookErrors"), blank()))),
    )


def codex(spark: SparkSession, path: str | DataFrame, floor_ms: int = 0, glob: str = GLOB) -> DataFrame:
    """Both roots of the store; the working folder of the last session_meta line above the floor holds down the file."""
    roots = path if isinstance(path, DataFrame) else [f"{path}/{name}" for name in ("sessions", "archived_sessions") if there(spark, f"{path}/{name}")] or [path]
    rows = stamped(spark, roots, floor_ms, glob)
    if rows is None:
        return empty(spark)
    meta, item = F.col("type") == "session_meta", string_at("payload.type")
    so_far = Window.partitionBy("source_file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cwd", F.coalesce(F.last(F.when(meta, F.coalesce(field("payload.cwd"), blank())), ignorenulls=True).over(so_far), blank()))
    message = (F.col("type") == "response_item") & (item == "message")
    call = (F.col("type") == "response_item") & (item == "function_call")
    error = (F.col("type") == "event_msg") & F.lower(item).contains("error")
    kind = F.when(meta, "session_start").when(message, "message").when(call, "tool_call").when(error, "error")
    block = "case when schema_of_variant(x) = 'STRING' then cast(x as string) else nullif(try_variant_get(x, '$.text', 'string'), '') end"
    own = F.coalesce(field("payload.id"), F.col("ms").cast("string"))
    return record(
        rows.withColumn("kind", kind).where("kind is not null"), "codex",
        native_id=F.when(error, F.col("ms").cast("string")).otherwise(own), timestamp_ms=F.col("ms"), record_type=F.col("kind"),
        role=F.when(call, "tool").when(message, field("payload.role")), project_path=F.col("cwd"), model=F.when(meta, field("payload.model")),
        content_excerpt=F.when(message, excerpt(text_of("payload.content", block))), tool_name=F.when(call, field("payload.name")),
        error_text=F.when(error, excerpt(F.coalesce(field("payload.message"), blank()))),
    )


def omp(spark: SparkSession, path: str | DataFrame, floor_ms: int = 0, source_id: str = "omp", known_paths: list[str] = (), glob: str = GLOB) -> DataFrame:
    """The two stores of one format; path and model of the last session line above the floor hold down the file."""
    rows = stamped(spark, path if isinstance(path, DataFrame) else [path], floor_ms, glob)
    if rows is None:
        return empty(spark)
    session = F.col("type") == "session"
    root = "//" if isinstance(path, DataFrame) else path.rstrip("/") + "/"
    below = F.substring_index(F.substring_index("source_file", root, -1), "/", 1)  # the first folder under the store's own
    rows = with_folder(rows, F.when(F.col("source_file").contains(root), below).otherwise(""), list(known_paths), "omp")
    so_far = Window.partitionBy("source_file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    sticky = lambda value: F.coalesce(F.last(F.when(session, value), ignorenulls=True).over(so_far), blank())
    chosen = safe_path(string_at("cwd"), blank())
    rows = rows.withColumn("cwd", F.coalesce(F.nullif(F.coalesce(F.last(F.when(session & (chosen != ""), chosen), ignorenulls=True).over(so_far), blank()), blank()), F.col("folder")))
    rows = rows.withColumn("model", sticky(F.coalesce(field("model"), blank())))
    tool = (F.col("type") == "custom") & string_at("customType").isin("tool_call", "tool_result", "tool_error") & kind_of("data").startswith("OBJECT")
    kind = F.when(session, "session_start").when(F.col("type") == "message", "message").when(tool, F.when(string_at("customType") == "tool_error", "error").otherwise("tool_call"))
    block = "case when schema_of_variant(x) = 'STRING' then cast(x as string) when try_variant_get(x, '$.type', 'string') = 'text' then coalesce(try_variant_get(x, '$.text', 'string'), '') end"
    text = F.when(kind_of("message") == "STRING", field("message")).otherwise(text_of("message.content", block))
    return record(
        rows.withColumn("kind", kind).where("kind is not null"), source_id,
        native_id=field("id"), timestamp_ms=F.col("ms"), record_type=F.col("kind"),
        role=F.when(tool, "tool").when(F.col("kind") == "message", field("message.role")), project_path=F.col("cwd"), model=F.col("model"),
        content_excerpt=F.when(F.col("kind") == "message", excerpt(text)), tool_name=F.when(tool, F.coalesce(F.nullif(field("data.name"), blank()), string_at("customType"))),
        error_text=F.when(tool, excerpt(F.coalesce(field("data.error"), blank()))),
    )


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` with options path and table, and columns by the schema given. Where column and above
    are given, only rows in which that column is larger are asked for. A read-only connection a task; partitions are ranges
    of rowid, so a large table is read by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.rows = int(options.get("rowspertask", 100_000))
        self.column, self.floor = options.get("column"), int(options.get("above", 0))

    def connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self.connect() as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        return [] if low is None else [InputPartition((k, k + self.rows)) for k in range(low, high + 1, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        where, bound = (f' and "{self.column}" > ?', [self.floor]) if self.column else ("", [])
        kinds = [{T.LongType: int, T.DoubleType: float}.get(type(f.dataType), str) for f in self.schema.fields]
        with self.connect() as db:
            for row in db.execute(f'select {columns} from "{self.table}" where rowid >= ? and rowid < ?{where}', (*partition.value, *bound)):
                yield tuple(None if v is None else kind(v.decode("utf-8", "replace") if isinstance(v, bytes) else v) for kind, v in zip(kinds, row, strict=True))


#: The tables and columns that are read.
OPENCODE = {
    "session": "id string, project_id string, directory string, title string, time_created bigint, time_updated bigint, model string, agent string",
    "message": "id string, session_id string, time_created bigint, data string",
    "part": "message_id string, data string, time_created bigint",
}
ROUTER = "id string, timestamp string, provider string, model string, connectionId string, endpoint string, promptTokens bigint, completionTokens bigint, cost double, status string"


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, **asked: object) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).options(path=path, table=table, **asked).load()


def sqlite_health(path: str, tables: dict[str, str]) -> tuple[str, str]:
    """(absent, drifted or ok, what is missing) of a SQLite store's tables and columns."""
    import os
    import sqlite3

    if not os.path.exists(path):
        return "absent", f"path not found: {path}"
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            found = {t: {r[1] for r in db.execute(f'pragma table_info("{t}")')} for t in tables}
    except sqlite3.Error as error:
        return "absent", f"cannot read schema: {error}"
    wanted = {t: set(T.StructType.fromDDL(s).fieldNames()) for t, s in tables.items()}
    problems = [f"table {t} is gone" if not found[t] else f"{t} missing {', '.join(sorted(wanted[t] - found[t]))}" for t in tables if wanted[t] - found[t]]
    return ("drifted", "; ".join(problems)) if problems else ("ok", "")


def file_health(rows: DataFrame, keys: list[str], sample: int = 200) -> DataFrame:
    """Per file of numbered lines: outcome, records sampled (its first objects), those with all keys, the key missing most."""
    first = Window.partitionBy("source_file").orderBy("line")
    objects = parsed(rows).where(F.col("v").isNotNull()).where(is_object(F.col("v"))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample)
    has = {k: F.try_variant_get(F.col("v"), f"$.{k}", "variant").isNotNull() for k in keys}
    counts = objects.groupBy("source_file").agg(F.count("*").alias("sampled"), F.count_if(functools.reduce(lambda a, b: a & b, has.values())).alias("complete"), *[F.count_if(~h).alias(f"_{k}") for k, h in has.items()])
    worst = F.array_sort(F.array(*[F.struct((-F.col(f"_{k}")).alias("n"), F.lit(k).alias("key")) for k in keys]))[0]
    outcome = F.when(2 * F.col("complete") <= F.col("sampled"), "drifted").otherwise("ok")
    return counts.select("source_file", outcome.alias("outcome"), "sampled", "complete", F.when(worst["n"] < 0, worst["key"]).alias("worst"))


def jsonl_health(spark: SparkSession, path: str, keys: list[str], sample: int = 200, glob: str = GLOB) -> DataFrame:
    """One row: what file_health says of the newest file; a file without an object is ok, no file is absent."""
    none = spark.createDataFrame([("absent", 0, 0, None)], "outcome string, sampled bigint, complete bigint, worst string")
    if not there(spark, path):
        return none
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(path)
    newest = files.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]
    if newest is None:
        return none
    found = file_health(lines(spark, [newest], newest.rsplit("/", 1)[-1]), keys, sample).drop("source_file")
    return found.groupBy().agg(F.coalesce(F.first("outcome"), F.lit("ok")).alias("outcome"), F.coalesce(F.first("sampled"), F.lit(0)).alias("sampled"), F.coalesce(F.first("complete"), F.lit(0)).alias("complete"), F.first("worst").alias("worst"))


def databases(spark: SparkSession, path: str) -> DataFrame:
    """source_file and content of the SQLite files that a path names: a file, a folder or a pattern."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content")


#: Rows of SQLite files that a task holds before it hands them on.
HELD_ROWS = 10_000


def database_tables(files: DataFrame, tables: dict[str, str], above: dict[str, tuple[str, int]] = {}) -> DataFrame:
    """Rows of tables of every SQLite file: source_file, into (the table's name) and a struct a table, null but in its own
    rows. above: a table's column and the value that it must exceed. Spark brings the bytes, so files may lie wherever Spark
    reads; each is opened once, in its task's memory; a file above 2 GB is read in place by the "sqlite" source."""
    shape = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("into", T.StringType()), *[T.StructField(n, T.StructType.fromDDL(s)) for n, s in tables.items()]])
    fields = {n: T.StructType.fromDDL(s).fields for n, s in tables.items()}
    kinds = {n: [{T.LongType: int, T.DoubleType: float}.get(type(f.dataType), str) for f in of] for n, of in fields.items()}
    ask = {n: f"select {', '.join(f'\"{f.name}\"' for f in of)} from \"{n}\"" + (f' where "{above[n][0]}" > ?' if n in above else "") for n, of in fields.items()}

    def run(batches: Iterator) -> Iterator:
        import sqlite3

        import pyarrow as pa

        arrow = {int: pa.int64(), float: pa.float64(), str: pa.string()}
        types = {n: pa.struct([(f.name, arrow[k]) for f, k in zip(of, kinds[n], strict=True)]) for n, of in fields.items()}

        def batch(table: str, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
            clean = [[None if v is None else kind(v.decode("utf-8", "replace") if isinstance(v, bytes) else v) for v in values] for kind, values in zip(kinds[table], zip(*rows, strict=True), strict=True)]
            own = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(clean, types[table], strict=True)], fields=list(types[table]))
            structs = [own if n == table else pa.nulls(len(rows), types[n]) for n in tables]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([table] * len(rows)), *structs], names=shape.fieldNames())

        held = {n: ([], []) for n in tables}
        for files in batches:
            for name, content in zip(files.column(0).to_pylist(), files.column(1), strict=True):
                raw = bytearray(content.as_buffer())
                raw[18:20] = b"\x01\x01"  # a file in write-ahead mode is read as it stands
                db = sqlite3.connect(":memory:")
                db.text_factory = lambda b: b.decode("utf-8", "replace")
                db.deserialize(bytes(raw))
                for table, (names, rows) in held.items():
                    cursor = db.execute(ask[table], [above[table][1]] if table in above else [])
                    while found := cursor.fetchmany(HELD_ROWS):
                        names += [name] * len(found)
                        rows += found
                        if len(rows) >= HELD_ROWS:
                            yield batch(table, names, rows)
                            names.clear()
                            rows.clear()
                db.close()
        for table, (names, rows) in held.items():
            if rows:
                yield batch(table, names, rows)

    return files.select("source_file", "content").mapInArrow(run, shape)


def database_rows(files: DataFrame, table: str, schema: str, column: str | None = None, above: int = 0) -> DataFrame:
    """Rows of one table of every SQLite file, with source_file; where ``column`` is given only those in which it is larger
    than ``above``."""
    return database_tables(files, {table: schema}, {table: (column, above)} if column else {}).select("source_file", f"{table}.*")


def opencode(spark: SparkSession, path: str | DataFrame, floor_ms: int = 0) -> DataFrame:
    """Sessions updated above the floor with their messages above it; a session's start only where it was created above it.
    path: a place of SQLite files, or a frame of their source_file and content. Ids hold within a file."""
    if isinstance(path, str) and not there(spark, path):
        return empty(spark)
    files = databases(spark, path) if isinstance(path, str) else path
    above = {"session": "time_updated", "message": "time_created"}
    rows = written_once(database_tables(files, OPENCODE, {t: (c, floor_ms) for t, c in above.items()}))  # files are opened once
    session, message, part = (rows.where(F.col("into") == t).select("source_file", f"{t}.*") for t in OPENCODE)
    session = session.withColumnsRenamed({"id": "session_id"}).drop("time_updated")
    meta = lambda *names: F.to_json(F.struct(*names))
    begun = record(
        session.where(F.col("time_created") > floor_ms).withColumn("line", F.lit(0)), "opencode",
        native_id=F.col("session_id"), timestamp_ms=F.col("time_created"), record_type=F.lit("session_start"), project_path=F.col("directory"), model=F.col("model"), raw_meta=meta("title", "agent", "session_id", "project_id"),
    )
    data = F.try_parse_json("data")
    said = F.when(F.col("ptype") == "text", F.coalesce(F.try_variant_get(F.col("p"), "$.text", "string"), blank())).when(F.col("ptype") == "tool", F.concat(F.lit("[tool:"), F.coalesce(F.try_variant_get(F.col("p"), "$.tool", "string"), blank()), F.lit("]")))
    parts = part.withColumn("p", data).withColumn("ptype", F.try_variant_get(F.col("p"), "$.type", "string")).withColumn("said", said).where("said is not null")
    texts = parts.groupBy("source_file", F.col("message_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time_created", "said"))), lambda x: x["said"]), " ").alias("text"))
    kept = message.withColumn("v", data).where(F.col("v").isNotNull()).withColumn("message_id", F.col("id"))
    joined = kept.join(session.drop("time_created"), ["source_file", "session_id"]).join(texts, ["source_file", "id"], "left")
    told = record(
        joined.withColumn("line", F.lit(1)), "opencode",
        native_id=F.col("message_id"), timestamp_ms=F.col("time_created"), record_type=F.lit("message"), role=field("role"), project_path=F.col("directory"), model=F.col("model"),
        content_excerpt=excerpt(F.coalesce("text", blank())), raw_meta=meta("session_id", "project_id", "message_id"),
    )
    return begun.union(told)


def router(spark: SparkSession, path: str | DataFrame, floor_ms: int = 0) -> DataFrame:
    """Requests above the floor; what they cost and used is in raw_meta. path: as for opencode."""
    if isinstance(path, str) and not there(spark, path):
        return empty(spark)
    rows = database_rows(databases(spark, path) if isinstance(path, str) else path, "usageHistory", ROUTER).withColumn("ms", iso_to_ms(F.col("timestamp"))).where((F.col("ms") > floor_ms) & (F.col("ms") > 0))
    meta = F.to_json(F.struct("provider", F.col("connectionId").alias("connection_id"), "endpoint", F.col("promptTokens").alias("prompt_tokens"), F.col("completionTokens").alias("completion_tokens"), F.col("cost").alias("cost_usd"), "status"))
    return record(rows.withColumn("line", F.lit(0)), "nine_router", native_id=F.col("id"), timestamp_ms=F.col("ms"), record_type=F.lit("router_request"), model=F.col("model"), raw_meta=meta)


def request_columns(rec: DataFrame) -> DataFrame:
    """Router records as request columns again."""
    fields = "provider string, connection_id string, endpoint string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, status string"
    m = rec.where("record_type = 'router_request'").withColumn("m", F.from_json("raw_meta", fields))
    text = lambda c: F.coalesce(F.col(f"m.{c}"), blank()).alias(c)
    return m.select("source_id", "native_id", "timestamp_ms", "model", text("provider"), text("connection_id"), text("endpoint"), text("status"), "m.cost_usd", "m.prompt_tokens", "m.completion_tokens")


READERS = {"omp": omp, "pi": functools.partial(omp, source_id="pi"), "claude": claude, "codex": codex, "opencode": opencode, "nine_router": router}


def discover(spark: SparkSession, source_id: str, path: str) -> tuple[bool, int]:
    """Whether a source is there, and its files or rows."""
    if not there(spark, path):
        return False, 0
    if source_id in ("opencode", "nine_router"):
        table, schema = ("session", OPENCODE["session"]) if source_id == "opencode" else ("usageHistory", ROUTER)
        return True, sqlite_table(spark, path, table, schema).count()
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").format("binaryFile").load(path).select("path")
    return True, files.where(~F.col("path").contains("/subagents/")).count()


def scan(spark: SparkSession, paths: dict[str, str], floors: dict[str, int]) -> DataFrame:
    """Records of all sources in registry order; ``source_order`` and ``line`` make arrival order a column."""
    frames = [READERS[s](spark, paths[s], floors.get(s, 0)).withColumn("source_order", F.lit(k)) for k, s in enumerate(READERS) if s in paths]
    return functools.reduce(DataFrame.union, frames)
