"""Incremental ingest as a stream of session files: each micro-batch is parsed once, its new turns and marks appended.

The stream's own checkpoint remembers the files read; a file is read once, whole, so a store that rewrites a file gives it
a new name. The per-source mark of the batch runs is kept beside it with the same rule: stamps at or below it are not read
(there is no allowance for lateness), unless a backfill starts below it. What a batch writes are its own rows: turns that
are not there yet (their ids are made from their content, which holds their stamp, so only parts whose range of stamps
meets the batch's are looked into), one mark a source, and the newest stamps a source for its cadence. A batch that is run
again after a failure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.plan import session_with
from ..functions.text import fingerprint, stable_id
from ..operators import rollups, state
from ..operators.delta import DeltaTable
from ..sources import stores
from .cadence import NEWEST

TURN = "id string, source_id string, native_id string, timestamp_ms bigint, role string, content_fingerprint string, source_file string"
MARK = "source_id string, last_ms bigint"
STAMP = "source_id string, ms bigint"
#: Parts of a table beyond which a batch has it compacted.
MOST_PARTS = 16
#: Bytes of files that a batch takes: every batch looks into the stored turns of its span, so few batches do it seldom.
BATCH_BYTES = 256 << 20


def raised(marks: DataFrame) -> DataFrame:
    return marks.groupBy("source_id").agg(F.max("last_ms").alias("last_ms"))


def newest_stamps(stamps: DataFrame) -> DataFrame:
    """The newest distinct stamps of each source."""
    top = Window.partitionBy("source_id").orderBy(F.desc("ms"))
    return stamps.select("source_id", "ms").distinct().withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= NEWEST).drop("rank")


class Store:
    """Turns, marks and newest stamps as tables that append, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.turns = DeltaTable(spark, f"{path}/turns", TURN, ranged="timestamp_ms")
        self.marks = DeltaTable(spark, f"{path}/marks", MARK, raised)
        self.stamps = DeltaTable(spark, f"{path}/stamps", STAMP, newest_stamps)

    def read(self, name: str) -> DataFrame:
        """turns, marks, stamps, or cadence, which follows from the stamps."""
        return rollups.cadence(self.stamps.read()) if name == "cadence" else getattr(self, name).read()

    def tidy(self, most: int = MOST_PARTS) -> None:
        """Compacts the tables that have many parts."""
        for table in (self.turns, self.marks, self.stamps):
            if len(table.document()["parts"]) > most:
                table.compact()


def turns_of(rec: DataFrame) -> DataFrame:
    said = rec.where("record_type = 'message'").withColumn("content_fingerprint", fingerprint(F.col("content_excerpt")))
    own = stable_id(F.lit("turn"), F.col("source_file"), F.col("timestamp_ms"), F.col("role"), F.col("tool_name"), F.col("content_fingerprint"))
    return said.select(own.alias("id"), "source_id", "native_id", "timestamp_ms", "role", "content_fingerprint", "source_file")


def take(store: Store, rec: DataFrame, stream: str | None = None, batch: int = 0) -> None:
    """One batch of records into the store: turns first, then the mark, as the mark vouches for what is durable."""
    columns = ["source_id", "native_id", "timestamp_ms", "record_type", "role", "tool_name", "content_excerpt", "source_file"]
    rec = rec.select(*columns).persist()
    try:
        span = rec.agg(F.min("timestamp_ms").alias("low"), F.max("timestamp_ms").alias("high")).first()
        if span["low"] is not None:
            base = store.turns.log.newest()
            stored = store.turns.between(span["low"], span["high"])
            store.turns.append(state.append_new(stored, turns_of(rec), "id", "native_id"), stream, batch, base)
            store.stamps.append(newest_stamps(rec.select("source_id", F.col("timestamp_ms").alias("ms"))), stream, batch)
            store.marks.append(raised(rec.select("source_id", F.col("timestamp_ms").alias("last_ms"))), stream, batch)
            store.tidy()
    finally:
        rec.unpersist()


def ingest(spark: SparkSession, source_id: str, folder: str, store: Store, checkpoint: str, glob: str = stores.GLOB, files_a_batch: int | None = None, floor_ms: int = 0) -> StreamingQuery:
    """Starts a stream over a store's folder that takes all files there are and ends (availableNow). A batch takes BATCH_BYTES,
    in however many files, or ``files_a_batch`` files where that is given."""
    most = ("maxBytesPerTrigger", BATCH_BYTES) if files_a_batch is None else ("maxFilesPerTrigger", files_a_batch)
    # a batch's files are listed by a few tasks a core, not each by one, in the session of the reader while the stream runs
    own = session_with(spark, stores.LISTING, 4 * spark.sparkContext.defaultParallelism)
    files = own.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option(*most).option("lineSep", "\n").text(folder)

    def batch(rows: DataFrame, number: int) -> None:
        take(store, stores.READERS[source_id](rows.sparkSession, stores.numbered(rows), floor_ms), checkpoint, number)

    named = files.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
