"""Cadence per source as a stream with state: the newest distinct stamps, their median gap, and a timer for staleness.

Every task first keeps the newest stamps of each source among its own rows, which loses none of the newest of all; so a
source is one state of bounded size, and what is shuffled does not grow with its rows. The state (in RocksDB, under the
stream's checkpoint) holds the union of the newest stamps of all batches: a restart goes on from it, and stamps that come
again change nothing. A timer is set for the moment after which the newest stamp is too old for the median gap; where it
ends without a new stamp the source is told as stale.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.delta import DeltaTable

#: Stamps that count, the fewest that make a sample, gaps after which a source is stale.
NEWEST, LEAST, STALE_GAPS = 200, 20, 8
OUT = "source_id string, median_gap_ms bigint, sample_size bigint, watermark_ms bigint, cadence string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest(stamps: DataFrame, most: int = NEWEST) -> DataFrame:
    """source_id, ms: the newest distinct stamps of each source within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            sources = batch.column(0)
            for source in pc.unique(sources).to_pylist():
                own = batch.column(1).filter(pc.equal(sources, source)).to_numpy(zero_copy_only=False).astype(np.int64) if source is not None else []
                kept[source] = np.unique(np.concatenate([kept.get(source, np.zeros(0, np.int64)), own]))[-most:]
        rows = [(source, int(ms)) for source, all_ms in kept.items() if source is not None for ms in all_ms]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["source_id", "ms"])

    return stamps.where("ms is not null").select("source_id", F.col("ms").cast("bigint")).mapInArrow(run, "source_id string, ms bigint")


class Cadence(StatefulProcessor):
    """State of one source: its newest stamps."""

    def __init__(self, most: int = NEWEST, least: int = LEAST, gaps: int = STALE_GAPS, timers: bool = True):
        self.most, self.least, self.gaps, self.timers = most, least, gaps, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stamps = handle, handle.getValueState("stamps", "ms array<bigint>")

    def _row(self, source: str, stamps: np.ndarray, now: int) -> tuple[pd.DataFrame, int | None]:
        """The source's row, and when it turns stale, if that is still to come."""
        median = int(np.median(np.diff(stamps))) if len(stamps) >= max(2, self.least) else 0
        due = int(stamps[-1]) + self.gaps * median
        told = "insufficient data" if median <= 0 else "stale" if now > due else "ok"
        row = pd.DataFrame({"source_id": [source], "median_gap_ms": pd.array([median or None], "Int64"), "sample_size": [len(stamps)], "watermark_ms": [int(stamps[-1])], "cadence": [told]})
        return row, due + 1 if told == "ok" else None

    def _told(self, source: str, stamps: np.ndarray, now: int) -> pd.DataFrame:
        row, due = self._row(source, stamps, now)
        if self.timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        return row

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stamps = np.array(self.stamps.get()[0] if self.stamps.exists() else [], np.int64)
        for part in rows:
            stamps = np.unique(np.concatenate([stamps, part["ms"].to_numpy(np.int64)]))[-self.most :]
        self.stamps.update(([int(ms) for ms in stamps],))
        yield self._told(key[0], stamps, int(time.time() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stamps.exists():
            row, _ = self._row(key[0], np.array(self.stamps.get()[0], np.int64), int(time.time() * 1000))
            yield row

    def close(self) -> None:
        pass


def follow(stamps: DataFrame, timers: bool = True, most: int = NEWEST, least: int = LEAST, gaps: int = STALE_GAPS) -> DataFrame:
    """A streaming frame of source_id and ms as a stream of cadence rows, one for each source that a batch or timer touched.

    ``timers``: off for a run that takes what there is and ends, which with timers would wait for them without end.
    """
    return newest(stamps, most).groupBy("source_id").transformWithStateInPandas(Cadence(most, least, gaps, timers), OUT, "Update", "ProcessingTime" if timers else "None")


def latest(rows: DataFrame) -> DataFrame:
    """Of each source the row of the last batch."""
    rest = [c for c in rows.columns if c != "source_id"]
    return rows.groupBy("source_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("source_id", "r.*")


def cadence_table(spark: SparkSession, path: str) -> DeltaTable:
    return DeltaTable(spark, path, f"{OUT}, batch bigint", latest)


def run(stamps: DataFrame, table: DeltaTable, checkpoint: str, stream: str = "cadence", **trigger) -> StreamingQuery:
    """Keeps a table's rows up to date with a stream of stamps. ``spark.sql.streaming.stateStore.providerClass`` must name
    STORE in the session of the stream (``session`` gives one)."""

    def batch(rows: DataFrame, number: int) -> None:
        table.append(rows.withColumn("batch", F.lit(number).cast("bigint")), stream, number)

    return follow(stamps, timers=bool(trigger)).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def session(spark: SparkSession) -> SparkSession:
    """A session beside this one whose streams keep state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return own
