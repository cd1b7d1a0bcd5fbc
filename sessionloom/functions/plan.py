"""Cuts in a plan and folders for them: what several branches read is written once to the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one a local session gets a temporary folder; a cluster does not,
    as its executors could not read it."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="shared-")


def written_once(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to a few tasks a core, for work on each row that outweighs a shuffle: a file of few row groups, however
    many rows they hold, would else be the work of few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A session's setting for what is done inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def session_with(spark: SparkSession, name: str, value: object) -> SparkSession:
    """A session beside this one with its settings and one more, for what reads settings later, as a stream does."""
    own = spark.newSession()
    for key, held in {**spark.conf.getAll, name: str(value)}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, held)
    return own
