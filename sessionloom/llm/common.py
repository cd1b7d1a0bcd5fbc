"""Helpers shared by the training-data operators: tables, Arrow text slices, word hashes, lineage cuts."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import shared_folder

#: Text bytes that one vectorised step handles; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Spark's setting for shuffle files to go when the query that wrote them ends, not when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder the session names; a folder of our own only in a local session that names none.

    The shuffle files behind the checkpoint go at once: nothing reads them again.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint()  # a new query: the setting holds for those made under it
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def let_go(*tables: DataFrame) -> None:
    """Deletes the files of checkpoints (of cut_lineage) that nothing reads again; Spark keeps them until the folder goes."""
    for df in tables:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@functools.lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """At the end of a task: memory that a worker has freed goes back to the machine, as idle workers stay beside the next ones."""
    _cache.clear()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        start = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, start + limit, side="right")))
        yield batch.slice(low, high - low)
        low = high


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more at the end); null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n >= len(_cache.get("up", ())):
        _cache["up"], _cache["down"] = _powers(_BASE, int(n * 1.25) + 1024), _powers(_INVERSE, int(n * 1.25) + 1024)
    return _cache["up"], _cache["down"]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the flat texts."""
    inside = ~SPACE[data]
    step = np.empty(len(data), bool)
    if len(data):
        step[0] = inside[0]
        step[1:] = inside[1:] & ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    step[borders] = inside[borders]
    starts = np.flatnonzero(step)
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = inside[-1]
        last[:-1] = inside[:-1] & (~inside[1:] | step[1:])
    ends = np.flatnonzero(last) + 1
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[LOWER[data] if lower else data] * up[: len(data)], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes


def distinct_words(texts: pa.Array, newline: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts split at single spaces (and newlines): where each text's words begin, each word's number, the distinct words."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if newline else texts, " ")
    coded = pc.dictionary_encode(lists.flatten())
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()
