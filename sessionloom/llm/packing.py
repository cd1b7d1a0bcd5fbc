"""Best-fit packing of token sequences by hierarchical residual packing.

Every task packs its pieces best-fit by decreasing length into bins of ``capacity`` tokens. A bin that no remaining item
could still fit (its free room is below the shortest open item) is final. The other bins become items of the next round,
in which ``FAN_IN`` groups merge into one. A group holds GROUP_BINS bins at most on average, so no task sees all bins: while
more stay open, each round deals them to other groups, and the rounds end where one group held all of them or a round over
all groups has saved no bin. Nothing is dropped: bins open at the end are sequences too.

Only documents longer than ``capacity`` are cut, at multiples of ``capacity``. A null text is empty and consists of the
end id alone. Equal documents are packed separately. Ties (equal free room, equal length) fall in arrival order, so
sequence ids are arbitrary but every piece has exactly one place. Result columns replace columns of the same name.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, distinct_words, give_back, table, text_slices, tokenizer_path

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
FAN_IN = 8
GROUP_BINS = 20_000
#: Distinct words that a task keeps before it starts its table anew; the table goes with the task.
TABLE_ROWS = 300_000
#: Bytes of text between two look-ups in the table: a word is looked up once a step, so longer steps meet fewer words.
STEP_BYTES = 8 << 20
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@functools.lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTable:
    """Ids of a text from the ids of its distinct words (runs without space or newline), as little-endian 32 bits.

    The vocabulary's normaliser drops white space and no token crosses it, so words are coded one by one; what precedes
    closing commas and full stops is looked up by itself, as they are tokens of their own kind. Two bounded generations:
    what the older one holds moves to the newer one when it is met again, so frequent words stay.
    """

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        self.model, self.rows, self.new, self.old = tokenizer(path), rows, {}, {}
        names = self.model.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for name, k in names.items() if name.endswith("</w>")]] = True

    def code_each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def code_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, coded as one text: each ends where a token closes a word."""
        ids = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self.code_each(words)
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]

    def add(self, distinct: list[str]) -> None:
        if len(self.new) > self.rows:
            self.old, self.new = self.new, {}
        new, old, missing = self.new, self.old, []
        for word in distinct:
            if word not in new:
                if (ids := old.get(word)) is None:
                    missing.append(word)
                else:
                    new[word] = ids
        cores = {w: c for w in missing if (c := w.rstrip(".,")).isalpha() and (c.isascii() or c.lower().isalpha())}
        letters = list({c for c in cores.values() if c not in new})
        others = [w for w in {w[len(c) :] for w, c in cores.items()}.union(missing).difference(cores) if w not in new]
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            new.update(zip(part, self.code_letters(part), strict=True))
        if others:
            new.update(zip(others, self.code_each(others), strict=True))
        for word, core in cores.items():
            if word != core:
                new[word] = new[core] + new[word[len(core) :]]

    def encode(self, texts: pa.Array) -> list[bytes]:
        # The vocabulary's normaliser lower-cases; only its special tokens, matched before that, tell cases apart.
        plain = pc.ascii_lower(texts)
        special = pc.any(pc.match_substring(plain, "<|")).as_py()
        offsets, number, distinct = distinct_words(texts if special else plain, newline=True)
        self.add(distinct)
        coded = [*map(self.new.__getitem__, distinct)]
        ids = np.frombuffer(b"".join(coded), "<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begin = np.cumsum(size) - size
        run = size[number]
        place = np.cumsum(run) - run
        flat = ids[np.repeat(begin[number] - place, run) + np.arange(int(run.sum()))]
        at = np.concatenate([[0], np.cumsum(run)])[offsets].tolist()
        data = flat.tobytes()
        return [data[4 * i : 4 * j] for i, j in zip(at, at[1:], strict=False)]


def pieces(docs: DataFrame, text: str = "text", model: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length and the crc32 of its ids."""
    path = model or tokenizer_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = WordTable(path), np.array([end_id], "<u4").tobytes()
        for batch in (part for whole in batches for part in text_slices(whole, text, STEP_BYTES)):
            rows = []
            coded = known.encode(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del known
        give_back()

    return docs.select("doc_id", text).mapInArrow(run, PIECES)


class BestFit:
    """Open bins by free room; the fullest bin with room enough is found in a bit mask of occupied rooms."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.mask, self.bins = capacity, {}, 0, 0

    def place(self, size: int) -> int:
        fitting = self.mask >> size << size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1
            stack = self.open[room]
            bin_id = stack.pop()
            if not stack:
                self.mask ^= 1 << room
        else:
            room, bin_id = self.capacity, self.bins
            self.bins += 1
        left = room - size
        self.open.setdefault(left, []).append(bin_id)
        self.mask |= 1 << left
        return bin_id


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item, best-fit by decreasing size."""
    fit, out = BestFit(capacity), np.empty(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        out[k] = fit.place(int(sizes[k]))
    return out


BINS = "used bigint, parts array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def _pack_round(bins: DataFrame, capacity: int) -> DataFrame:
    """Bins of each partition packed again as items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        used = got.column("used").to_numpy()
        number = pack_sizes(used, capacity)
        order = np.argsort(number, kind="stable")
        parts = got.column("parts").combine_chunks()
        parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
        parts = parts.take(pa.array(order))
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        lengths = np.diff(parts.offsets.to_numpy())
        sizes = np.add.reduceat(lengths, first)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        merged = pa.ListArray.from_arrays(offsets, parts.flatten())
        yield from pa.table({"used": np.add.reduceat(used[order], first), "parts": merged}).to_batches(max_chunksize=2000)

    return bins.mapInArrow(run, BINS)


def _placed(bins: DataFrame) -> DataFrame:
    """One row per part of a bin, with the sum of the lengths before it in its bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            flat, ends = parts.flatten(), np.diff(parts.offsets.to_numpy())
            length = flat.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(length) - length
            first = np.repeat(np.cumsum(ends) - ends, ends)
            columns = [flat.field(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            numbers = np.repeat(batch.column("sequence_id").to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers), pa.array(before - before[first] if len(first) else before)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return bins.mapInArrow(run, f"{PIECES}, sequence_id bigint, offset bigint")


def pack(items: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, group_bins: int = GROUP_BINS) -> DataFrame:
    """items: doc_id, piece, start, length (1 to capacity), ids_crc32. Adds sequence_id and offset."""
    items = cut_lineage(items.select("doc_id", "piece", "start", "length", "ids_crc32"))
    full = items.where(F.col("length") == capacity)
    rest = items.where(F.col("length") < capacity)
    as_bin = lambda df: df.select(F.col("length").alias("used"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("parts"))
    count = rest.count()
    groups = max(1, -(-count // group_bins))
    done, live, turn = [as_bin(full)], as_bin(rest), 0
    while count:
        spread = live.repartition(groups, F.xxhash64(F.col("parts")[0]["doc_id"], F.col("parts")[0]["piece"], F.lit(turn)))
        packed = cut_lineage(_pack_round(spread, capacity))
        least = packed.agg(F.min("used").alias("least"), F.count("*").alias("n")).first()
        still = packed.where(F.col("used") <= capacity - least["least"])
        done.append(packed.where(F.col("used") > capacity - least["least"]))
        last = groups == 1 or least["n"] == count
        count, live, turn = still.count(), still, turn + 1
        if last:
            done.append(still)
            break
        groups = max(1, -(-groups // fan_in), -(-count // group_bins))
    bins = functools.reduce(DataFrame.unionByName, done)
    numbered = bins.withColumn("sequence_id", F.monotonically_increasing_id())
    return _placed(numbered.select("sequence_id", "parts"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", F.col("text"))))
