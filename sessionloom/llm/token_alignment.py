"""Alignment of two tokenizers: minimal groups of overlapping tokens, their links, and corpus-wide counts of linked ids.

Tokens of A and B that share a byte are linked; the connected components of this bipartite graph, found by union-find, are
exactly the minimal groups between byte offsets where both tokenizers end a token, and a component's members give its links.
Neither tokenizer lets a token cross the place between a character that is no white space and a single space or newline
before another such character, so a text falls into chunks there and each distinct chunk is aligned once a task.

Counting is distributed: a slice of texts (bounded in bytes) sends its distinct id pairs with their numbers once, partial
sums give the corpus-wide counts and each B id's highest, and these come back to the slice, whose row meanwhile keeps
which chunk stands where. So what is shuffled follows the distinct pairs of slices, not the links of texts.

A text that is null or empty, or whose tokens do not give back its bytes, has no tokens and gives zeros. Repeated rows give
rows of their own and count as often as they occur; ties for a B id's highest count are all best; an empty table gives an
empty one; texts are taken whole, however long. Columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, distinct_words, give_back, table, text_slices, tokenizer_path
from .piece_tokens import MARK, processor

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose id pairs are counted together before they are sent.
STEP_BYTES = 4 << 20
#: Distinct chunks that a task keeps before it starts its table anew; the table goes with the task.
TABLE_ROWS = 150_000
#: New chunks that are coded and aligned in one step.
STEP_CHUNKS = 20_000
_PLACE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Texts that are not just words between single spaces or newlines: two kinds of white space in a row, or some at an end.
_ODD = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"{_ODD}{_ODD}|^{_ODD}|{_ODD}$|{MARK}|^$"
FIELDS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint"}
SLICES = "slice bigint, texts binary, pairs array<bigint>, counts array<bigint>"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
GROUPS = "doc_id bigint, groups array<struct<start:bigint,length:bigint,a:array<int>,b:array<int>>>"


@functools.lru_cache(2)
def byte_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return model


@functools.lru_cache(2)
def byte_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary: its characters stand for bytes, printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    names = byte_tokenizer(path).get_vocab()
    out = [b""] * (max(names.values()) + 1)
    for name, k in names.items():
        out[k] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
    return out


@functools.lru_cache(2)
def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each piece: the marker is a space, <0xHH> is that byte."""
    model = processor(path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", name)) else name.replace(MARK, " ").encode() for name in names]


def overlap_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token lengths of A and B over the same bytes -> the links (token of A, token of B), and each token's component,
    numbered in order. Union-find over all links at once: roots hang on the least root they are linked with, then every
    path is halved until it ends, and again while a link joins two roots."""
    end_a, end_b = np.cumsum(a), np.cumsum(b)
    first = np.searchsorted(end_b, end_a - a, side="right")
    many = np.searchsorted(end_b - b, end_a, side="left") - first
    i = np.repeat(np.arange(len(a)), many)
    j = np.repeat(first, many) + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    parent = np.arange(len(a) + len(b))
    while True:
        x, y = parent[i], parent[len(a) + j]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (above := parent[parent])).any():
            parent = above
    number = np.cumsum(parent == np.arange(len(parent))) - 1  # a component's root is its first token of A
    return i, j, number[parent[: len(a)]], number[parent[len(a) :]]


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


class ChunkAlignments:
    """Distinct chunk -> (whole, n_a, n_b, n_groups, groups as text, bytes of linked id pairs). Two bounded generations, as frequent
    chunks stay. The pair of ids a and b is the number b * 2**32 + a."""

    def __init__(self, path_a: str, path_b: str, rows: int = TABLE_ROWS):
        self.a, self.b, self.rows = byte_tokenizer(path_a), processor(path_b), rows
        self.bytes_a, self.bytes_b = byte_tokens(path_a), piece_tokens(path_b)
        self.size_a, self.size_b = (np.array([*map(len, names)]) for names in (self.bytes_a, self.bytes_b))
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def add(self, distinct: list[str]) -> None:
        if len(self.new) > self.rows:
            self.old, self.new = self.new, {}
        new, old, missing = self.new, self.old, []
        for chunk in distinct:
            if chunk not in new:
                if (row := old.get(chunk)) is None:
                    missing.append(chunk)
                else:
                    new[chunk] = row
        for at in range(0, len(missing), STEP_CHUNKS):
            part = missing[at : at + STEP_CHUNKS]
            new.update(zip(part, self.aligned(part, *self.coded(part)), strict=True))

    def coded(self, part: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks; one that begins with a newline has no marker of its own, so the one the library adds goes."""
        of_a = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
        of_b = self.b.encode([chunk[1:] if chunk[0] == " " else chunk for chunk in part], num_threads=1)
        return of_a, [ids if chunk[0] == " " else ids[1:] for chunk, ids in zip(part, of_b, strict=True)]

    def aligned(self, part: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> list[tuple]:
        raw = [chunk.encode() for chunk in part]
        flat_a, flat_b = (np.fromiter((k for ids in of for k in ids), np.int64) for of in (of_a, of_b))
        joined = [b"".join([names[k] for k in flat.tolist()]) for names, flat in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        n_a, n_b = (np.fromiter(map(len, of), np.int64, len(of)) for of in (of_a, of_b))
        held = [_sums(sizes[flat], np.concatenate([[0], np.cumsum(n)])) for sizes, flat, n in ((self.size_a, flat_a, n_a), (self.size_b, flat_b, n_b))]
        if not (joined[0] == joined[1] == b"".join(raw) and (held[0] == size).all() and (held[1] == size).all()):
            whole = [b"".join([self.bytes_a[k] for k in a]) == r == b"".join([self.bytes_b[k] for k in b]) for a, b, r in zip(of_a, of_b, raw, strict=True)]
            rest = iter(self.aligned(*([x for x, ok in zip(column, whole, strict=True) if ok] for column in (part, of_a, of_b))))
            return [next(rest) if ok else (False, 0, 0, 0, "", b"") for ok in whole]
        i, j, in_a, in_b = overlap_groups(self.size_a[flat_a], self.size_b[flat_b])
        chunk_of = np.repeat(np.arange(len(part)), n_a)
        heads = np.flatnonzero(np.diff(in_a, prepend=-1))  # the first A token of each group
        n_groups, n_links = np.bincount(chunk_of[heads], minlength=len(part)), np.bincount(chunk_of[i], minlength=len(part))
        names = [pc.binary_join(_lists(pa.array(flat).cast(pa.string()), np.bincount(within)), ",") for flat, within in ((flat_a, in_a), (flat_b, in_b))]
        texts = pc.binary_join(_lists(pc.binary_join_element_wise(*names, "|"), n_groups), ";").to_pylist()
        pairs, ends = (flat_b[j] << 32 | flat_a[i]).tobytes(), (8 * np.cumsum(n_links)).tolist()
        linked = [pairs[low:high] for low, high in zip([0, *ends], ends, strict=False)]
        return [*zip([True] * len(part), n_a.tolist(), n_b.tolist(), n_groups.tolist(), texts, linked, strict=True)]

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where each text's chunks begin, each chunk's number, the distinct chunks. A null or empty text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        spaced = pc.if_else(odd, "", pc.replace_substring(texts, "\n", " \n"))
        offsets, number, words = distinct_words(spaced)
        # A chunk begins with a space, or with the newline that took its place.
        known = {word if word[:1] == "\n" else f" {word}": k for k, word in enumerate(words)}
        count = np.diff(offsets)
        rows = {}
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            text = texts[int(k)].as_py()
            parts = _PLACE.split(" " + text) if text else []
            rows[int(k)] = [known.setdefault(part, len(known)) for part in parts]
            count[k] = len(parts)
        if rows:
            pieces = np.split(number, offsets[1:-1])
            number = np.concatenate([np.array(rows[k], np.int64) if k in rows else piece for k, piece in enumerate(pieces)] or [number])
        return np.concatenate([[0], np.cumsum(count)]), number, [*known]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    whole = np.concatenate([[0], np.cumsum(values)])
    return whole[offsets[1:]] - whole[offsets[:-1]]


def _packed(value) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(data: bytes):
    return pickle.loads(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))


def slices(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, step_bytes: int = STEP_BYTES) -> DataFrame:
    """One row for each slice of texts: what its texts have by themselves, and its distinct id pairs with their numbers."""
    path_a, path_b = path_a or tokenizer_path(MODEL_A), path_b or tokenizer_path(MODEL_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = ChunkAlignments(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in text_slices(whole, text, step_bytes)):
            offsets, number, distinct = known.split(batch.column(1))
            known.add(distinct)
            rows = [*map(known.new.__getitem__, distinct)]
            whole, n_a, n_b, n_groups = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in range(4))
            size = np.fromiter((len(r[5]) for r in rows), np.int64, len(rows)) // 8
            good = _sums(whole[number], offsets) == np.diff(offsets)
            own = np.array([r[4] for r in rows], object).take(number).tolist()
            digests = ["" if not ok or low == high else hashlib.sha256(";".join(own[low:high]).encode()).hexdigest() for ok, low, high in zip(good.tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False)]
            number = number[np.repeat(good, np.diff(offsets))]
            offsets = np.concatenate([[0], np.cumsum(np.where(good, np.diff(offsets), 0))])
            pairs, which = np.unique(np.frombuffer(b"".join([r[5] for r in rows]), np.int64), return_inverse=True)
            met = np.bincount(number, minlength=len(rows))
            counts = np.bincount(which, np.repeat(met, size), len(pairs)).astype(np.int64)
            stats = [_sums(column[number], offsets) for column in (n_a, n_b, n_groups, size)]
            kept = _packed((batch.column(0).to_pylist(), stats, digests, offsets, number.astype(np.int32), size.astype(np.int32), which.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int64()), "texts": pa.array([kept], pa.binary()), "pairs": pa.array([pairs], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64()))})
            at += 1
        del known
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, SLICES)


def _requests(found: DataFrame) -> DataFrame:
    """slice, k (place in its pairs), pair, n."""
    return found.select("slice", F.posexplode(F.arrays_zip("pairs", "counts")).alias("k", "x")).select("slice", "k", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def pair_counts(found: DataFrame) -> DataFrame:
    """pair (b * 2**32 + a), count over the corpus, best (whether no pair of its B id has more)."""
    counted = _requests(found).where("n > 0").groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = F.shiftright("pair", 32).alias("b")
    highest = counted.groupBy(of_b).agg(F.max("count").alias("highest"))  # a row for each id of B's vocabulary at most
    return counted.withColumn("b", of_b).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _totals(kept: pa.Table, answers: pa.Table) -> pa.Table:
    """Per text of a slice, sums over its links of what the corpus says about their pairs."""
    ids, stats, digests, offsets, number, size, which = _unpacked(kept.column("texts")[0].as_py())
    place = answers.column("k").to_numpy()
    count, best = np.zeros(int(which.max(initial=-1)) + 1, np.int64), np.zeros(int(which.max(initial=-1)) + 1, np.int64)
    count[place], best[place] = answers.column("count").to_numpy(), answers.column("best").to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    sums = [_sums(_sums(values[which], ends)[number], offsets) for values in (best, count)]
    return pa.table([pa.array(ids, pa.int64()), *map(pa.array, (*stats, *sums)), pa.array(digests, pa.string())], names=["doc_id", *FIELDS, "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, step_bytes: int = STEP_BYTES) -> DataFrame:
    """A row for each text: its tokens, groups and links, how many links are best and the sum of their counts."""
    found = cut_lineage(slices(docs, text, path_a, path_b, step_bytes))
    answers = _requests(found).where("n > 0").join(pair_counts(found), "pair").select(F.col("slice").alias("asked_by"), "k", "count", "best")
    return found.select("slice", "texts").groupBy("slice").cogroup(answers.groupBy("asked_by")).applyInArrow(_totals, RESULT)


def groups(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and the groups themselves: first byte in space+text, length in bytes, A ids, B ids."""
    path_a, path_b = path_a or tokenizer_path(MODEL_A), path_b or tokenizer_path(MODEL_B)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkAlignments(path_a, path_b)
        for batch in (part for whole in batches for part in text_slices(whole, text, STEP_BYTES)):
            offsets, number, distinct = known.split(batch.column(1))
            known.add(distinct)
            rows = [*map(known.new.__getitem__, distinct)]
            out = []
            for low, high in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                own, at, listed = [rows[k] for k in number[low:high]], 0, []
                for part in (g for r in own for g in r[4].split(";")) if all(r[0] for r in own) else ():
                    a, b = ([*map(int, ids.split(","))] for ids in part.split("|"))
                    size = int(known.size_a[a].sum())
                    listed.append({"start": at, "length": size, "a": a, "b": b})
                    at += size
                out.append(listed)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "groups"])
        del known
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, GROUPS)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
