"""SentencePiece encoding and decoding through a table of distinct chunks.

In the model's normal form a space is the marker U+2581. No piece of the vocabulary holds a marker after another
character, so no merge crosses from a chunk (a run of markers and what follows up to the next run) into the next one.
Each task therefore segments every distinct chunk once, keeps its ids and its decoded text in a table, and joins them
back by position in the text. ``chunkable`` checks the vocabulary and the normaliser; a model that fails the check is
encoded text by text.

Null text counts as empty: its only id is the end id and it decodes to the empty string. An empty table gives an empty one;
a text of any length is encoded whole, in memory that follows the longest text of a step. Ties cannot occur (a chunk has
one segmentation); repeated rows give repeated results; extra columns are carried through, except those with the name of
a result column, which the result replaces.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_words, give_back, text_slices, tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct chunks that a task keeps before it starts its table anew; the table goes with the task.
TABLE_ROWS = 250_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts in which splitting at single spaces does not give the chunks.
_ODD = f"{MARK}|  |^ | $|^$"
#: Bytes of text between two look-ups in the table.
STEP_BYTES = 3 << 20


@functools.lru_cache(2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def chunkable(path: str) -> bool:
    """Whether pieces stay inside chunks: plain normaliser with a leading marker, no piece with an inner marker."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    inner = any(MARK in piece.piece.lstrip(MARK) or (piece.type == 4) for piece in model.pieces)
    return bool(plain and not inner)


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker."""
    return [part[1:] for part in _CHUNK.findall(MARK + text.replace(" ", MARK))]


class ChunkTable:
    """Distinct chunk -> its ids as decimal text, and its decoded text. Two bounded generations: what the older one holds
    moves to the newer one when it is met again, so frequent chunks stay."""

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        self.model, self.rows, self.whole = processor(path), rows, not chunkable(path)
        self.new: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def add(self, distinct: set[str]) -> None:
        missing = distinct.difference(self.new)
        if len(self.new) + len(missing) > self.rows:
            self.old, self.new, missing = self.new, {}, distinct
        if kept := missing.intersection(self.old):
            self.new.update((chunk, self.old[chunk]) for chunk in kept)
        unseen = list(missing.difference(self.old))
        coded = self.model.encode([chunk.replace(MARK, " ") for chunk in unseen], num_threads=1) if unseen else []
        for chunk, ids, text in zip(unseen, coded, self.model.decode(coded, num_threads=1) if unseen else [], strict=True):
            self.new[chunk] = " ".join(map(str, ids)), text
        if "" in missing:  # a marker by itself
            self.new[""] = str(self.model.piece_to_id(MARK)), ""

    def encode(self, texts: pa.Array) -> list[tuple[str, str]]:
        """For each text the decimal ids joined by spaces (no end id), and the text decoded from them."""
        if self.whole:
            coded = self.model.encode([text or "" for text in texts.to_pylist()], num_threads=1)
            return [(" ".join(map(str, ids)), self.model.decode(ids)) for ids in coded]
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD))
        special = {int(k): chunks(text) if (text := texts[int(k)].as_py()) else [] for k in odd}
        offsets, number, distinct = distinct_words(texts)
        self.add(set(distinct).union(*special.values()))
        found = [*map(self.new.__getitem__, distinct)]
        ids, plain = (np.array([row[k] for row in found], object).take(number).tolist() for k in (0, 1))
        out = []
        for k, (low, high) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
            if k in special:
                row = [*map(self.new.__getitem__, special[k])]
                out.append((" ".join([x for x, _ in row]), " ".join([x for _, x in row])))
            else:
                out.append((" ".join(ids[low:high]), " ".join(plain[low:high])))
        return out


def encode_digests(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """Encode and decode every text; adds n_tokens, ids_sha256 and decoded_sha256 (of decimal ids, and of UTF-8 text)."""
    path = model or tokenizer_path(MODEL)
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    keep = [c for c in docs.columns if c not in added and c != text]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, kind) for c, kind in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = ChunkTable(path), str(processor(path).eos_id())
        for batch in (part for whole in batches for part in text_slices(whole, text, STEP_BYTES)):
            counts, ids_hash, text_hash = [], [], []
            for ids, decoded in known.encode(batch.column(text)):
                ids = f"{ids} {end}" if ids else end
                counts.append(ids.count(" ") + 1)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            arrays = [batch.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added])
        del known
        give_back()

    return docs.select(*keep, text).mapInArrow(run, schema)


def encode_ids(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """Each row with ids (array of int, end id last) and decoded text."""
    path = model or tokenizer_path(MODEL)
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = ChunkTable(path), processor(path).eos_id()
        for batch in (part for whole in batches for part in text_slices(whole, text, STEP_BYTES)):
            coded = known.encode(batch.column(text))
            ids = pa.array([[*map(int, part.split()), end] for part, _ in coded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [ids, pa.array([t for _, t in coded], pa.string())], names=[*keep, "ids", "decoded"])
        del known
        give_back()

    return docs.select(*keep).mapInArrow(run, schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_digests(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))
