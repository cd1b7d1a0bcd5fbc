"""SentencePiece digests and packing against the libraries themselves, text by text."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sessionloom.llm import packing, piece_tokens

ODD = [None, "", " ", "  a  b ", "▁x ▁", "a\n\nb\tc", "\u00a0é\u3000漢字 ", "x" * 5000, "word " * 30_000, "A B a b", "<s> </s> <unk>", "<|endoftext|> <|StartOfText|>", "don't, stop... U.S.A.", "٣٤ 12,5 a,b.c"]


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate([*ODD, *ODD[:4]])]


def test_pieces_equal_the_library(spark, sf_dir):
    rows = texts(spark, sf_dir)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_tokens.MODEL))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_tokens.encode_digests(docs).collect()}
    for i, t in rows:
        ids = model.encode(t or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids)))
    ids = piece_tokens.encode_ids(docs.where("doc_id = 10003")).first()
    assert ids.ids == model.encode("  a  b ", add_eos=True) and ids.decoded == model.decode(ids.ids)


def test_a_small_table_starts_anew(spark):
    known = piece_tokens.ChunkTable(public_tokenizers.path(piece_tokens.MODEL), rows=3)
    import pyarrow as pa

    for _ in range(2):
        for t in ("a b c d e", "e f g a", "a a a"):
            assert known.encode(pa.array([t]))[0][0] == " ".join(map(str, known.model.encode(t)))


def test_packing(spark, sf_dir):
    rows = texts(spark, sf_dir)
    model = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(packing.pieces(docs)).collect()
    pieces = {(r.doc_id, r.piece): r for r in got}
    assert len(pieces) == len(got)
    total = 0
    for i, t in rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part, r = ids[at : at + 2048], pieces.pop((i, k))
            assert (r.start, r.length, r.ids_crc32) == (at, len(part), zlib.crc32(part.tobytes()))
        total += len(ids)
    assert not pieces
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) <= 1.02 * total / 2048 + 1


def test_rounds_merge_groups(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 2049, 3000).tolist()
    items = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], packing.PIECES)
    got = packing.pack(items, group_bins=200, fan_in=2).collect()
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert len(got) == 3000 and max(used.values()) <= 2048
    assert len(used) <= 1.05 * len(set(packing.pack_sizes(np.array(sizes), 2048)))


@pytest.mark.parametrize("group_bins, most", [(40, 1.08), (300, 1.03)])
def test_many_small_groups_come_near_one_group(spark, group_bins, most):
    """Sizes that pair only with few others: the larger the groups, the nearer to what one group over all makes."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(500, 1500, 4000).tolist()
    items = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], packing.PIECES)
    got = packing.pack(items, group_bins=group_bins, fan_in=4).collect()
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert len(got) == len(sizes) and max(used.values()) <= 2048
    assert len(used) <= most * len(set(packing.pack_sizes(np.array(sizes), 2048)))


def test_places_of_many_pieces(spark):
    """A bin of very many pieces is placed in one pass over its lengths."""
    items = spark.range(30_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1L as length", "id as ids_crc32")
    got = packing.pack(items).collect()
    by_bin = {}
    for r in got:
        by_bin.setdefault(r.sequence_id, []).append(r.offset)
    assert len(by_bin) == 15 and all(sorted(v) == list(range(len(v))) for v in by_bin.values()) and len(got) == 30_000


@pytest.mark.parametrize("operator", [lambda d: packing.pack(packing.pieces(d)), piece_tokens.encode_digests])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_word_is_looked_up_once_in_some_megabytes():
    """The words of a batch of 6 MB are looked up in one step, not in three."""
    import pyarrow as pa

    from sessionloom.llm.common import text_slices

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["word " * 400_000] * 3})
    assert len(list(text_slices(batch, "text", packing.STEP_BYTES))) == 1
