"""Embedding links against all pairs, and the pipeline's stages on planted documents."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_components import searched
from test_models import plain_bits, plain_counts, plain_statistics
from tokenizers import Tokenizer

import corpus_pipeline
from sessionloom.llm import embedding_dedup, packing, quality


def brute(ids, vectors, cosine=0.95):
    good = [k for k, v in enumerate(vectors) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    edges, links = [], dict.fromkeys(ids, 0)
    for n, i in enumerate(good):
        for j in good[:n]:
            if len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    edges.append((ids[i], ids[j]))
                    links[ids[i]] += 1
                    links[ids[j]] += 1
    reach = searched(edges)
    return {i: (links[i], reach.get(i, i)) for i in ids}


@pytest.mark.parametrize("block_rows,pivots", [(2048, 2048), (16, 8)])
def test_links_equal_all_pairs(spark, block_rows, pivots):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.3])).astype(np.float32).tolist() for _ in range(260)]
    rows += [rows[0]] * 30 + [None, [], [0.0] * 16, [None, *rows[1][1:]], [float("nan"), *rows[1][1:]], [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, kept long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, block_rows=block_rows, pivots=pivots).collect()}
    assert got == brute(list(range(len(rows))), rows)


@pytest.mark.parametrize("dim", [64, 256])
def test_links_of_near_copies_at_the_limit(dim):
    """Radii cover their points, and nodes of near copies keep every partner just above the limit."""
    rng = np.random.default_rng(3)
    points = []
    for _ in range(60):
        centre = embedding_dedup.unit(rng.normal(size=(1, dim)))[0]
        aside = rng.normal(size=dim)
        aside = embedding_dedup.unit((aside - (aside @ centre) * centre)[None, :])[0]
        tilt = np.arccos(0.95) + 2.5e-4 + rng.uniform(-1e-5, 1e-5, 4)
        points += [centre, *(centre * np.cos(t) + aside * np.sin(t) for t in rng.uniform(1e-4, 3e-4, 8))]
        points += [centre * np.cos(t) + aside * np.sin(t) for t in tilt]
    u = embedding_dedup.unit(np.array(points))
    node, radius = embedding_dedup.cover_tree(u)
    for own, far in zip(node, radius):
        assert (np.linalg.norm(u - u[own], axis=1) <= far[own] + 1e-7).all()
    tree = embedding_dedup.Block.unpacked(embedding_dedup.Block(np.arange(len(u)), np.ones(len(u), np.int64), u).packed())
    i, j, ranges = embedding_dedup.dual_links(tree, tree, True, 0.95)
    pairs = set(zip(i.tolist(), j.tolist()))
    for a, n, b, m in ranges.tolist():
        pairs |= {(min(p, q), max(p, q)) for p in range(a, a + n) for q in range(b, b + m) if p != q}
    cosines = np.einsum("ij,kj->ik", tree.x, tree.x) / np.outer(np.linalg.norm(tree.x, axis=1), np.linalg.norm(tree.x, axis=1))
    sure = {(p, q) for p, q in zip(*np.nonzero(cosines >= 0.95 + 1e-12)) if p < q}
    assert sure <= pairs <= {(p, q) for p, q in zip(*np.nonzero(cosines >= 0.95 - 1e-12)) if p < q}
    links, least = embedding_dedup.tally(tree.ids, tree.copies, i, j, ranges)
    assert links.sum() == 2 * len(pairs)


def test_every_length_is_compared(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dim in range(2, 90):
        one = rng.normal(size=dim)
        rows += [one.tolist(), (one + 1e-3).tolist()]
    rows += [rng.normal(size=70).tolist() for _ in range(3)]
    many = rng.normal(size=(6, 5))
    rows += [(many[rng.integers(6)] + rng.normal(size=5) * 0.2).tolist() for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, block_rows=16, pivots=8).collect()}
    assert got == brute(list(range(len(rows))), rows) and all(got[i][0] for i in range(2 * 88))


def test_repeated_ids_with_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, None), (1, [0.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True)]


def test_a_crowd_is_counted_by_ranges(spark):
    """Near copies in several blocks: all link, most of them without a look at the pair."""
    rng = np.random.default_rng(2)
    rows = [(np.ones(8) + rng.normal(size=8) * 0.004).tolist() for _ in range(400)] + [rng.normal(size=8).tolist() for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, block_rows=64, pivots=4).collect()}
    assert got == brute(list(range(500)), rows)


def test_driver_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    df = embedding_dedup.op10_embedding_dedup(spark, sf_dir)
    assert df.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    assert {r.vec_id: (r.n_links, r.component_id) for r in df.collect()} == brute([r.vec_id for r in table], [r.embedding for r in table])


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    extra = docs.limit(4).select((F.col("doc_id") + 900_000).alias("doc_id"), F.lit("12 34 !!").alias("text"), "lang", "source", "n_chars")
    kept = corpus_pipeline.identify_language(spark, docs.union(extra), sf_dir).cache()
    assert kept.columns == docs.columns and kept.where("doc_id >= 900000").count() == 0
    assert kept.count() >= 0.99 * docs.where(F.col("text").rlike("\\p{L}")).count()
    good = corpus_pipeline.classify_quality(spark, kept, sf_dir).cache()
    judged = labels.join(kept.select("doc_id"), "doc_id").join(good.select("doc_id", F.lit(1).alias("in")), "doc_id", "left").collect()
    assert good.columns == docs.columns
    assert np.mean([(r["in"] == 1) == (r.quality == 1) for r in judged]) >= 0.9
    single = corpus_pipeline.drop_near_duplicates(spark, good, sf_dir).cache()
    assert single.columns == docs.columns and 0 < single.count() < good.count()
    packed = corpus_pipeline.pack_sequences(spark, single, sf_dir)
    assert packed.select("doc_id").distinct().count() == single.count()


def plain_near_duplicates(texts: dict[int, str]) -> set[int]:
    """Ids that stay: the least of each component of pairs with 0.8 or more of five-word shingles in common."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids = sorted(sets)
    near = lambda x, y: 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y))
    edges = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if near(sets[i], sets[j]) and (both := len(sets[i] & sets[j])) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    reach = searched(edges)
    return {i for i in ids if reach.get(i, i) == i}


def test_run_equals_plain_stages(spark):
    """Every stage's decision, made again without Spark from the definition of its method, and the pieces at the end."""
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sample: dict[str, list[str]] = {}
    for r in docs.values():
        if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sample.setdefault(r.lang, []).append(r.text)  # fewer than the sample's bound
    counts = {l: plain_counts(t) for l, t in sorted(sample.items())}
    known = {}
    for i, r in docs.items():
        if r.text and any(c.isalpha() for c in r.text):
            if min(plain_bits(c, r.text[:600].encode()) for c in counts.values()) / len(r.text[:600].encode()) <= corpus_pipeline.MOST_BITS:
                known[i] = r.text
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in known]
    model = quality.fit(np.array([plain_statistics(known[r.doc_id]) for r in labels]), np.array([float(r.quality) for r in labels]))
    good = {i: t for i, t in known.items() if model.score(np.array([plain_statistics(t)]))[0] >= corpus_pipeline.LEAST_QUALITY}
    kept = plain_near_duplicates(good)
    assert len(docs) >= len(known) > len(good) > len(kept) > 100
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path(packing.MODEL)), {}
    for i in kept:
        n = len(tokenizer.encode(good[i], add_special_tokens=False).ids) + 1
        want |= {(i, k): (at, min(2048, n - at)) for k, at in enumerate(range(0, n, 2048))}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length) for r in rows} == want and len(rows) == len(want)
    ends: dict[int, list] = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_odd_rows(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, "12 !", "en"), (None, "the and of", None), (9004, "w " * 200_000, "en"), (9005, "The same words here again and again.", "en")], "doc_id long, text string, lang string")
    extra = [F.lit(k).alias(c) for k, c in enumerate(("score", "s_n_bytes", "lang_pred", "component_id", "length"))]
    docs = some.select("doc_id", "text", "lang").union(odd).union(odd.where("doc_id = 9005")).select("*", *extra)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        rows = stage(spark, docs, sf_dir)
        if name != "packing":
            assert rows.columns == docs.columns
        found = rows.collect()
        if name == "language_id":
            ids = [r.doc_id for r in found]
            assert not {9001, 9002, 9003} & set(ids) and ids.count(9005) == 2
        if name == "packing":
            assert {r.doc_id for r in found} >= {9001, 9002, 9003, 9004, 9005} and sum(r.doc_id == 9005 for r in found) == 2
