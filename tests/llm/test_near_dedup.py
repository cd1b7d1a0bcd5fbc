"""Near-duplicates against all pairs, on the driver's documents and on crowded groups of copies."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from test_components import searched

from sessionloom.llm import near_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(size)), strict=False))


def brute(rows, size):
    sets = {}
    for i, text in rows:
        sets[i] = shingles(text, size)
    ids, edges = sorted(sets), []
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    edges.append((i, j))
    reach = searched(edges)
    return {i: (len(sets[i]), reach.get(i, i)) for i in ids}


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("size", [2, 5])
def test_documents(spark, sf_dir, size):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert result(near_dedup.near_duplicates(docs, size=size)) == brute([tuple(r) for r in docs.collect()], size)


def test_query(spark, sf_dir):
    df = near_dedup.op2_near_dedup(spark, sf_dir)
    assert df.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]


def changed(words, rng, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


def test_crowded_groups(spark, monkeypatch):
    """Small bounds make groups crowded: strangers meet in blocks; chains of copies drift apart."""
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(3):
        base = rng.choices(vocabulary, k=120)
        for _ in range(40):
            rows.append(" ".join(changed(base, rng, rng.choice([0, 0.02, 0.05, 0.08]))))
        drift = base
        for _ in range(15):
            drift = changed(drift, rng, 0.03)
            rows.append(" ".join(drift))
    shared = rng.choices(vocabulary, k=60)
    rows += [" ".join(rng.choices(vocabulary, k=70) + shared) for _ in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dedup.near_duplicates(docs, size=2)) == brute(rows, 2)


def test_nulls_empty_ties_and_extra_columns(spark):
    long = "word " * 50_000
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "one", 4), (5, "ONE", 5), (6, "É one", 6), (7, "é one", 7), (8, long, 8), (9, long + "word", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = result(near_dedup.near_duplicates(docs, size=2))
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 8), 9: (1, 8)}


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_of_earlier_steps_go(spark, sf_dir):
    """Only what the result reads stays in the checkpoint folder (F1)."""
    place = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = lambda: {s.getPath().toString() for s in path(place.get()).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path(place.get()))} if place.isDefined() else set()
    before = folders()
    found = near_dedup.op2_near_dedup(spark, sf_dir)
    place = spark.sparkContext._jsc.sc().getCheckpointDir()
    assert len(folders() - before) <= 4
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_lists_take_a_sketch_s_rarest_values(spark):
    """Counts of all values order a sketch, not those of the commonest only; a value of one sketch makes no list (F1)."""
    sketches = [(1, [1, 2, 3, 40, 41]), (2, [1, 2, 3, 50, 51]), (3, [1, 2, 60, 61, 62]), (4, [1, 70, 71, 72, 73])]
    sets = spark.createDataFrame([(k, k, 5, own) for k, own in sketches], "row long, doc_id long, n_shingles long, sketch array<bigint>")
    found = near_dedup._lists(sets, 5, 4)  # of 5 values, 4 of them shared by similar sets, all 5 - 4 + 3 first ones
    assert sorted((r.doc_id, r.value) for r in found.collect()) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 2)]
    assert {r.doc_id: r.score for r in found.collect()} == {1: (4 + 3 + 2 + 2) / 5, 2: (4 + 3 + 2 + 2) / 5, 3: (4 + 3 + 3) / 5}


def test_many_members_in_short_lists_are_not_crowded(spark, monkeypatch):
    """Texts that each share a passage of their own with one long text: no list is long, so no full sets are compared in blocks (F1)."""
    rng = random.Random(9)
    parts = [[f"p{k}w{i}" for i in range(12)] for k in range(60)]
    rows = [(0, " ".join(w for p in parts for w in p))] + [(k, " ".join([f"o{k}w{rng.randrange(10**6)}" for _ in range(4)] + parts[k - 1])) for k in range(1, 61)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "CROWD", 8)
    monkeypatch.setattr(near_dedup, "_hot_links", lambda *_: pytest.fail("compared in blocks"))
    assert result(near_dedup.near_duplicates(docs, size=2, k=2048)) == brute(rows, 2)


def test_crowds_that_share_a_passage_send_few_full_sets(spark, monkeypatch):
    """Of a crowd only rows with a partner in size and sketch are compared on full sets (F1)."""
    rng = random.Random(11)
    passages = [[f"p{k}w{i}" for i in range(20)] for k in range(8)]
    own = lambda: [f"o{rng.randrange(10**6)}" for _ in range(10)]
    rows = [" ".join([w for p in chosen for w in p] + own()) for chosen in itertools.combinations(passages, 3)]
    rows = list(enumerate([*rows, rows[3] + " more", rows[7] + " more"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    seen, dealt = {}, near_dedup._in_blocks
    monkeypatch.setattr(near_dedup, "_in_blocks", lambda df, most, *columns: seen.update({columns[-1]: df.select("doc_id").distinct().count()}) or dealt(df, most, *columns))
    assert result(near_dedup.near_duplicates(docs, size=2, k=24, least_shared=18)) == brute(rows, 2)
    assert seen["sketch"] > 40 and seen["full"] < 20, seen
