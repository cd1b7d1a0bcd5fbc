"""Quality rules and language codes: held-out accuracy, compiled against plain scores, odd input."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sessionloom.llm import language_id, quality


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = quality.op1_quality(spark, sf_dir)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = df.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_rules_compile_to_the_plain_score(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "bb!", "Ccc", "9|", "dédé"], rng.integers(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rated = quality.with_statistics(docs).orderBy("doc_id").toPandas()
    x = rated[[f"s_{s}" for s in quality.STATS]].to_numpy()
    y = (x[:, quality.STATS.index("bang")] > 0.08).astype(float)
    model = quality.fit(x, y)
    got = quality.score(docs, model).orderBy("doc_id").toPandas()
    assert model.rules and np.allclose(got["score"], model.score(x))
    assert ((got["score"] >= 0.5) == (y == 1)).mean() > 0.95


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "good", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "w " * 200_000, "x")], "doc_id long, text string, score string")
    rows = quality.score(docs, quality.fit_labels(docs.drop("score"), labels)).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1  # one class: the smoothed share
    assert abs(rows[0].score - 2 / 3) < 1e-9
    assert quality.score(docs.limit(0), quality.fit(np.zeros((0, len(quality.STATS))), np.zeros(0))).count() == 0


def plain_statistics(text: str) -> list[float]:
    """The statistics by their definition, character by character."""
    data = text.encode()
    if not data:
        return [0.0] * len(quality.STATS)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))) if w]
    n, plain = max(1, len(words)), b".,;:?'\"-"
    share = lambda kind: sum(map(kind, data)) / len(data)
    return [
        len(data), len(words), data.count(b"\n") + 1,
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in plain),
        share(lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in plain), share(lambda b: b == 32 or 9 <= b <= 13), share(lambda b: b >= 128),
        sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, sum(len(w) < 4 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, share(lambda b: b == ord("|")), share(lambda b: b == ord("!")),
        max(Counter(words).values(), default=0) / n,
    ]


def test_statistics_follow_their_definition(spark, sf_dir):
    odd = [None, "", " ", "A", "aa Aa\tbb", "| ! |", "é\u00a0ü x", "w " * 3000]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 0").collect()] + odd
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for row in quality.with_statistics(docs).collect():
        assert np.allclose([row[f"s_{s}"] for s in quality.STATS], plain_statistics(texts[row.i] or "")), texts[row.i]


def test_language_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = language_id.op9_language(spark, sf_dir)
    assert df.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rows = df.join(docs, "doc_id").where(F.col("held_out") & F.col("text").isNotNull()).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95


def plain_counts(texts: list[str]) -> dict[bytes, dict[int, int]]:
    counts: dict[bytes, dict[int, int]] = {}
    for t in (t.encode() for t in texts):
        for i, b in enumerate(t):
            for order in range(min(3, i) + 1):
                counts.setdefault(t[i - order : i], {}).setdefault(b, 0)
                counts[t[i - order : i]][b] += 1
    return counts


def plain_bits(counts: dict[bytes, dict[int, int]], text: bytes) -> float:
    """Code length by the definition: longest context first, escapes with exclusion."""
    bits = 0.0
    for i, b in enumerate(text):
        excluded: set[int] = set()
        for order in range(min(3, i), -1, -1):
            seen = {k: v for k, v in counts.get(text[i - order : i], {}).items() if k not in excluded}
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if b in seen:
                bits -= np.log2(seen[b] / (total + distinct))
                break
            bits -= np.log2(distinct / (total + distinct))
            excluded |= set(seen)
        else:
            bits += np.log2(256 - len(excluded))
    return bits


def test_code_lengths_follow_the_definition():
    texts = {"a": ["abracadabra abra", "cab"], "b": ["banana band", "nab"]}
    model, counts = language_id.train(texts), {l: plain_counts(t) for l, t in texts.items()}
    for text in ("abra", "ban", "a", "zz top", "cabana banda abracadabra"):
        data = np.frombuffer(text.encode(), np.uint8)
        got = language_id.code_lengths(model, data, np.array([0, len(data)]))[0]
        assert np.allclose(got, [plain_bits(counts[l], text.encode()) for l in "ab"])


def test_the_query_follows_the_definition(spark):
    """Whole documents against the definition: over 10,000 contexts, predictions and bits a byte of the registered query."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample: dict[str, list[str]] = {}
    for row in language_id.training_sample(docs.where(~language_id.held_out(F.col("doc_id")))).collect():
        sample.setdefault(row.lang, []).append(row.text)
    counts = {l: plain_counts(t) for l, t in sorted(sample.items())}
    assert sum(map(len, counts.values())) > 10_000
    got = {r.doc_id: r for r in language_id.op9_language(spark, sf_dir).collect()}
    short = [r for r in docs.where("length(text) < 1500 and doc_id % 3 = 0").collect() if any(c.isalpha() for c in r.text)]
    assert len(short) > 20
    for row in short:
        bits = {l: plain_bits(c, row.text.encode()) for l, c in counts.items()}
        best = min(bits, key=bits.get)
        assert got[row.doc_id].lang_pred == best
        assert abs(got[row.doc_id].bits_per_byte - bits[best] / len(row.text.encode())) < 1e-9
        assert abs(got[row.doc_id].score - 1 / sum(2 ** ((bits[best] - b) / language_id.SCORE_BITS) for b in bits.values())) < 1e-9


def test_language_of_odd_rows(spark):
    rows = [(1, "abra cadabra", "a"), (2, "banana band", "b"), (3, None, "a"), (4, "", None), (5, "123 !", "b"), (6, "ab " * 300_000, None), (6, "ab " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(language_id.training_sample(docs))
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).orderBy("doc_id").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "und"), (4, "und"), (5, "und"), (6, "a"), (6, "a")]
    none = language_id.fit(language_id.training_sample(docs.limit(0)))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0
    clash = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    again = language_id.predict(clash, model, keep_text=True)
    assert again.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits_per_byte"]
    assert [(r.doc_id, r.lang_pred) for r in again.orderBy("doc_id").collect()] == got
