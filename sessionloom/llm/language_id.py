"""Language identification by prediction by partial matching under frozen statistics.

Per language a context tree of bytes holds the counts of every symbol after the contexts of 0 to 3 bytes seen in the
training sample, without a limit on contexts. The probability of a byte is that of its longest context; an unseen byte
costs the context's escape (distinct symbols / (count + distinct symbols)) and falls to the next shorter context without
the symbols that the longer one has excluded, and at last to an equal share of the byte values left. Code length = sum of
-log2 of these; it is exact.

A tree is held as sorted keys (length and bytes of each n-gram seen), so its size follows the n-grams seen and neither the
alphabet nor the other languages: 16 bytes an n-gram and 48 bytes a context, so a language with 20,000 n-grams and 5,000
contexts takes 0.6 MB and a hundred of them 60 MB. As a symbol seen after a context was seen after every shorter one, what a context excludes
below is its own symbols alone; each context therefore keeps the sums of its chain of escapes, and a byte's cost is a
few look-ups. Texts are scored by their different n-grams of 4 bytes, each of which is looked up once a slice.

Training takes a bounded sample: about SAMPLE_DOCS whole texts of each language, picked by a hash of the id; n-grams are
counted in the tasks, and only counts come to the driver. ``und`` is the answer for null texts and texts without a letter
(then score 0), empty ones among them. A tie goes to the language first in alphabetic order. With no training rows every
text is ``und``; an empty table gives an empty one. Score is the share of the predicted language when each language weighs
2 ** (-code length / SCORE_BITS). Texts of any length are scored whole. Repeated rows get equal answers; result columns
replace columns of the same name, other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, flat_bytes, give_back, table, text_slices

SAMPLE_DOCS = 400
ORDER = 3
#: Bits of difference that halve a language's weight in the score.
SCORE_BITS = 16.0
_LENGTH = 32  # an n-gram's key is its length above this bit and its bytes below, the last byte lowest


@dataclass
class Tree:
    """One language. grams and bits: sorted keys of n-grams (1 to 4 bytes) and log2 of their counts. contexts: sorted keys
    (0 to 3 bytes), and for each the bits of its total and its escape, those of the next shorter context without its
    symbols, the sum of all escapes below it, and the place of the next shorter context."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    escape: np.ndarray
    below: np.ndarray
    chain: np.ndarray
    shorter: np.ndarray
    symbols: int


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


def _shorter(keys: np.ndarray) -> np.ndarray:
    """Key of the n-gram without its first byte."""
    length = keys >> _LENGTH
    return ((length - 1) << _LENGTH) | (keys & ((1 << (8 * (length - 1))) - 1))


def gram_keys(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Keys of all n-grams of this length that lie inside one text."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for k in range(length):
        code = code << 8 | data[k : k + n]
    start = np.repeat(offsets[:-1], np.diff(offsets))
    return code[start[length - 1 :] <= np.arange(n)] | length << _LENGTH


def build_tree(grams: np.ndarray, counts: np.ndarray) -> Tree:
    """grams: sorted keys of all n-grams of 1 to ORDER + 1 bytes, with their counts."""
    length = grams >> _LENGTH
    owner = (length - 1) << _LENGTH | (grams & ((1 << _LENGTH) - 1)) >> 8
    contexts, place = np.unique(owner, return_inverse=True)
    total = np.bincount(place, counts, len(contexts))
    distinct = np.bincount(place, minlength=len(contexts)).astype(np.float64)
    longer = length > 1
    same_below = counts[np.searchsorted(grams, _shorter(grams[longer]))]
    taken = np.bincount(place[longer], same_below, len(contexts))
    shorter = np.zeros(len(contexts), np.int64)
    deep = np.flatnonzero(contexts >> _LENGTH > 0)
    shorter[deep] = np.searchsorted(contexts, _shorter(contexts[deep]))
    left, kinds = total[shorter] - taken, distinct[shorter] - distinct
    with np.errstate(divide="ignore", invalid="ignore"):
        below = np.where(left > 0, np.log2(left + kinds), 0.0)
        fall = np.where(left > 0, below - np.log2(kinds), 0.0)
    below[0] = fall[0] = 0.0
    chain = np.zeros(len(contexts))
    for order in range(1, ORDER + 1):
        at = np.flatnonzero(contexts >> _LENGTH == order)
        chain[at] = fall[at] + chain[shorter[at]]
    bits = np.log2(total + distinct)
    return Tree(grams, np.log2(counts), contexts, bits, bits - np.log2(distinct), below, chain, shorter, int(distinct[0]))


def count_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(gram_keys(data, offsets, n), return_counts=True) for n in range(1, ORDER + 2)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def train(texts: dict[str, list[str]]) -> Model:
    """From whole texts of each language, without Spark."""
    trees = {}
    for language in sorted(texts):
        data, offsets = flat_bytes(pa.array(texts[language], pa.string()))
        if len(data):
            trees[language] = build_tree(*count_grams(data, offsets))
    return Model(list(trees), list(trees.values()))


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def gram_costs(tree: Tree, keys: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each n-gram after the bytes before it."""
    length, code = keys >> _LENGTH, keys & ((1 << _LENGTH) - 1)
    longest, deepest = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # place of the longest context seen, its order
    held, level = np.zeros(len(keys)), np.full(len(keys), -1)  # bits of the count where the byte was seen, order of that context
    for order in range(ORDER + 1):
        rows = np.flatnonzero(length > order)
        at, seen = _place(tree.contexts, order << _LENGTH | code[rows] >> 8 & ((1 << 8 * order) - 1))
        longest[rows[seen]], deepest[rows[seen]] = at[seen], order
        at, seen = _place(tree.grams, (order + 1) << _LENGTH | code[rows] & ((1 << 8 * (order + 1)) - 1))
        held[rows[seen]], level[rows[seen]] = tree.bits[at[seen]], order
    out = tree.escape[longest] + tree.chain[longest] + np.log2(max(1, 256 - tree.symbols))
    hit = level == deepest
    out[hit] = tree.total[longest[hit]] - held[hit]
    above, at = longest.copy(), np.flatnonzero((level >= 0) & ~hit)
    for _ in range(ORDER):  # the context one longer than the one that has the byte
        step = at[deepest[at] > level[at] + 1]
        above[step] = tree.shorter[above[step]]
        deepest[step] -= 1
    out[at] = tree.escape[longest[at]] + tree.chain[longest[at]] - tree.chain[above[at]] + tree.below[above[at]] - held[at]
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language; a text's first bytes have the shorter contexts that they have."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(data):
        return out
    before = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)), ORDER)
    keys = data.astype(np.int64)
    for k in range(1, ORDER + 1):
        rows = np.flatnonzero(before >= k)
        keys[rows] |= data[rows - k].astype(np.int64) << 8 * k
    keys, number = np.unique(keys | before + 1 << _LENGTH, return_inverse=True)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    for k, tree in enumerate(model.trees):
        out[filled, k] = np.add.reduceat(gram_costs(tree, keys)[number], offsets[:-1][filled])
    return out


def training_sample(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_DOCS) -> DataFrame:
    """About per_language whole texts of each language, by a hash of the key; a count a language comes to the driver."""
    labelled = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not sizes:
        return labelled.limit(0).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, per_language / n))])
    unit = (F.xxhash64(key) % 1_000_003 + 1_000_003) % 1_000_003 / F.lit(1_000_003.0)
    return labelled.where(unit < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def fit(sample: DataFrame) -> Model:
    """sample: lang, text. N-grams are counted in the tasks; their counts make the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text")):
            names = batch.column("lang")
            for name in pc.unique(names):
                grams, counts = count_grams(*flat_bytes(batch.column("text").filter(pc.equal(names, name))))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
        give_back()

    counted = sample.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    trees = {}
    for language in sorted(pc.unique(counted.column("lang")).to_pylist()):
        own = counted.filter(pc.equal(counted.column("lang"), language)).sort_by("gram")
        trees[language] = build_tree(own.column("gram").to_numpy(), own.column("n").to_numpy())
    return Model(list(trees), list(trees.values()))


RESULTS = [("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double")]


def verdict_column(spark, model: Model, text: str = "text"):
    """Struct of RESULTS for a text column; only the text goes to Python, the row stays where it is."""
    sent = spark.sparkContext.broadcast(model)  # n-grams of the bounded sample

    def judge(texts: pa.Array) -> pa.Array:
        known = sent.value
        data, offsets = flat_bytes(texts)
        size = np.diff(offsets)
        letter = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False), bool)
        if not known.languages:
            letter[:] = False
        best, score, rate = np.full(len(size), len(known.languages)), np.zeros(len(size)), np.full(len(size), np.nan)
        if letter.any():
            bits = code_lengths(known, data, offsets)[letter]
            pick = bits.argmin(1)
            least = bits[np.arange(len(bits)), pick]
            best[letter], rate[letter] = pick, least / size[letter]
            score[letter] = 1 / np.exp2((least[:, None] - bits) / SCORE_BITS).sum(1)
        names = np.array([*known.languages, "und"], object)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(rate, mask=~letter)], names=[n for n, _ in RESULTS])

    @F.arrow_udf(", ".join(f"{n} {t}" for n, t in RESULTS))
    def verdict(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            parts = [judge(part.column(0)) for part in text_slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
            yield pa.concat_arrays(parts) if parts else judge(texts)
        give_back()

    return verdict(F.col(text))


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte (of the predicted language; null where ``und``)."""
    keep = [c for c in docs.columns if c not in dict(RESULTS) and (c != text or keep_text)]
    rated = docs.withColumn("_verdict", verdict_column(docs.sparkSession, model, text))
    return rated.select(*keep, "_verdict.*")


def held_out(column):
    return crc_mod(column, 4) == 2


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_sample(docs.where(~held_out(F.col("doc_id")))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
