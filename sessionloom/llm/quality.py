"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Statistics of a text (shares of byte classes, repetition, lengths) are counted once per text. On a bounded sample of
labelled rows, boosted shallow trees are grown; every path from a root to an inner or leaf node is a conjunctive rule
over the statistics. A lasso logistic regression over the rules' indicators keeps few of them with weights, and the kept
rules are compiled into one Spark column expression: score = 1 / (1 + exp(-(intercept + sum of weights of rules that
hold))). Rows are scored by that expression, inside whole-stage code.

Training reads only the rows it is given, at most about SAMPLE_ROWS of them by a hash of the id (a documented bound).
Null or empty texts have all statistics 0 and are scored like any other row; a text of any length is measured whole. With
no labelled row, or one class only, the score is the smoothed share of label 1; an empty table gives an empty one. Repeated
rows get equal scores (and, in training, all count); columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, crc_mod, flat_bytes, give_back, table, text_slices, words

SAMPLE_ROWS = 12_000
TREES, DEPTH, LEARNING_RATE, SUBSAMPLE, LEAST_ROWS = 40, 3, 0.2, 0.5, 20
LASSO, LASSO_STEPS = 1e-3, 600
STATS = ["n_bytes", "n_words", "n_lines", "upper", "digit", "punct", "symbol", "space", "high", "word_bytes", "long_words", "short_words", "repeat_next", "distinct", "bar", "bang", "word_top"]


def _classes() -> np.ndarray:
    kinds = np.zeros((8, 256), bool)
    ascii_range = np.arange(256)
    kinds[0, 65:91] = True  # upper
    kinds[1, 48:58] = True  # digit
    kinds[2, [ord(c) for c in ".,;:?'\"-"]] = True  # plain punctuation
    symbol = (ascii_range > 32) & (ascii_range < 127)
    symbol[[*range(48, 58), *range(65, 91), *range(97, 123), *(ord(c) for c in ".,;:?'\"-")]] = False
    kinds[3] = symbol
    kinds[4] = SPACE
    kinds[5, 128:] = True  # parts of letters outside ASCII
    kinds[6, ord("|")] = True
    kinds[7, ord("!")] = True
    return kinds


_CLASSES = _classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATS)))
    out[:, 0] = size
    if not len(data):
        return out
    filled = np.flatnonzero(size > 0)
    begin = offsets[:-1][filled]

    def share(k: int) -> np.ndarray:
        return np.add.reduceat(_CLASSES[k][data], begin, dtype=np.int64) / size[filled]

    for column, k in (("upper", 0), ("digit", 1), ("punct", 2), ("symbol", 3), ("space", 4), ("high", 5), ("bar", 6), ("bang", 7)):
        out[filled, STATS.index(column)] = share(k)
    out[filled, STATS.index("n_lines")] = np.add.reduceat(data == 10, begin, dtype=np.int64) + 1
    starts, ends, doc, hashes = words(data, offsets)
    count = np.bincount(doc, minlength=n)
    out[:, STATS.index("n_words")] = count
    some = np.maximum(count, 1)
    length = ends - starts
    out[:, STATS.index("word_bytes")] = np.bincount(doc, length, n) / some
    out[:, STATS.index("long_words")] = np.bincount(doc, length > 12, n) / some
    out[:, STATS.index("short_words")] = np.bincount(doc, length < 4, n) / some
    same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out[:, STATS.index("repeat_next")] = np.bincount(doc[1:], same, n) / some
    keys = hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    fresh = np.ones(len(order), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    out[:, STATS.index("distinct")] = np.bincount(doc[order], fresh, n) / some
    runs = np.diff(np.flatnonzero(np.append(fresh, True)))
    top = np.zeros(n)
    np.maximum.at(top, doc[order][fresh], runs)
    out[:, STATS.index("word_top")] = top / some
    return out


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The rows' other columns with the statistics of their texts as s_<name>; only texts go to Python."""
    names = [f"s_{s}" for s in STATS]
    keep = [c for c in docs.columns if c not in names and (c != text or keep_text)]

    @F.arrow_udf(", ".join(f"{c} double" for c in names))
    def measure(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            parts = [statistics(*flat_bytes(part.column(0))) for part in text_slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
            found = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(names))], names=names)
        give_back()

    return docs.withColumn("_statistics", measure(F.col(text))).select(*keep, "_statistics.*")


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold), all of which hold


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], values: np.ndarray) -> None:
    g, h = gradient[rows].sum(), hessian[rows].sum()
    if path:
        rules.append(path)
    values[rows] = g / (h + 1.0)
    if depth == 0 or len(rows) < 2 * LEAST_ROWS:
        return
    best = (1e-6, -1, 0.0)
    for k, cut in enumerate(cuts):
        if not len(cut):
            continue
        place = np.searchsorted(cut, x[rows, k], side="left")
        gs = np.cumsum(np.bincount(place, gradient[rows], len(cut) + 1))[:-1]
        hs = np.cumsum(np.bincount(place, hessian[rows], len(cut) + 1))[:-1]
        ns = np.cumsum(np.bincount(place, minlength=len(cut) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
        gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = -1
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (float(gain[j]), k, float(cut[j]))
    _, k, cut = best
    if k < 0:
        return
    above = x[rows, k] > cut
    _grow(x, gradient, hessian, cuts, rows[~above], depth - 1, (*path, (k, False, cut)), rules, values)
    _grow(x, gradient, hessian, cuts, rows[above], depth - 1, (*path, (k, True, cut)), rules, values)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Paths of TREES boosted trees of DEPTH levels, each grown on a share of the rows; simplified and distinct."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    margin, rules = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        rows = np.flatnonzero(random.random(len(y)) < SUBSAMPLE)
        found: list[Rule] = []
        _grow(x, y - p, p * (1 - p), cuts, rows, DEPTH, (), found, step)
        margin[rows] += LEARNING_RATE * step[rows]
        rules += found
    return list(dict.fromkeys(simplify(r) for r in rules))


def simplify(rule: Rule) -> Rule:
    """One bound for each statistic and side, in order."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, above, cut in rule:
        old = bounds.get((k, above), cut)
        bounds[k, above] = max(old, cut) if above else min(old, cut)
    return tuple((k, above, cut) for (k, above), cut in sorted(bounds.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, weight: float = LASSO, steps: int = LASSO_STEPS) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty (not on the intercept) by accelerated proximal gradient."""
    z = z.astype(np.float64)
    n, m = z.shape
    scale = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1.0)
    beta, look, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(look[0] + z @ look[1:]))) - y
        new = look - scale * np.concatenate([[error.mean()], z.T @ error / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - scale * weight, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, beta = new + (old - 1) / t * (new - beta), new
    return float(beta[0]), beta[1:]


class Ensemble:
    """Intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score_column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            condition = F.lit(True)
            for k, above, cut in rule:
                value = F.col(f"s_{STATS[k]}")
                condition = condition & ((value > cut) if above else (value <= cut))
            total = total + F.when(condition, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    indicators = np.stack([holds(r, x) for r in rules], 1) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso(indicators, y) if rules else lasso(np.zeros((len(y), 1)), y)
    return Ensemble(intercept, [(r, round(float(w), 6)) for r, w in zip(rules, weights, strict=False) if abs(w) > 1e-4])


def fit_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fits on about sample_rows labelled rows by a hash of the key; conflicting labels of one key all count."""
    labelled = labels.where(F.col(label).isNotNull()).select(key, F.col(label).alias("_label"))
    n = labelled.count()
    if n > sample_rows:
        labelled = labelled.where((F.xxhash64(key) % 1_000_003 + 1_000_003) % 1_000_003 < int(1_000_003 * sample_rows / n))
    picked = docs.select(key, text).join(F.broadcast(labelled), key) if n else docs.select(key, text).limit(0).withColumn("_label", F.lit(0))
    rows = with_statistics(picked.select(text, "_label"), text).toPandas()
    return fit(rows[[f"s_{s}" for s in STATS]].to_numpy(np.float64), rows["_label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """Adds score and predicted; statistics and text are left out."""
    keep = [c for c in docs.columns if c not in ("score", "predicted", text)]
    rated = with_statistics(docs.select(*keep, text), text).select(*keep, model.score_column().alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(column: Column) -> Column:
    return crc_mod(column, 3) == 1


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_labels(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
