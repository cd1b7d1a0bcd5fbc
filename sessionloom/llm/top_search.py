"""Exact top-k search by inner product without random access: sorted lists, bounds, and a stop that loses nothing.

Candidates fall into blocks of bounded size; a block keeps one list of its vectors for each component, sorted by value. A
query reads the lists of its non-zero components step by step from the end that adds most. What has been read gives every
vector met a lower bound (unread components at the lists' far ends) and an upper one (unread components at the places
reached). A vector not met yet cannot exceed the sum of the places reached: once that falls short of the k-th best score
known, reading stops, and the vectors met whose upper bounds still reach it get their final scores. Best scores are carried
from block to block of a task, so later blocks stop sooner. A task takes QUERY_ROWS queries over SPAN blocks; the best k of
every task meet in one ranking. Queries are a stated set of rows, met with all candidates block by block.

Components become floor(1024 * x) in double precision and scores are exact: sums beyond 2**53 are taken in Python's
integers, and a score beyond 64 bits counts as the nearest one that fits. Vectors that are null or hold null or non-finite
components take no part, nor do rows without an id; vectors of different length do not meet; an empty vector scores 0 with
its like. Every row is a query or candidate of its own, so rows that repeat an id meet each other and repeat their ranks.
Ties go to the smaller id. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, table

TOP = 10
QUERY_STEP = 100
SCALE = 1024
#: Components of a block, of a task's queries; blocks that a task reads one after another.
BLOCK_VALUES = 1 << 18
QUERY_VALUES = 1 << 13
SPAN = 8
#: Entries of each list in the first step; steps double.
FIRST_STEP = 64
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1
USABLE = "vec_id bigint, dim int, vec binary"
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, length and double-precision bytes of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not value.is_valid or value.values.null_count:
                    continue
                x = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all():
                    out.append((vec_id, len(x), x.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "dim", "vec"])
        give_back()

    return vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(column)).mapInArrow(run, USABLE)


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): whole doubles, or Python's integers where doubles would not hold sums of their products."""
    with np.errstate(over="ignore"):
        out = np.floor(SCALE * x)
    if np.abs(out).max(initial=0) < 2.0**50:
        return out
    whole = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(SCALE * v))
    return np.array([[whole(float(v)) for v in row] for row in x], object).reshape(x.shape)


class Lists:
    """A block: its vectors, and for each component the vectors' numbers in the order of their values."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids = rows, ids
        self.x = quantised(x if x.shape[1] else np.zeros((len(ids), 1)))
        self.order = np.argsort(self.x, axis=0, kind="stable").T
        self.most = int(np.abs(self.x).max(initial=0))

    def packed(self) -> bytes:
        """As bytes, numbers and values in the narrowest kind that holds them."""
        narrow = next((kind for kind in (np.int16, np.int32) if self.x.dtype != object and self.most <= np.iinfo(kind).max), None)
        return pickle.dumps((self.rows, self.ids, self.x if narrow is None else self.x.astype(narrow), self.order.astype(np.uint16 if len(self.ids) <= 1 << 16 else np.int32), self.most), protocol=5)

    @staticmethod
    def unpacked(data: bytes) -> Lists:
        out = Lists.__new__(Lists)
        out.rows, out.ids, x, order, out.most = pickle.loads(data)
        return out.of_kind(x if x.dtype == object else x.astype(np.float64), order.astype(np.int64))

    def of_kind(self, x: np.ndarray, order: np.ndarray) -> Lists:
        """The same block over these values; each list with its values beside its numbers."""
        out = Lists.__new__(Lists)
        vars(out).update(rows=self.rows, ids=self.ids, most=self.most, x=x, order=order, values=np.take_along_axis(x.T, order, 1))
        return out


def _per_vector(some: np.ndarray, gains: np.ndarray, n: int) -> np.ndarray:
    if gains.dtype != object:
        return np.bincount(some.ravel(), gains.ravel(), n)
    out = np.zeros(n, object)
    np.add.at(out, some.ravel(), gains.ravel())
    return out


def _kth(scores: np.ndarray, k: int):
    return np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]


def read_lists(block: Lists, q: np.ndarray, floor: int | None, skip: int, k: int) -> np.ndarray:
    """Numbers of the block's vectors that may be among the k best: none that is left out reaches ``floor`` (the k-th best
    score known) or, where none is known, the k-th best lower bound found here. ``skip``: the query's own row, or -1.

    What a vector has more than the places reached, summed over the components read, is what its upper bound has more than
    the bound of a vector not met; in the same way its lower bound stands above the sum of the lists' far ends.
    """
    n, dims = len(block.ids), np.flatnonzero(q != 0)
    if not len(dims):
        return np.flatnonzero(np.arange(n) != skip)
    q, down = q[dims, None], q[dims] > 0
    order = np.where(down[:, None], block.order[dims, ::-1], block.order[dims])
    gains = q * np.where(down[:, None], block.values[dims, ::-1], block.values[dims])
    reached, step, limit = 0, FIRST_STEP, floor
    while True:
        reached, step = min(n, reached + step), 2 * step
        place = gains[:, reached - 1]
        if floor is None:
            least = gains[:, -1]
            lower = least.sum() + _per_vector(order[:, :reached], gains[:, :reached] - least[:, None], n)
            lower = np.delete(lower, skip) if skip >= 0 else lower
            limit = _kth(lower, k) if len(lower) >= k else None
        if limit is not None:  # scores beyond 64 bits are ties
            limit = min(limit, MOST) if limit > LEAST else None
        if reached == n or (limit is not None and place.sum() < limit):
            break
    upper = place.sum() + _per_vector(order[:, :reached], gains[:, :reached] - place[:, None], n)
    kept = np.ones(n, bool) if limit is None else upper >= limit
    if skip >= 0:
        kept[skip] = False
    return np.flatnonzero(kept)


def _best(block: Lists, at: np.ndarray, q: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best of those known and of these vectors, by their final scores."""
    scores, ids = block.x[at] @ q, block.ids[at]
    if len(scores) > k and (bar := _kth(scores, k)) > LEAST:
        some = scores >= min(bar, MOST)
        scores, ids = scores[some], ids[some]
    found = [(min(max(int(score), LEAST), MOST), other) for score, other in zip(scores, ids.tolist(), strict=True)]
    return sorted(best + found, key=lambda s: (-s[0], s[1]))[:k]


def _searched(group: pa.Table, k: int) -> pa.Table:
    """Queries of a task over its blocks, one after another."""
    whole = np.frompyfunc(int, 1, 1)
    parts = [*zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True)]
    blocks = [Lists.unpacked(data) for kind, data in parts if kind == "block"]
    out = []
    for rows, ids, x in (pickle.loads(data) for kind, data in parts if kind == "query"):
        coded = quantised(x if x.shape[1] else np.zeros((len(ids), 1)))
        most = int(np.abs(coded).max(initial=0))
        # Sums that doubles may not hold are taken in Python's integers.
        wide = [coded.dtype == object or b.x.dtype == object or coded.shape[1] * most * b.most >= EXACT for b in blocks]
        near = [b.of_kind(whole(b.x), b.order) if w else b for b, w in zip(blocks, wide, strict=True)]
        for row, vec_id, q in zip(rows.tolist(), ids.tolist(), coded, strict=True):
            best: list[tuple[int, int]] = []
            for block, w in zip(near, wide, strict=True):
                own, skip = whole(q) if w else q, np.flatnonzero(block.rows == row)
                at = read_lists(block, own, best[-1][0] if len(best) == k else None, int(skip[0]) if len(skip) else -1, k)
                best = _best(block, at, own, best, k)
            out += [(row, vec_id, other, score) for score, other in best]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])


def _grouped(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Rows in parts of about ``size`` components, one row a part: kind, dim, part, data."""
    parts = rows.groupBy("dim").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(1)) / F.lit(float(size))).cast("bigint").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "dim").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        dim = group.column("dim")[0].as_py()
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64).reshape(-1, dim) if dim else np.zeros((group.num_rows, 0))
        own, ids = group.column("row").to_numpy(), group.column("vec_id").to_numpy()
        data = Lists(own, ids, x).packed() if kind == "block" else pickle.dumps((own, ids, x), protocol=5)
        return pa.table([pa.array([kind]), group.column("dim")[:1], group.column("part")[:1], pa.array([data], pa.binary())], names=["kind", "dim", "part", "data"])

    return dealt.select("dim", "part", "row", "vec_id", "vec").groupBy("dim", "part").applyInArrow(build, "kind string, dim int, part bigint, data binary")


def top_search(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = TOP, query_step: int = QUERY_STEP, block_values: int = BLOCK_VALUES, query_values: int = QUERY_VALUES, span: int = SPAN) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id is divisible by ``query_step``."""
    rows = cut_lineage(usable(vectors, key, column).withColumn("row", F.monotonically_increasing_id()))
    blocks = cut_lineage(_grouped(rows, block_values, "block")).withColumn("stretch", F.floor(F.col("part") / span))
    queries = cut_lineage(_grouped(rows.where(F.col("vec_id") % query_step == 0), query_values, "query"))
    # The numbers of a length's stretches and query parts come from what there is; each part goes to every one of the other.
    stretches = blocks.groupBy("dim").agg(F.max("stretch").alias("others"))
    parts = queries.groupBy("dim").agg(F.max("part").alias("others"))
    spread = lambda df, n: df.join(F.broadcast(n), "dim").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "others")))
    tasks = spread(blocks, parts).select("kind", "dim", "stretch", F.col("other").alias("asked"), "data")
    tasks = tasks.union(spread(queries, stretches).select("kind", "dim", F.col("other").alias("stretch"), F.col("part").alias("asked"), "data"))
    found = tasks.groupBy("dim", "stretch", "asked").applyInArrow(lambda group: _searched(group, k), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_top_search(spark, sf_dir: str) -> DataFrame:
    return top_search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def oracle_sql() -> str:
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::double[], lambda x: floor({SCALE} * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::double[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM vectors q JOIN vectors c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::int AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
