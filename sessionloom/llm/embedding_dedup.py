"""Exact near-duplicate links between embeddings by dual traversal of cover trees.

Cosine >= MIN_COSINE is a Euclidean distance of at most REACH between unit vectors. Equal vectors form a class first; its
least id stands for it. Class vectors fall to the nearest of a bounded number of pivots of their length (the top level),
all lengths in one pass; a cell with many rows is split by a hash into blocks, so a block stays near BLOCK_ROWS rows
however hot the cell. Each block's cover tree has nested levels whose radii halve (1, 1/2, 1/4, 1/8); a node knows its
covering radius, the distance of its farthest descendant. Cells, then node pairs level by level, are pruned where the
centres' distance exceeds both covering radii and REACH; where it falls short of REACH by both radii, all pairs below link
at once and are counted by ranges. The member pairs left over are decided by their cosine in double precision. A block
travels as one row. A pair of blocks returns per vector the number of linked vectors and the least id of its links' local
component, never the pairs themselves.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different length
do not link. An empty table gives an empty one. Every input row gets a row; rows that repeat a vec_id count as copies of
one vertex: they share the links of all its vectors and its component, and a row whose vector cannot link has none of
them. Labels and other columns are not read. Ties at the limit count as links. On vectors that lie about equally far apart
no metric bound prunes above the leaves; the traversal then costs one matrix product a block pair.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, give_back, table
from .components import components

MIN_COSINE = 0.95
BLOCK_ROWS = 4096
PIVOTS = 2048
LEVELS = (1.0, 0.5, 0.25, 0.125)
SLACK = 1e-5  # for radii and pivot distances, which are right to 1e-7
STEP_PAIRS = 1 << 17
STEP_ROWS = 512
VECTORS = "vec_id bigint, dim int, set_key binary, vec binary"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id of every row; dim, digest and bytes of its vector (in its own precision), null where it cannot link."""
    kind = component_type(vectors, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, data = [], [], []
            for value in batch.column(1):
                x = None
                if value.is_valid and len(value.values) and not value.values.null_count:
                    x = np.asarray(value.values.to_numpy(zero_copy_only=False), kind)
                    x = x + kind(0) if np.isfinite(x).all() and x.any() else None
                raw = None if x is None else x.tobytes()
                dims.append(None if x is None else len(x))
                keys.append(None if x is None else hashlib.blake2b(raw, digest_size=16).digest())
                data.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "dim", "set_key", "vec"])
        give_back()

    return vectors.select(F.col(key).alias("vec_id"), F.col(column)).mapInArrow(run, VECTORS)


def component_type(vectors: DataFrame, column: str) -> type:
    """float32 where the column's components are of that kind, else float64."""
    return np.float32 if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else np.float64


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cover_tree(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each level and point: its node's centre (a point), and that node's covering radius.

    Single precision only chooses the nodes; the radii bound what is pruned and come from differences in double precision,
    as 2 - 2 * cosine loses all digits between near copies.
    """
    n, single = len(u), u.astype(np.float32)
    node, radius = np.zeros((len(LEVELS), n), np.int32), np.zeros((len(LEVELS), n), np.float32)
    above = np.zeros(n, np.int32)
    for level, size in enumerate(LEVELS):
        own, least = above.copy(), 1 - size * size / 2
        crowded = np.flatnonzero(np.bincount(above, minlength=n)[above] > 1)  # a node of one point stays as it is
        order = crowded[np.argsort(above[crowded], kind="stable")]
        for members in np.split(order, np.flatnonzero(np.diff(above[order])) + 1) if len(order) else ():
            first = above[members[0]]  # the parent's centre stays a centre: levels are nested
            left = np.concatenate([[first], members[members != first]])
            while len(left):  # candidates in order; each one that no centre covers yet becomes a centre
                some = left[:64]
                near = single[some] @ single[left].T >= least
                free = np.ones(len(left), bool)
                for k in range(len(some)):
                    if free[k]:
                        hit = near[k] & free
                        hit[k] = True
                        own[left[hit]] = some[k]
                        free[hit] = False
                left = left[free]
        node[level] = own
        far = np.zeros(n)
        for low in range(0, n, STEP_ROWS):
            far[low : low + STEP_ROWS] = np.linalg.norm(u[low : low + STEP_ROWS] - u[own[low : low + STEP_ROWS]], axis=1)
        np.maximum.at(radius[level], own, far)
        above = own
    return node, radius


class Block:
    """A block's tree, points in depth-first order, so that every node is a range of points."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray):
        u = unit(x)
        node, radius = cover_tree(u)
        order = np.lexsort(node[::-1])
        self.ids, self.copies, self.x = ids[order], copies[order], x[order]
        self.single = u[order].astype(np.float32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.centre, self.start, self.count, self.radius, self.child = [], [], [], [], []
        for level in range(len(LEVELS)):
            own = node[level][order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            self.centre.append(place[own[first]])
            self.start.append(first)
            self.count.append(np.diff(np.append(first, len(own))))
            self.radius.append(radius[level][own[first]])
        for level in range(len(LEVELS) - 1):
            low = np.searchsorted(self.start[level + 1], self.start[level])
            high = np.searchsorted(self.start[level + 1], self.start[level] + self.count[level])
            self.child.append((low, high - low))

    def packed(self) -> bytes:
        """As bytes, without the single-precision vectors where they are as wide as the vectors themselves."""
        return pickle.dumps({k: v for k, v in vars(self).items() if k != "single"}, protocol=5)

    @staticmethod
    def unpacked(data: bytes) -> Block:
        out = Block.__new__(Block)
        vars(out).update(pickle.loads(data))
        out.single = np.concatenate([unit(out.x[k : k + STEP_ROWS]).astype(np.float32) for k in range(0, len(out.x), STEP_ROWS)])
        return out


def _trees(blocks: DataFrame, kind: type) -> DataFrame:
    def build(group: pa.Table) -> pa.Table:
        x = matrix(group.column("vec"), group.column("dim")[0].as_py(), kind)
        data = Block(group.column("vec_id").to_numpy(), group.column("copies").to_numpy(), x).packed()
        return pa.table([group.column("block")[:1], pa.array([data], pa.binary()), group.column("dim")[:1]], names=["block", "tree", "dim"])

    return blocks.groupBy("block").applyInArrow(build, "block bigint, tree binary, dim int")


def _cross(starts_a, counts_a, starts_b, counts_b):
    """All (i, j) of ragged ranges: positions a and b of the k-th pair of ranges."""
    total = counts_a * counts_b
    which = np.repeat(np.arange(len(total)), total)
    k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    return starts_a[which] + k // counts_b[which], starts_b[which] + k % counts_b[which]


def dual_links(a: Block, b: Block, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked point pairs of two trees (i < j where both are one tree), and pairs of ranges (start, count, start, count)
    of which every point of one links with every other point of the other."""
    reach, off = np.sqrt(2 - 2 * cosine), (a.x.shape[1] + 4) * np.finfo(np.float32).eps  # off: error of a single-precision product
    points: list[tuple[np.ndarray, np.ndarray]] = []
    ranges: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
    level_pairs: list[tuple[int, np.ndarray, np.ndarray]] = []

    def sort_out(level: int, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> None:
        """Node pairs that may link: those sure to link become ranges, the others wait for their children."""
        span = (a.radius[level][i] + b.radius[level][j]).astype(np.float64)
        inside = reach - SLACK - span
        sure = (inside > 0) & (shared >= 1 + off - inside * inside / 2)
        if sure.any():
            s, t = i[sure], j[sure]
            ranges.append(np.stack([a.start[level][s], a.count[level][s], b.start[level][t], b.count[level][t]], 1))
            i, j = i[~sure], j[~sure]
        level_pairs.extend((level, i[m : m + 4096], j[m : m + 4096]) for m in range(0, len(i), 4096))

    centres, radius = b.single[b.centre[0]], b.radius[0].astype(np.float64)
    for kind in (a.radius[0] == 0, a.radius[0] > 0):
        rows = np.flatnonzero(kind)
        for low in range(0, len(rows), STEP_ROWS):
            some = rows[low : low + STEP_ROWS]
            shared = a.single[a.centre[0][some]] @ centres.T
            bound = reach + SLACK + radius[None, :] + (a.radius[0][some].astype(np.float64)[:, None] if kind[some[0]] and a.radius[0][some[0]] else 0.0)
            i, j = np.nonzero(shared >= (1 - off - bound * bound / 2).astype(np.float32))
            shared, i = shared[i, j], some[i]
            keep = i <= j if same else np.ones(len(i), bool)
            sort_out(0, i[keep], j[keep], shared[keep])
    while level_pairs:  # depth first, in steps of bounded size
        level, i, j = level_pairs.pop()
        last = level == len(LEVELS) - 1
        p, q = _cross(a.start[level][i], a.count[level][i], b.start[level][j], b.count[level][j]) if last else _cross(*(v[i] for v in a.child[level]), *(v[j] for v in b.child[level]))
        if same:
            keep = p < q if last else p <= q
            p, q = p[keep], q[keep]
        for k in range(0, len(p), STEP_PAIRS):
            s, t = p[k : k + STEP_PAIRS], q[k : k + STEP_PAIRS]
            if last:
                x, y = a.x[s].astype(np.float64), b.x[t].astype(np.float64)
                exact = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                odd = ~np.isfinite(exact)  # components too large or small to be squared
                if odd.any():
                    exact[odd] = np.einsum("ij,ij->i", unit(x[odd]), unit(y[odd]))
                points.append((s[exact >= cosine], t[exact >= cosine]))
                continue
            shared = np.einsum("ij,ij->i", a.single[a.centre[level + 1][s]], b.single[b.centre[level + 1][t]])
            bound = reach + SLACK + a.radius[level + 1][s].astype(np.float64) + b.radius[level + 1][t]
            keep = shared >= 1 - off - bound * bound / 2
            sort_out(level + 1, s[keep], t[keep], shared[keep])
    none = np.zeros(0, np.int64)
    p, q = (np.concatenate([f[k] for f in points]) if points else none for k in (0, 1))
    return p, q, np.concatenate(ranges)


def _steps(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's start beside each of its later points."""
    later = count - 1
    first = np.repeat(start, later)
    return first, first + 1 + np.arange(int(later.sum())) - np.repeat(np.cumsum(later) - later, later)


def tally(ids: np.ndarray, copies: np.ndarray, p: np.ndarray, q: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the vectors it links with (copies counted), and the least id it reaches by these links."""
    n = len(ids)
    links = (np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(copies)])
    for k, m in ((0, 2), (2, 0)):
        one_node = (ranges[:, 0] == ranges[:, 2]) & (k == 2)  # a node with itself counts once
        start, count, other = ranges[~one_node, k], ranges[~one_node, k + 1], ranges[~one_node, m]
        held = before[other + ranges[~one_node, m + 1]] - before[other]
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, start, held)
        np.add.at(change, start + count, -held)
        links += np.cumsum(change)[:-1]
    own = ranges[ranges[:, 0] == ranges[:, 2]]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, own[:, 0], 1)
    np.add.at(change, own[:, 0] + own[:, 1], -1)
    links -= np.cumsum(change)[:-1] * copies
    edges = [(p, q), (ranges[:, 0], ranges[:, 2]), _steps(ranges[:, 0], ranges[:, 1]), _steps(ranges[:, 2], ranges[:, 3])]
    i, j = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    least = ids.copy()
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == least).all():
            return links, least
        least = new


def _linked(pairs: DataFrame, cosine: float) -> DataFrame:
    """vec_id, links (linked vectors, copies counted), least (least id of its component in the pair of blocks)."""

    def traverse(key: tuple, group: pa.Table) -> pa.Table:
        first, second = (v.as_py() for v in key)
        trees = {block.as_py(): tree for block, tree in zip(group.column("block"), group.column("tree"), strict=True)}
        a = Block.unpacked(trees[first].as_py())
        b = a if first == second else Block.unpacked(trees[second].as_py())
        p, q, ranges = dual_links(a, b, a is b, cosine)
        ids, copies = a.ids, a.copies
        if a is not b:
            ids, copies, q = np.concatenate([ids, b.ids]), np.concatenate([copies, b.copies]), q + len(a.ids)
            ranges[:, 2] += len(a.ids)
        links, least = tally(ids, copies, p, q, ranges)
        some = links > 0
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(least[some])], names=["vec_id", "links", "least"])

    return pairs.groupBy("first", "second").applyInArrow(traverse, "vec_id bigint, links bigint, least bigint")


def _cells(reps: DataFrame, kind: type, block_rows: int, most_pivots: int) -> dict[int, tuple[int, np.ndarray | None]]:
    """Vector length -> its first cell, and its pivots (one a cell); None is one cell for all, where rows are few."""
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    counts = {dim: min(most_pivots, n // (2 * block_rows)) for dim, n in sizes.items()}
    wanted = {dim: (count + 6 * count**0.5 + 16) / sizes[dim] for dim, count in counts.items() if count > 1}
    pivots: dict[int, np.ndarray] = {}
    if wanted:  # a few more rows than pivots, of which the least hashes stay
        share = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
        reps = reps.withColumn("hash", F.xxhash64("vec_id"))
        part = F.col("hash").cast("double") / F.lit(2.0**64) + 0.5
        picked = reps.where(F.col("dim").isin(list(wanted)) & (part < share[F.col("dim")])).select("hash", "vec_id", "dim", "vec").toArrow()
        dims, order = picked.column("dim").to_numpy(), np.lexsort((picked.column("vec_id").to_numpy(), picked.column("hash").to_numpy()))
        for dim in np.unique(dims).tolist():
            pivots[dim] = unit(matrix(picked.column("vec").take(pa.array(order[dims[order] == dim][: counts[dim]])), dim, kind))
    out, first = {}, 0
    for dim in sorted(sizes):
        out[dim] = (first, pivots.get(dim))
        first += len(pivots[dim]) if dim in pivots else 1
    return out


def _block_links(reps: DataFrame, kind: type, cosine: float, block_rows: int, most_pivots: int) -> DataFrame:
    """Links of all vectors; cells and blocks are of one vector length each, and only those of the same length meet."""
    spark = reps.sparkSession
    cells = _cells(reps, kind, block_rows, most_pivots)
    known = spark.sparkContext.broadcast(cells)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                first, pivots = known.value[dim]
                rows = np.flatnonzero(dims == dim)
                cell[rows] = first
                if pivots is not None:
                    shared = unit(matrix(batch.column("vec").take(pa.array(rows)), dim, kind)) @ pivots.T
                    near = shared.argmax(1)
                    cell[rows] += near
                    far[rows] = np.sqrt(np.maximum(0, 2 - 2 * shared[np.arange(len(rows)), near]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    fields = "vec_id bigint, copies bigint, dim int, vec binary"
    celled = cut_lineage(reps.select("vec_id", "copies", "dim", "vec").mapInArrow(nearest, f"{fields}, cell bigint, far double"))
    n_cells = sum(1 if pivots is None else len(pivots) for _, pivots in cells.values())
    radius, splits = np.zeros(n_cells), np.zeros(n_cells, np.int64)
    for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        radius[r["cell"]], splits[r["cell"]] = r["far"], -(-r["n"] // block_rows)
    begin = np.cumsum(splits) - splits
    meet: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # length -> first block, cells that meet, cell of each block
    for dim, (first, pivots) in cells.items():
        own = slice(first, first + (1 if pivots is None else len(pivots)))
        apart = np.zeros((1, 1)) if pivots is None else np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
        reach = radius[own, None] + radius[None, own] + np.sqrt(2 - 2 * cosine) + SLACK
        some = splits[own] > 0
        meet[dim] = (int(begin[first]), (apart <= reach) & some[:, None] & some[None, :], np.repeat(np.arange(len(some)), splits[own]))
    shape = spark.sparkContext.broadcast(meet)
    split = F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(splits.tolist()), (F.col("cell") + 1).cast("int")))
    start = F.element_at(F.lit(begin.tolist()), (F.col("cell") + 1).cast("int"))
    trees = cut_lineage(_trees(celled.select("vec_id", "copies", "dim", "vec", (start + split).alias("block")), kind))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (block, dim) in enumerate(zip(batch.column("block").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                before, meet, cell_of = shape.value[dim]
                others = before + np.flatnonzero(meet[cell_of[block - before], cell_of])
                for low in range(0, len(others), 4):  # a tree is about a megabyte
                    some = others[low : low + 4]
                    whole = batch.slice(k, 1).take(pa.array(np.zeros(len(some), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(block, some)), pa.array(np.maximum(block, some)), whole.column("block"), whole.column("tree")], names=["first", "second", "block", "tree"])

    return _linked(trees.mapInArrow(partners, "first bigint, second bigint, block bigint, tree binary"), cosine)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = MIN_COSINE, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each input row."""
    kind = component_type(vectors, column)
    rows = cut_lineage(usable(vectors, key, column))
    valid = rows.where("set_key is not null")
    classes = cut_lineage(valid.groupBy("set_key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec")))
    linked = cut_lineage(_block_links(classes.select(F.col("class_id").alias("vec_id"), "copies", "dim", "vec"), kind, cosine, block_rows, pivots))
    named = components(linked.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    totals = linked.groupBy("vec_id").agg(F.sum("links").alias("links"))
    heads = classes.select("set_key", F.col("class_id").alias("vec_id"), "copies").join(totals, "vec_id", "left").join(named.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    heads = cut_lineage(heads.select("set_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    good = valid.select("vec_id", "set_key").join(heads, "set_key").select("vec_id", "n_links", "component_id")
    bad = rows.where("set_key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def oracle_sql() -> str:
    """All pairs of vectors, for tables small enough for that; components by reachable ids."""
    return f"""
WITH RECURSIVE doubles AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
good AS (SELECT vec_id, v FROM doubles WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {MIN_COSINE}),
degrees AS (SELECT a AS vec_id, count(*) AS n_links FROM edges GROUP BY a),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT r.vec_id, coalesce(any_value(d.n_links), 0) AS n_links, min(r.other) AS component_id, r.vec_id = min(r.other) AS kept FROM reach r LEFT JOIN degrees d USING (vec_id) GROUP BY r.vec_id
"""
