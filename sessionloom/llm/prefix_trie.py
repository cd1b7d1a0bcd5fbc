"""Prefix trie of conversations: every shared prefix of turns as a node with its members, leaves and saved tokens.

Turns become digests of role and text, so no text is shuffled. Conversations are rebuilt from a shared head and their own
turns; equal ones form a class that counts its copies. Classes are dealt by the digest of their first turn. A first-turn
subtrie with more than ``most_turns`` turns is not built in one task: its trunk (all turns its members share) becomes nodes
by partial sums, its members are dealt again by their next turn, and so on until every subtrie is small. Small subtries are
built in applyInPandas as dictionaries of pointers; nodes are numbered after their parents, so running through the numbers
backwards is a postorder without recursion. Trunks then take the totals of the subtries below them, deepest round first.

Turns go by (turn, role, digest), null turns first; a null role or text is empty; rows without a conv_id belong to no
conversation; repeated rows are turns of their own. A table without conversations has no node, not even the root. Columns
other than the four are not read. A conversation is one record: its digests (40 bytes a turn) fit one row of a task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut_lineage, table

#: Turns of a subtrie that one task builds at most; larger ones are dealt again.
MOST_TURNS = 8192
#: Most turns that a conversation takes from its head: the remainder of a checksum by this.
HEAD_TURNS = 6
#: Conversations that share a head.
HEAD_SPAN = 100
#: Conversation ids whose decimals one row gathers before they are hashed in order.
ID_SPAN = 1 << 16
#: Hex digits of a turn's digest.
DIGITS = 32
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NOBODY = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: (key: digest of role and text, n: code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", role.alias("role"), key.alias("key"), F.char_length(text).alias("n")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"], t["n"])).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """The first turns of each conversation come from the first conversation of its span."""
    lists = cut_lineage(lists)
    c = F.col("conv_id")
    heads = lists.where(c % HEAD_SPAN == 0).select(c.alias("head_id"), F.slice("turns", 1, HEAD_TURNS - 1).alias("head"))
    own = lists.withColumns({"head_id": c - c % HEAD_SPAN, "h": crc_mod(c, HEAD_TURNS).cast("int")})
    none = F.expr("cast(array() as array<struct<key:string,n:int>>)")
    begin = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "head_id", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


def _hashed_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a class stand together in the order of their ids: one running hash, whatever the number of copies."""
    seq, n, least, running = None, 0, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([n], pa.int64()), pa.array([least], pa.int64()), pa.array([running.hexdigest()])], names=["seq", "n", "class_id", "ends"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for key, count, first, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "least", "ids")), strict=True):
            if key != seq:
                if seq is not None:
                    out.append(row())
                seq, n, least, running = key, 0, first, hashlib.sha256()
            running.update(("," if n else "").encode() + ids.encode())
            n += count
        if len(out) > 2000:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if seq is not None:
        out.append(row())
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def classes(conversations: DataFrame) -> DataFrame:
    """Equal conversations as one row: class_id (least id), n copies, path (their turns' digests), lens, ends (hash of ids)."""
    path = F.array_join(F.transform("turns", lambda t: t["key"]), "")
    paths = cut_lineage(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n"]).alias("lens"), F.sha2(path, 256).alias("seq")))
    span = F.floor(F.col("conv_id") / F.lit(ID_SPAN)).cast("bigint")
    runs = paths.groupBy("seq", span.alias("span")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ends = runs.repartition("seq").sortWithinPartitions("seq", "span").mapInArrow(_hashed_in_order, "seq string, n bigint, class_id bigint, ends string")
    return cut_lineage(ends.join(paths.withColumnRenamed("conv_id", "class_id"), ["class_id", "seq"]).select("class_id", "n", "path", "lens", "ends"))


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The subtries of some first (or next) turns: dictionaries of pointers, totals from the last node back to the first."""
    tops: dict[str, int] = {}
    below: list[dict[str, int]] = []
    parent, depth, least, count, length, ends, up, up_conv = ([] for _ in range(8))

    def node(at: int, where: int, points: int) -> int:
        for column, value in ((below, {}), (parent, at), (depth, where), (least, None), (count, 0), (length, points), (ends, _NOBODY), (up, None), (up_conv, None)):
            column.append(value)
        return len(below) - 1

    for r in rows.itertuples(index=False):
        at = tops.get(r.gkey)
        if at is None:
            at = tops[r.gkey] = node(-1, r.p + 1, int(r.lens[r.p]))
            up[at], up_conv[at] = r.up, r.up_conv
        for d in range(r.p + 1, len(r.lens) + 1):
            if d > r.p + 1:
                turn = r.path[DIGITS * (d - 1) : DIGITS * d]
                child = below[at].get(turn)
                if child is None:
                    child = below[at][turn] = node(at, d, int(r.lens[d - 1]))
                at = child
            count[at] += r.n
            least[at] = r.class_id if least[at] is None else min(least[at], r.class_id)
        ends[at] = r.ends
    leaves, saved = [0 if children else 1 for children in below], [(n - 1) * points for n, points in zip(count, length, strict=True)]
    for k in range(len(below) - 1, -1, -1):
        if parent[k] >= 0:
            leaves[parent[k]] += leaves[k]
            saved[parent[k]] += saved[k]
    above = [least[p] if p >= 0 else up_conv[k] for k, p in enumerate(parent)]
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": count, "n_children": [len(c) for c in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "up": up})


def _shared_turns(least: str, most: str) -> Column:
    """Turns that all paths between two paths have in common: those the least and the most have."""
    turns = F.least(F.char_length(least), F.char_length(most)) / DIGITS
    same = lambda k: F.col(least).substr(F.lit(1), k * DIGITS) == F.col(most).substr(F.lit(1), k * DIGITS)
    return F.size(F.filter(F.sequence(F.lit(1), turns.cast("int")), same))


def trie(found: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """All nodes of the trie over classes (see ``classes``); ``most_turns`` bounds what one task builds."""
    root = found.agg(F.min("class_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.size("lens") == 0, F.col("ends"))).alias("ends")).first()
    live = found.where(F.size("lens") > 0).withColumns({"p": F.lit(0), "up": F.lit("root"), "up_conv": F.lit(root["conv_id"]).cast("bigint")})
    small, trunks, turns = [], [], 0
    while True:
        live = live.withColumn("gkey", F.sha2(F.col("path").substr(F.lit(1), (F.col("p") + 1) * DIGITS), 256))
        sizes = live.groupBy("gkey").agg(F.sum(F.size("lens") - F.col("p")).alias("turns"), F.count("*").alias("rows"))
        sizes = cut_lineage(sizes.withColumn("big", (F.col("turns") > most_turns) & (F.col("rows") > 1)))
        seen = sizes.agg(F.sum(F.when(~F.col("big"), F.col("turns"))).alias("turns"), F.count_if("big").alias("big")).first()
        turns += seen["turns"] or 0
        if not seen["big"]:
            small.append(live)
            break
        big = sizes.where("big").select("gkey")
        small.append(live.join(big, "gkey", "left_anti"))
        crowded = cut_lineage(live.join(big, "gkey"))
        trunk = crowded.groupBy("gkey").agg(
            F.any_value("up").alias("up"), F.any_value("up_conv").alias("parent_conv_id"), F.any_value("p").alias("p"), F.min("class_id").alias("conv_id"),
            F.sum("n").alias("n_convs"), F.min("path").alias("least"), F.max("path").alias("most"), F.min_by("lens", "path").alias("lens"), F.min_by("ends", "path").alias("ends"),
        )
        trunk = trunk.withColumn("q", _shared_turns("least", "most"))
        own = F.transform(F.slice("lens", F.col("p") + 1, F.col("q") - F.col("p")), lambda n: n * (F.col("n_convs") - 1))
        ends = F.when(F.char_length("least") == F.col("q") * DIGITS, F.col("ends")).otherwise(_NOBODY)
        trunks.append(cut_lineage(trunk.select("gkey", "up", "parent_conv_id", "p", "q", "conv_id", "n_convs", own.alias("own"), ends.alias("ends"))))
        after = trunks[-1].select("gkey", "q", F.col("conv_id").alias("trunk_conv"))
        rest = crowded.join(after, "gkey").where(F.size("lens") > F.col("q"))
        live = cut_lineage(rest.select("class_id", "n", "path", "lens", "ends", F.col("q").alias("p"), F.col("gkey").alias("up"), F.col("trunk_conv").alias("up_conv")))
    dealt = functools.reduce(DataFrame.unionByName, small).withColumn("part", F.pmod(F.xxhash64("gkey"), F.lit(max(1, -(-turns // most_turns)))))
    nodes = cut_lineage(dealt.groupBy("part").applyInPandas(lambda rows: _built(rows), f"{NODE}, up string"))
    columns = [c for c in nodes.columns if c != "up"]
    out, tops = [nodes.select(columns)], nodes.where("up is not null").select("up", "n_leaves", "saved_tokens")
    sums = lambda rows: rows.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    for trunk in reversed(trunks):
        got = trunk.join(sums(tops).withColumnRenamed("up", "gkey"), "gkey", "left")
        got = got.withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)), "n_children": F.coalesce("n_children", F.lit(0)), "below": F.coalesce("below", F.lit(0))})
        rows = got.select("*", F.posexplode("own").alias("k", "here"))
        last = F.col("p") + F.col("k") + 1 == F.col("q")
        left = F.aggregate(F.slice("own", F.col("k") + 1, F.size("own")), F.lit(0).cast("bigint"), lambda a, x: a + x)
        rows = cut_lineage(rows.select(
            "conv_id", (F.col("p") + F.col("k") + 1).cast("bigint").alias("depth"), F.when(F.col("k") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"), (left + F.col("below")).alias("saved_tokens"),
            F.when(last, F.col("ends")).otherwise(_NOBODY).alias("ends_sha256"), F.when(F.col("k") == 0, F.col("up")).alias("up"),
        ))
        out.append(rows.select(columns))
        tops = tops.unionByName(rows.where("up is not null").select("up", "n_leaves", "saved_tokens"))
    if root["conv_id"] is not None:
        total = tops.where("up = 'root'").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
        fixed = {"conv_id": F.lit(root["conv_id"]), "depth": F.lit(0), "parent_conv_id": F.lit(None), "n_convs": F.lit(root["n_convs"])}
        top = total.select(*(v.cast("bigint").alias(c) for c, v in fixed.items()), "n_children", "n_leaves", "saved_tokens", F.lit(root["ends"] or _NOBODY).alias("ends_sha256"))
        out.append(top.select(columns))
    return functools.reduce(DataFrame.unionByName, out)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(classes(rebuilt(turn_lists(table(spark, sf_dir, "conversations")))))


def oracle_sql() -> str:
    """Nodes as prefixes of lists, each joined with all its ancestors; the checksum bit by bit."""
    steps = "list_concat([4294967295], flatten(list_transform(range(1, length(c::varchar) + 1), lambda k: list_concat([-1 - ascii(substr(c::varchar, k, 1))], [0, 0, 0, 0, 0, 0, 0, 0]))))"
    crc = f"xor(list_reduce({steps}, lambda a, b: CASE WHEN b < 0 THEN xor(a, -1 - b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS n,
         left(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), {DIGITS}) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id AS c, list({{'key': key, 'n': n}} ORDER BY turn NULLS FIRST, role, key) AS turns FROM turns GROUP BY conv_id),
sums AS (SELECT c, turns, ({crc} % {HEAD_TURNS})::bigint AS h FROM lists),
whole AS (
  SELECT s.c, list_concat(CASE WHEN s.h > 0 THEN coalesce(list_slice(b.turns, 1, s.h), []) ELSE [] END, list_slice(s.turns, s.h + 1, len(s.turns))) AS turns
  FROM sums s LEFT JOIN lists b ON b.c = s.c - s.c % {HEAD_SPAN}),
steps AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS depth FROM whole),
members AS (
  SELECT c, depth, len(turns) = depth AS last, CASE WHEN depth > 0 THEN turns[depth].n ELSE 0 END AS n,
         list_transform(range(0, depth + 1), lambda d: md5(concat(d, ':', array_to_string(list_transform(list_slice(turns, 1, d), lambda t: t.key), '')))) AS keys
  FROM steps),
nodes AS (
  SELECT keys[-1] AS key, any_value(keys) AS keys, any_value(depth) AS depth, any_value(n) AS n, count(*) AS n_convs, min(c) AS conv_id,
         sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM members GROUP BY keys[-1]),
children AS (SELECT keys[-2] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
above AS (SELECT unnest(keys) AS key, (n_convs - 1) * n AS saved, (n_children = 0)::int AS leaf FROM sized),
totals AS (SELECT key, sum(saved)::bigint AS saved_tokens, sum(leaf)::bigint AS n_leaves FROM above GROUP BY key)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, t.n_leaves, t.saved_tokens, s.ends_sha256
FROM sized s JOIN totals t USING (key) LEFT JOIN sized p ON p.key = s.keys[-2] AND s.depth > 0
"""
