"""Near-duplicate documents by bottom-k MinHash sketches and exact Jaccard similarity of shingle sets.

Texts with A-Z lower-cased give words ``[^\\x20\\x09-\\x0D]+``; the set of a document is its distinct w-word shingles, or
its whole word sequence where it has fewer words. Steps:

1. One 64-bit hash function gives each set its sketch, the K least hashes. Equal sets (128-bit digest) form a class; the
   class's least id stands for it from here on.
2. Inverted lists of retained values. Two sets of similarity s share about s * K retained values, at least LEAST_SHARED
   but for about 3.4 pairs in 10^8 at the limit of 0.8. So with all sketches in one order, two similar sets meet in the
   first K - LEAST_SHARED + MEETINGS values of each, MEETINGS times (a smaller set needs ceil(0.8 n) shared). The order puts rare values first, by
   exact counts that come from a join: values of shared passages rarely make a list, and lists stay short as tables grow.
3. In every list each member meets the list's lead, the set whose values are commonest (the centre of a group of copies).
   Pairs that the estimate from the union sketch lets through are verified on the words of both texts, which also gives
   the shingles shared with the lead. Verified pairs join components.
4. In lists that still span several components, members outside the lead's component meet members of other components,
   unless sizes or the overlaps with the lead rule a link out, and pairs that meet in too few lists for the sketches'
   order fall away; the rest take the same estimate and check. Where a lead has more than CROWD members in one list, its strangers
   meet all of them inside tasks, block by block, on sketches, and those that may link on full sets; only pairs that join
   components come out. A group of
   copies is thus linked by a number of pairs linear in its size, and no pair of different components that could link
   goes untested.

Null and blank texts have an empty set, link with nothing and stand alone. Repeated rows of one id count as one document
(the result repeats per input row; where their texts differ, the id stands in the classes of all of them). A null id has a
null component and is never kept. An empty table gives an empty one; a text of any length is read whole, and its full set
held where it is verified. Extra columns are not carried. Ties do not matter: components are sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, flat_bytes, give_back, let_go, mix64, table, text_slices, words
from .components import components

SKETCH = 48
LEAST_SHARED = 22
PERCENT = 80
MEETINGS = 3
SKETCHES = "doc_id bigint, n_shingles bigint, set_key binary, sketch array<bigint>"


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle (repeats too) and where each text's shingles begin."""
    _, _, doc, hashes = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    with np.errstate(over="ignore"):
        mixed = mix64(hashes + np.uint64(0x632BE59BD9B4E019))
        for k in range(1, size):
            longer, left = np.zeros(len(hashes), np.uint64), max(0, len(hashes) - k)
            longer[:left] = mix64(mixed[:left] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
            # a text with fewer words than the size has one shingle of all its words
            short = np.minimum(count, size)[doc] <= k
            mixed = np.where(short, mixed, longer) if len(hashes) else mixed
    first = np.cumsum(count) - count
    kept = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    begin = np.cumsum(kept) - kept
    at = np.repeat(first - begin, kept) + np.arange(int(kept.sum()))
    return mixed[at], np.concatenate([begin, [int(kept.sum())]])


def sketches(docs: DataFrame, text: str = "text", size: int = 2, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set) and sketch (its k least hashes in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                hashes, begin = shingle_hashes(*flat_bytes(part.column(text)), size)
                counts, keys, least = [], [], []
                for low, high in zip(begin[:-1], begin[1:], strict=True):
                    own = np.unique(hashes[low:high])
                    counts.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    least.append(own[:k].view(np.int64))
                sizes = np.array([len(x) for x in least])
                flat = pa.array(np.concatenate(least) if least else np.zeros(0, np.int64))
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), sketch], names=["doc_id", "n_shingles", "set_key", "sketch"])
        give_back()

    return docs.select("doc_id", text).mapInArrow(run, SKETCHES)


def _lists(sets: DataFrame, k: int, least_shared: int) -> DataFrame:
    """(value, doc_id, n, score) for the first values of each sketch, the rarest first; values of one sketch alone make no list.

    Two sets that share LEAST_SHARED values of their sketches share MEETINGS of these (or all, where sets are smaller).
    The score, the mean count of a sketch's values, is highest for the set at the centre of a group of copies. Counts are
    exact, whatever the table's size: an order that knows the commonest values only has all others meet in long lists.
    """
    flat = sets.select("row", F.explode("sketch").alias("value"))
    times = cut_lineage(flat.groupBy("value").agg(F.count("*").alias("times")).where("times > 1"))
    # a row's values that other sketches have too, the rarest first; those before them are its own
    met = cut_lineage(flat.join(times, "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("met")))
    let_go(times)
    size = F.size("sketch")
    shared = F.least(F.when(size < k, F.ceil(PERCENT * size / 100)).otherwise(least_shared), F.lit(least_shared))
    kept = size - shared + F.least(F.lit(MEETINGS), shared) - (size - F.size("met"))
    score = ((size - F.size("met") + F.aggregate("met", F.lit(0).cast("bigint"), lambda total, x: total + x["times"])) / size).alias("score")
    held = sets.join(met, "row").select("doc_id", F.col("n_shingles").alias("n"), score, F.slice("met", F.lit(1), F.greatest(kept, F.lit(0)).cast("int")).alias("met"))
    entries = cut_lineage(held.select("doc_id", "n", "score", F.explode("met.value").alias("value")).select("value", "doc_id", "n", "score"))
    let_go(met)
    return entries


def _estimated(pairs: DataFrame, sets: DataFrame, k: int, least_shared: int) -> DataFrame:
    """Pairs (a, b) whose union sketch shows enough values in both; exact where the union is smaller than the sketch."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = both.where((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("s_a"), batch.column("s_b"), strict=True)):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                either, counts = np.unique(np.concatenate([x, y]), return_counts=True)
                in_both = int((counts[:k] == 2).sum())
                keep[i] = in_both >= (-(-PERCENT * len(either) // 100) if len(x) < k and len(y) < k and len(either) <= k else min(least_shared, len(either)))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return sized.select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text: str | None, size: int) -> set:
    found = _WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    if len(found) < size:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(size)), strict=False))


def _needed(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """doc_id and text of at least the documents wanted.

    A bit per hashed id, BITMAP_WORDS long words at most, lets most texts that nothing needs stay where they are; what
    passes by chance is dropped by the join that follows.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_WORDS * 64))
    bits = wanted.select(place.alias("place")).groupBy(F.expr("cast(place div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).collect()
    bitmap = np.zeros(BITMAP_WORDS, np.int64)
    bitmap[[r["w"] for r in bits]] = [r["bits"] for r in bits]
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = (sent.value[at // 64].view(np.uint64) >> (at % 64).astype(np.uint64)) & np.uint64(1)
            yield batch.select(["doc_id", text]).filter(pa.array(hit.astype(bool)))

    return docs.select("doc_id", text, place.alias("place")).mapInArrow(needed, f"doc_id bigint, `{text}` string")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, size: int) -> DataFrame:
    """Each pair with the shingles both have, from the words themselves, and whether they reach the similarity.

    The pairs of an ``a`` are dealt into parts of about PAIRS_A_PART; its text goes once to each part and every ``b``'s text
    once to its pair, one text a row, so neither a row nor a task holds more than a part needs.
    """
    pairs = cut_lineage(pairs)
    texts = _needed(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), text)
    parts = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIRS_A_PART)).cast("int")
    dealt = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", parts.alias("part"))
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col(text).alias("t"))
    leads = dealt.select("a", "part").distinct().join(side("a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "t")
    asked = dealt.join(side("b"), "b").select("a", "part", "b", "t")
    met = leads.union(asked).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []  # the sets of a part's a: one, or more where the id repeats with other texts
        for batch in batches:
            out = []
            for a, part, b, t in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("b").to_pylist(), batch.column("t"), strict=True):
                if (a, part) != last:
                    last, own = (a, part), []
                other = shingle_set(t.as_py(), size)
                if b is None:
                    own.append(other)
                    continue
                for one in own:
                    both = len(one & other)
                    out.append((a, b, both, both > 0 and 100 * both >= PERCENT * (len(one) + len(other) - both)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "shared", "linked"])
        own = other = None
        give_back()

    found = cut_lineage(met.mapInArrow(check, "a bigint, b bigint, shared bigint, linked boolean").groupBy("a", "b").agg(F.max("shared").alias("shared"), F.max("linked").alias("linked")))
    let_go(pairs)
    return found


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b: common values by one matrix product, the rest one by one."""
    out = np.zeros((len(a), len(b)), np.int64)
    value = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b)]
    both = np.intersect1d(value[0], value[1])
    if not len(both):
        return out
    column = []
    for k in range(2):
        at = np.minimum(np.searchsorted(both, value[k]), len(both) - 1)
        hit = both[at] == value[k]
        order = np.argsort(at[hit], kind="stable")
        column.append((at[hit][order], row[k][hit][order]))
    counts = [np.bincount(c[0], minlength=len(both)) for c in column]
    dense = np.flatnonzero(counts[0] * counts[1] > 512)
    for low in range(0, len(dense), 4096):
        part = dense[low : low + 4096]
        sides = []
        for k, n in enumerate((len(a), len(b))):
            at = np.minimum(np.searchsorted(part, column[k][0]), len(part) - 1)
            hit = part[at] == column[k][0]
            ones = np.zeros((n, len(part)), np.float32)
            ones[column[k][1][hit], at[hit]] = 1
            sides.append(ones)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    begin = [np.cumsum(c) - c for c in counts]
    light = np.ones(len(both), bool)
    light[dense] = False
    light = np.flatnonzero(light)
    total = counts[0][light] * counts[1][light]
    which = np.repeat(light, total)
    k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    np.add.at(out, (column[0][1][begin[0][which] + k // counts[1][which]], column[1][1][begin[1][which] + k % counts[1][which]]), 1)
    return out


def _in_blocks(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """Rows of crowds for each pair of a block of a lead's strangers (asks) and one of its members, about ``most`` rows each."""
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.ceil(F.col(n) / most)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / most) - 1).cast("int")))
    asking = rows.where("stranger").select("lead", block("strangers").alias("s"), every("members").alias("o"), F.lit(True).alias("asks"), "doc_id", "own", *columns)
    asked = rows.select("lead", every("strangers").alias("s"), block("members").alias("o"), F.lit(False).alias("asks"), "doc_id", "own", *columns)
    return asking.union(asked).groupBy("lead", "s", "o")


def _partnered(crowd: DataFrame, sets: DataFrame, least_shared: int) -> DataFrame:
    """(lead, doc_id) of strangers and members of other components whose sizes and sketches leave a link between them open.

    The rest of a crowd, which has no more than a passage in common, needs no full set in any block.
    """

    def match(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = np.array(group.column("asks").to_pylist(), bool)
        ids, own, n = (group.column(c).to_numpy() for c in ("doc_id", "own", "n_shingles"))
        sets = [x.values.to_numpy() for x in group.column("sketch")]
        held = np.array([len(v) for v in sets])
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = shared_counts([sets[i] for i in x], [sets[i] for i in y])
        # what both retain is at least what the union's sketch shows, and the union is no smaller than either
        needed = np.minimum(least_shared, -(-PERCENT * np.maximum(held[x][:, None], held[y][None, :]) // 100))
        hit = (found >= needed) & (100 * np.minimum(n[x][:, None], n[y][None, :]) >= PERCENT * np.maximum(n[x][:, None], n[y][None, :])) & (own[x][:, None] != own[y][None, :])
        met = np.unique(np.concatenate([ids[x][hit.any(1)], ids[y][hit.any(0)]]))
        return pa.table([pa.array(np.full(len(met), group.column("lead")[0].as_py(), np.int64)), pa.array(met)], names=["lead", "doc_id"])

    rows = crowd.join(sets.select("doc_id", "n_shingles", "sketch"), "doc_id")
    return _in_blocks(rows, WIDE_BLOCK, "n_shingles", "sketch").applyInArrow(match, "lead bigint, doc_id bigint").distinct()


def _hot_links(clusters: DataFrame, hot: DataFrame, sets: DataFrame, docs: DataFrame, text: str, size: int, least_shared: int) -> DataFrame:
    """Pairs (a, b) that join the components of crowded leads: strangers against all members, in blocks: of sketches first,
    then of the full sets of those that these leave.

    clusters: lead, doc_id, own, stranger; hot: lead, members, strangers. No pair leaves a task but those that join two
    components which no other pair of the task has joined.
    """
    every = cut_lineage(clusters.drop("crowded").join(hot, "lead").where("doc_id <> lead"))
    left = every.drop("members", "strangers").join(_partnered(every, sets, least_shared), ["lead", "doc_id"], "left_semi")
    left = cut_lineage(left)
    let_go(every)
    crowd = cut_lineage(left.join(left.groupBy("lead").agg(F.count("*").alias("members"), F.count_if("stranger").alias("strangers")), "lead"))
    let_go(left)

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, text)):
            hashes, begin = shingle_hashes(*flat_bytes(batch.column(text)), size)
            held = [np.unique(hashes[low:high]).tobytes() for low, high in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.binary())], names=["doc_id", "full"])
        give_back()

    full = _needed(docs, crowd.select("doc_id"), text).mapInArrow(full_sets, "doc_id bigint, full binary")
    rows = crowd.join(full, "doc_id")

    def match(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), bool)
        ids, own = group.column("doc_id").to_numpy(), group.column("own").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("full").to_pylist()]
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = shared_counts([sets[i] for i in x], [sets[i] for i in y])
        n = np.array([len(v) for v in sets])
        hit = (100 * found >= PERCENT * (n[x][:, None] + n[y][None, :] - found)) & (found > 0) & (own[x][:, None] != own[y][None, :])
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        out = []
        for i, j in zip(*np.nonzero(hit), strict=True):
            p, q = top(int(own[x[i]])), top(int(own[y[j]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((min(ids[x[i]], ids[y[j]]), max(ids[x[i]], ids[y[j]])))
        return pa.table([pa.array([k[c] for k in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    joining = cut_lineage(_in_blocks(rows, BLOCK, "full").applyInArrow(match, "a bigint, b bigint").distinct())
    let_go(crowd)
    return joining


#: A lead with more members than this in one list has its strangers matched in blocks of WIDE_BLOCK sketches and BLOCK sets.
CROWD, BLOCK, WIDE_BLOCK = 128, 256, 1024
#: Pairs of one text that are verified together.
PAIRS_A_PART = 64
BITMAP_WORDS = 1 << 17


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, k: int = SKETCH, least_shared: int = LEAST_SHARED) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links) and kept, a row for each input row.

    A step's table goes when nothing reads it again; the sketches of the sets stay to the last estimate, and small tables beside them.
    """
    found = cut_lineage(sketches(docs, text, size, k))
    sets = cut_lineage(found.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch")).withColumn("row", F.monotonically_increasing_id()))
    rows = cut_lineage(found.select("doc_id", "n_shingles", "set_key"))
    let_go(found)
    classes = cut_lineage(sets.select("set_key", F.col("doc_id").alias("class_id")))
    entries = _lists(sets, k, least_shared)
    lead = F.max(F.struct("score", (-F.col("doc_id")).alias("minus"), "n"))
    leads = cut_lineage(entries.groupBy("value").agg(lead.alias("lead"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.count("*") > CROWD).alias("crowded")).where("low < high").select("value", (-F.col("lead.minus")).alias("lead"), F.col("lead.n").alias("lead_n"), "crowded"))
    listed = cut_lineage(entries.drop("score").join(leads, "value"))
    let_go(entries, leads)
    alike = lambda x, y: 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)  # noqa: E731  sizes further apart cannot link
    stars = listed.where(F.col("doc_id") != F.col("lead")).where(alike("n", "lead_n")).select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    tested = _verified(_estimated(stars, sets, k, least_shared), docs, text, size)
    links = cut_lineage(tested.where("linked").select("a", "b"))
    named = components(links)
    known = named.select(F.col("id").alias("doc_id"), F.col("component").alias("own"))
    overlap = tested.select(F.col("a").alias("lead"), F.col("b").alias("doc_id"), F.col("shared").alias("c"))
    tagged = listed.drop("lead_n").join(overlap, ["lead", "doc_id"], "left").join(known, "doc_id", "left").select("value", "crowded", "lead", "doc_id", "n", "c", F.coalesce("own", "doc_id").alias("own"))
    tagged = cut_lineage(tagged)
    let_go(listed, tested)
    led = tagged.where("doc_id = lead").select("value", F.col("own").alias("lead_own"))
    others = cut_lineage(tagged.join(led, "value").select("value", "crowded", "lead", "doc_id", "n", "c", "own", (F.col("own") != F.col("lead_own")).alias("stranger")))
    let_go(tagged)
    clusters = cut_lineage(others.groupBy("lead", "doc_id").agg(F.min("own").alias("own"), F.bool_or("stranger").alias("stranger"), F.bool_or("crowded").alias("crowded")))
    members = clusters.groupBy("lead").agg(F.count("*").alias("members"), F.count_if("stranger").alias("strangers"), F.bool_or("crowded").alias("crowded"))
    # many members in short lists are not crowded: their lists' pairs are few, where all their full sets would be many
    hot = cut_lineage(members.where(F.col("crowded") & (F.col("strangers") > 0)).drop("crowded"))
    joining = _hot_links(clusters, hot, sets, docs, text, size, least_shared) if hot.take(1) else links.limit(0)
    let_go(clusters)
    cool = others.where("doc_id <> lead").join(hot.select("lead"), "lead", "left_anti")
    mixed = cut_lineage(cool.where("stranger").select("value").distinct())
    met = cut_lineage(cool.join(mixed, "value", "left_semi"))
    let_go(others, mixed)
    strangers = met.where("stranger").select("value", F.col("doc_id").alias("x"), F.col("n").alias("x_n"), F.col("c").alias("x_c"), F.col("own").alias("x_own"))
    # Shared by x and y: at most min(c) of the lead's shingles and min(n - c) others; unknown c bounds nothing.
    most = F.coalesce(F.least("c", "x_c") + F.least(F.col("n") - F.col("c"), F.col("x_n") - F.col("x_c")) + F.col("c") * 0 + F.col("x_c") * 0, F.least("n", "x_n"))
    able = (100 + PERCENT) * most >= PERCENT * (F.col("n") + F.col("x_n"))
    cross = met.join(strangers, "value").where("own <> x_own and (not stranger or doc_id < x)").where(alike("n", "x_n") & able)
    pairs = cross.groupBy(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).agg(F.count("*").alias("meetings"), F.min(F.least("n", "x_n")).alias("least"))
    more = pairs.where(F.col("meetings") >= F.least(F.lit(MEETINGS), F.col("least"))).select("a", "b")
    close = cut_lineage(_estimated(more, sets, k, least_shared))
    let_go(met, sets)
    extra = _verified(close.union(joining).distinct(), docs, text, size).where("linked").select("a", "b")
    if extra.take(1):
        named = components(links.union(extra))
    heads = cut_lineage(classes.join(named.withColumnRenamed("id", "class_id"), "class_id", "left").select("set_key", F.coalesce("component", "class_id").alias("component_id")))
    let_go(classes, links, hot, close)
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = rows.where("n_shingles > 0").join(heads, "set_key").select("doc_id", "n_shingles", "component_id")
    return joined.union(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def oracle_sql() -> str:
    """All pairs of documents that share a shingle, for tables small enough for that; components by reachable ids."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM words),
shingles AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::bigint AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
