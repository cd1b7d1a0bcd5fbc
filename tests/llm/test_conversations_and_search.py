"""The prefix trie, token alignment and top-k search against plain definitions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_queries import answers, rows
from tokenizers import Tokenizer

from sessionloom.llm import prefix_trie, queries, token_alignment, top_search

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1]) if node else 0
    hashed = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], hashed(ends[n])) for n, m in members.items())


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None and c == "parent_conv_id" else r[c] for c in names) for r in df.collect())


def some_turns(seed: int, convs: int = 260):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        hot = rng.random()
        line = ["hot"] * 7 if hot < 0.3 else ["hot", "hot", rng.choice("ab")] if hot < 0.6 else []
        for t, text in enumerate(line + [rng.choice(["x", "yy", "é漢", "", None]) for _ in range(rng.randrange(5))]):
            out.append((c, None if rng.random() < 0.02 else t, rng.choice(["user", "user", None]) if t > 3 else "user", text))
    return out + out[:9] + [(None, 1, "user", "nobody"), (7, 3, "user", "w" * 70_000), (900, 0, "user", "no head"), (100, 0, None, None)]


@pytest.mark.parametrize(("seed", "most"), [(1, 8192), (2, 40), (3, 3)])
def test_trie_equals_plain(spark, seed, most):
    turns = some_turns(seed)
    df = spark.createDataFrame([(*t, 5) for t in turns], TURNS + ", n_convs int")
    got = prefix_trie.trie(prefix_trie.classes(prefix_trie.rebuilt(prefix_trie.turn_lists(df))), most)
    assert trie_rows(got) == plain_trie(turns)


def test_trie_of_many_copies_and_one_long_trunk(spark):
    turns = [(c, t, "user", f"{t}") for c in range(0, 6000, 100) for t in range(40)] + [(c, 40 + t, "user", f"{c % 300} {t}") for c in range(0, 6000, 100) for t in range(9)]
    df = spark.createDataFrame(turns, TURNS)
    assert trie_rows(prefix_trie.trie(prefix_trie.classes(prefix_trie.rebuilt(prefix_trie.turn_lists(df))), 30)) == plain_trie(turns)


def test_ids_of_copies_are_hashed_over_all_spans(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_SPAN", 64)
    turns = [(c, 0, "user", "same") for c in [-5, *range(0, 90_000, 7), 1 << 40]]
    df = spark.createDataFrame(turns, TURNS)
    assert trie_rows(prefix_trie.trie(prefix_trie.classes(prefix_trie.turn_lists(df))))[1][-1] == hashlib.sha256(",".join(str(t[0]) for t in turns).encode()).hexdigest()


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.classes(prefix_trie.rebuilt(prefix_trie.turn_lists(empty)))).count() == 0
    only = spark.createDataFrame([(102, 0, "user", "taken away")], TURNS)  # its head is absent, its own turn is in the head
    assert trie_rows(prefix_trie.trie(prefix_trie.classes(prefix_trie.rebuilt(prefix_trie.turn_lists(only))))) == plain_trie([(102, 0, "user", "taken away")])


def plain_alignment(texts):
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    bytes_a = token_alignment.byte_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    per_text, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        names = [b.id_to_piece(k) for k in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" and p[5] == ">" else p.replace("▁", " ").encode() for p in names]
        raw_a, whole = [bytes_a[k] for k in ids_a], (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            per_text.append(None)
            continue
        ends_a, ends_b = np.cumsum([*map(len, raw_a)]), np.cumsum([*map(len, raw_b)])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, low = [], 0
        for high in cuts:
            groups.append(([i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= high], [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= high]))
            low = high
        links = [(i, j) for i, ea, ra in zip(ids_a, ends_a, raw_a, strict=True) for j, eb, rb in zip(ids_b, ends_b, raw_b, strict=True) if ea - len(ra) < eb and eb - len(rb) < ea]
        counts.update(links)
        per_text.append((len(ids_a), len(ids_b), groups, links))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    out = []
    for row in per_text:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [None, "", " ", "a", "  a  b ", "▁x ▁", "a\n\nb\tc", "\nfoo", "x\nfoo", " \n foo", "é漢字  x　y", "emoji 🙂🙂 don't", "<|endoftext|> <s> <0x41> <unk>", "a\x00b \x1c c", "x" * 900, "a\r\nb", "end ", "İstanbul ﬁ", "1,234.5 ...", " x y", "the the the"]


def test_alignment_equals_plain(spark, sf_dir):
    rng = random.Random(4)
    alphabet = ["a", "the", " ", " ", "\n", "é", "漢", "🙂", "▁"[:0], "\t", "'s", "1", ".", " ", "ing", "\x1c", "́"]
    texts = ODD + ODD[:6] + ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(400)]
    texts += [t[:1500] for (t,) in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(25).collect()]
    docs = spark.createDataFrame([(k % 410, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(5)
    want = sorted(zip([k % 410 for k in range(len(texts))], plain_alignment(texts), strict=True))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for step in (300, 1 << 20):
        assert sorted((r.doc_id, tuple(r[c] for c in names)) for r in token_alignment.aligned(docs, step_bytes=step).collect()) == want
    shown = token_alignment.groups(docs.where("doc_id = 11")).first().groups
    assert [g.start for g in shown] == [0, *np.cumsum([g.length for g in shown])[:-1].tolist()] and all(g.a and g.b for g in shown)
    assert token_alignment.aligned(docs.limit(0)).count() == 0


def test_small_tables_start_anew():
    known = token_alignment.ChunkAlignments(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), rows=2)
    for words in ([" a", " b", " c"], [" a", " d"], [" b", " e", " f"], [" a"]):
        known.add(words)
        assert all(known.new[w][0] for w in words)


def test_components_are_minimal_groups():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 30)
        cut = lambda: sorted({n, *rng.sample(range(1, n + 1), rng.randrange(n) + 1 if n > 1 else 1)})  # noqa: B023, E731
        a, b = cut(), cut()
        i, j, in_a, in_b = token_alignment.overlap_groups(np.diff([0, *a]), np.diff([0, *b]))
        last = lambda ends, within: [ends[k] for k in np.flatnonzero(np.diff(within, append=-1))]
        assert last(a, in_a) == sorted(set(a) & set(b)) == last(b, in_b) and (in_a[i] == in_b[j]).all()
        spans = lambda ends: list(zip([0, *ends], ends, strict=False))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(i, j) for i, (p, q) in enumerate(spans(a)) for j, (r, s) in enumerate(spans(b)) if p < s and r < q]


def plain_search(vectors, k=10, step=100):
    kept = [(n, i, [int(np.floor(1024 * x)) if abs(x) < 2**50 else int(x) * 1024 for x in v]) for n, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in kept:
        if i % step == 0:
            score = lambda v: min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
            found = sorted((-score(v), j) for m, j, v in kept if m != n and len(v) == len(q))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


def found_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("values", [1 << 18, 200])
def test_search_equals_plain(spark, values):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    vectors = [(i, (centres[i % 5] + rng.normal(size=8) * 0.1 if i % 2 else rng.normal(size=8)).astype(np.float32).tolist()) for i in range(700)]
    vectors += vectors[100:103] + vectors[100:101] + [(701, None), (800, [1.0, None]), (900, [float("nan")] * 8), (1000, [0.0] * 8), (None, [1.0] * 8), (1100, []), (1101, []), (1200, [1.0, 2.0]), (1300, [float("inf")] * 8), (-100, [0.25] * 8)]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, score int")
    assert found_rows(top_search.top_search(df, block_values=values, query_values=values // 4, span=3)) == plain_search(vectors)
    assert top_search.top_search(df.limit(0)).count() == 0


def test_search_is_exact_beyond_doubles(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert found_rows(top_search.top_search(df, block_values=100)) == plain_search(vectors)
    vectors = [(0, [1e300, 1.0]), (1, [1.0, 1.0]), (2, [-1e300, 0.0]), (100, [3.0, -2.0])]
    assert found_rows(top_search.top_search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))) == plain_search(vectors)


def test_reading_stops_early_and_loses_nothing():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6)) * 0.01
    x[:40] += 1.0
    block = top_search.Lists.unpacked(top_search.Lists(np.arange(4000), np.arange(4000), x).packed())
    q = top_search.quantised(np.ones((1, 6)))[0]
    scores = block.x @ q
    left = top_search.read_lists(block, q, None, -1, 10)
    assert len(left) < 400 and set(np.argsort(-scores)[:10]) <= set(left.tolist())
    assert not len(top_search.read_lists(block, q, int(scores.max()) + 1, -1, 10))


@pytest.mark.parametrize("name", ["op2_near_dedup", "op10_embedding_dedup", "op11_prefix_trie", "op13_top_search"])
def test_query_equals_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == answers(queries.SQL[name], sf_dir)


def test_alignment_query_reads_whole_table(spark, sf_dir):
    got = queries.QUERIES["op12_token_alignment"](spark, sf_dir)
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got.count() == len(texts) and got.where("n_links > 0").count() == sum(bool(t) for _, t in texts)
