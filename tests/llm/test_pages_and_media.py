"""HTML text, URL verdicts, license notices and TIFF media against hand-made cases and round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

from sessionloom.llm import html_text, license_scan, tiff_media, url_filter

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- ad --><div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p>First  <b>bold</b>
 words &eacute;<br>next line<p>Short.</article><aside>side</aside><form><input>Send</form>
<section id="comments"><p>nice</p></section><footer>(c)</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst bold words é\nnext line\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""


def test_main_text_beside_a_long_section():
    """Titles, leads and short closing parts stay, however long the part beside them is."""
    long = "long body of text " * 200
    body = long.strip()
    assert html_text.main_text(f"<article><h1>Title</h1><p>short lead</p><section><p>{long}</section></article>") == f"Title\nshort lead\n{body}"
    assert html_text.main_text(f"<article><section>{long}</section><section>The end.</section></article>") == f"{body}\nThe end."
    assert html_text.main_text(f"<body><div><h2><a href='/'>Title</a></h2><div>lead</div><div><p>{long}</div><div>The end.</div></div>") == f"Title\nlead\n{body}\nThe end."
    assert html_text.main_text(f"<main><h1>Title</h1><article>{long}</article></main>") == f"Title\n{body}"
    assert html_text.main_text(f"<body><div><a href='/a'>One</a> | <a href='/b'>Two</a></div><div><p>{long}</div>") == body
    assert html_text.main_text(f"<body><div>Call us</div><article><p>{long}</article>") == body


def test_main_text_in_marked_wrappers():
    """One word in a wrapper's class, or an open head, does not lose the page."""
    text = "Some words of the page, some more of them."
    for page in (
        f"<body><div class='layout has-sidebar'><nav>menu</nav><p>{text}</div>",
        f"<body><div class='post category-social'><p>{text}</div><div class='newsletter'>Join the list now</div>",
        f"<body><div class='sidebar'><div class='ad'>Buy</div><p>{text}</div>",
        f"<body><div class='modal'><article><p>{text}</article></div><aside><p>{text * 9}</aside>",
        f"<article>{text}</article><div class='ad'>{text * 3}</div>",
        f"<form id='aspnet'><div class='menu'>One</div><p>{text}</form>",
        f"<html><head><title>T</title><meta name=a><body><p>{text}",
        f"<head><style>p{{}}</style><p>{text}",
        f"<head><title>T</title>{text}",
        f"<div class='comments'><main>{text}</main><article class='comment'>nice</article></div><div hidden>{text}</div>",
    ):
        assert html_text.main_text(page) == text, page
    assert html_text.main_text(f"<div class='sidebar'><h1>T</h1><article><p>{text}</article></div>") == f"T\n{text}"
    assert html_text.main_text(f"<p>{text}<div id='comments'><article>{text * 3}</article></div>") == text
    assert html_text.main_text(f"<p>{text}<div class='site-footer'>x</div><div class='Side-Bar'>x</div><div id='comment-list'>x</div>") == text


def test_the_threshold_parts_links_from_text():
    """A list of links in plain elements goes where its ratio is low, and only there: without the threshold this fails."""
    text = "Some words of the page, some more of them, and so on to the end of a line of text. " * 3
    links = "".join(f"<a href='/{k}'>Item {k}</a><br>" for k in range(6))
    page = f"<body>{links}<p>{text}<p>{text}</p>{links}</body>"
    body = text.strip()
    assert html_text.main_text(page) == f"{body}\n{body}"
    assert html_text.main_text(f"<article><p>{text}</p>{links}</article>").count("Item") == 6
    keep = html_text.threshold
    try:
        html_text.threshold = lambda values: -1.0
        assert html_text.main_text(page).count("Item") == 12
    finally:
        html_text.threshold = keep


def test_open_elements_lose_no_article_text():
    """Ends that are missing, and marked elements inside a sentence."""
    body = " ".join(f"Sentence number {n} tells a little more about the river and its many stones." for n in range(6))
    assert html_text.main_text(f"<nav><a href=1>x</a><div><article><p>{body}</p></article></div>") == body
    for tail in ("<button>Click", "<span class='share'>Share", "<span hidden>no"):
        got = html_text.main_text(f"<article><p>{body}</p><p>Good text here to the very end of it {tail}</p><p>{body}</p></article>")
        assert got.startswith(body) and "Good text here to the very end of it" in got and "no" not in got.split()
    inside = html_text.main_text(f"<article><p>{body}</p><p>Text of the tale <span hidden>secret</span><button>Click</button> goes on here</p></article>")
    assert inside == f"{body}\nText of the tale goes on here"


def test_pages_of_very_many_tags():
    """End tags without a start cost no walk over the open elements."""
    import time

    began = time.process_time()
    got = html_text.main_text("<div>" * 2000 + "<p>" + "<i>" * 100_000 + "</b>" * 100_000 + "the only words here")
    assert "the only words here" in got and time.process_time() - began < 20


def test_known_articles(spark):
    """Pages made around known articles: the query gives exactly their blocks."""
    import random

    rng, rows, want = random.Random(5), [], {}
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    for k in range(60):
        blocks = [line(rng.randint(3, 8)), *(line(rng.randint(8, 60)) for _ in range(rng.randint(2, 7)))]
        menu = "".join(f"<li><a href='/{word()}'>{word()}</a>" for _ in range(6))
        holder = rng.choice(["article", "main", "div class='content'", "div"])
        body = f"<{holder}><h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:]) + f"</{holder.split()[0]}>"
        extra = rng.choice([f"<aside>{line(30)}</aside>", f"<div class='ad'>{line(9)}</div>", f"<form><input>{line(4)}</form>", "<script>x('<p>')</script>", f"<section id='comments'><p>{line(40)}</section>"])
        rows.append((k, f"http://h/{k}", f"<html><head><title>{blocks[0]}</title></head><body><nav><ul>{menu}</ul></nav>{body}{extra}<footer>{line(5)}</footer></body></html>", "x"))
        want[k] = "\n".join(blocks)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (2, None, None, 5), (3, "u", "<p>" + "long text " * 200_000, 5)], "page_id long, url string, html string, n_chars int")
    rows = html_text.extract(pages).orderBy("page_id").collect()
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows] and rows[3].n_chars == 1_999_999
    assert html_text.extract(pages.limit(0)).count() == 0


def test_rules_and_hosts(spark):
    urls = ["http://Example.COM/en/7?x", "https://a.example.com/en/8#y", "x://fr.net/de/1", "x://example.net/de/85", "no scheme", None, "x://my.org/es/", "x://orgs/es/", "://h"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [
        ("example.com", "/en/7", "example.com/en/7", "allow"),
        ("a.example.com", "/en/8", "com/en/", "block"),
        ("fr.net", "/de/1", "net/de/", "allow"),
        ("example.net", "/de/85", "example.net/de/8", "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("my.org", "/es/", "org/es/", "block"),
        ("orgs", "/es/", None, "allow"),
        ("h", "", None, "allow"),
    ]


def test_templates_learn_from_ruled_pages(spark):
    """Pages of a template whose labelled pages are blocked are rejected, though no rule fits them."""
    rules = [("bad.com", "/list/1", "block"), ("bad.com", "/ok/1", "allow")]
    urls = [f"http://bad.com/list/{n}" for n in range(200)] + [f"http://bad.com/ok/{n}" for n in range(200)] + ["http://bad.com/new"]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=rules).collect()}
    assert got["http://bad.com/list/99"] == "block" and got["http://bad.com/ok/99"] == "allow" and got["http://bad.com/new"] == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_unlabelled_templates_take_their_family(spark):
    """Pages without a rule are blocked where the pages beside them are, and left alone where those are mixed."""
    rules = [("bad.com", "/a/list/1", "block"), ("bad.com", "/a/more/1", "block"), ("mixed.com", "/a/x", "block"), ("mixed.com", "/a/y", "allow")]
    urls = [f"http://bad.com/a/{s}/{n}" for s in ("list", "more") for n in range(10, 20)] + ["http://bad.com/a/new/5", "http://bad.com/other"]
    urls += [f"http://mixed.com/a/{s}/{n}" for s in "xyz" for n in range(10)] + ["http://none.com/a/1"]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame([(u, "t", "v") for u in urls], "url string, template string, verdict string"), rules=rules).collect()}
    assert got["http://bad.com/a/new/5"] == "block" and got["http://bad.com/other"] == "block"
    assert got["http://mixed.com/a/z/3"] == "allow" and got["http://none.com/a/1"] == "allow"


def test_templates_go_as_deep_as_paths(spark, tmp_path):
    """Branches that part below many shared segments are judged apart; the SQL goes as deep."""
    import duckdb

    top = "http://bad.com/a/b/c/d/e/f"
    urls = [f"{top}/{s}/{k}/w{n % 40}x/{n}" for s in ("spam", "good") for k in ("k", "m") for n in range(100)] + ["http://short.com", f"{top}/spam", "http://deep.com/" + "/".join("abcdefghij" * 3)]
    rules = [("bad.com", "/a/b/c/d/e/f/spam/k/w1", "block"), ("bad.com", "/a/b/c/d/e/f/good/k/w1", "allow")]
    got = {r.url: (r.verdict, r.template) for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules=rules).collect()}
    assert got[f"{top}/spam/k/w2x/2"][0] == "block" and got[f"{top}/good/k/w2x/2"][0] == "allow"
    assert got[f"{top}/spam/m/w2x/2"][1] != got[f"{top}/good/m/w2x/2"][1] and got[urls[-1]] == ("allow", "deep.com/" + "/".join("abcdefghij" * 3))
    deep = [f"http://www.site{n % 2}.com/en/{n % 9}/b/c/d/{'xyz'[n % 3]}/{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}/q{'abc'[n % 3]}" for n in range(600)]
    spark.createDataFrame(list(enumerate(deep + deep[:20] + [None, ""])), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = url_filter.op7_url_filter(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = con.execute(url_filter.oracle_sql())
        names = [d[0] for d in want.description]
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    assert any("*" in r.template.split("/") for r in df.where("template is not null").collect())


def test_url_query_equals_its_sql(spark):
    import duckdb

    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        df = url_filter.op7_url_filter(spark, sf_dir)
        with duckdb.connect() as con:
            con.execute(f"create view pages as select * from read_parquet('{sf_dir}/pages.parquet')")
            got = con.execute(url_filter.oracle_sql())
            names = [d[0] for d in got.description]
            want = sorted(map(str, got.fetchall()))
        assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == want


def test_license_texts_over_many_lines():
    """Whole texts wrapped at any width, with phrases across line breaks, are one block and one notice."""
    import textwrap

    for name, (notice, _) in license_scan.TEMPLATES.items():
        for width in (24, 60, 100_000):
            text = "Vorher steht etwas anderes hier\n\n" + "\n".join(textwrap.wrap(notice, width, break_long_words=False, break_on_hyphens=False)) + "\n\nUnd danach etwas"
            found = [m for low, high in license_scan.candidate_blocks(text) for m in license_scan.scan_block(text[low:high])]
            assert name in [m[0] for m in found], (name, width, found)


def test_long_lines_join_a_block_by_all_their_words():
    """What counts is the whole neighbouring line, not how it begins."""
    words = " ".join(sorted(w for w in license_scan._template_words() if w.isalpha() and not license_scan._TRIGGER.search(w)))
    assert not license_scan._TRIGGER.search((words + " ") * 2)
    like, unlike = (words + " ") * 8, (words + " ") * 3 + "river stone cloud meadow " * 3000
    assert len(like) > 4000 < len((words + " ") * 3) and license_scan._fits(like) and not license_scan._fits(unlike)
    notice = "Licensed under CC BY 4.0"
    assert license_scan.candidate_blocks(f"{unlike}\n{notice}\n{unlike}")[0][0] == len(unlike) + 1
    assert license_scan.candidate_blocks(f"{like}\n{notice}")[0][0] == 0


def test_licenses(spark):
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0\nmore"), (2, "Released under the MIT License. All rights reserved."), (3, "a driving license is needed"), (4, None), (5, ""), (6, "filler " * 200_000 + "\nThis work is licensed under the GNU General Public License, version 3"), (7, "This work is licensed under the GNU General Public License, version 2")]
    got = {r.doc_id: sorted(m.license for m in r.matches) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["ARR", "MIT"], 3: [], 4: [], 5: [], 6: ["GPL-3.0"], 7: ["GPL-2.0"]}
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_of_low_rank():
    """A notice is found wherever the compression ranks it."""
    lines = {
        "See the GNU General Public License, version 3, for more details. All rights reserved.": ["ARR"],
        "You may redistribute it under the GNU General Public License, version 2 or any later one, subject to the terms of use. Copyright 2020 Acme. All rights reserved.": ["ARR"],
    }
    ranks = [[name for name, _ in license_scan.ranked(license_scan.block_words(line))].index("ARR") for line in lines]
    assert min(ranks) >= 6
    assert {line: [name for name, *_ in license_scan.scan_block(line)] for line in lines} == lines


def test_tiff_codecs():
    rng = np.random.default_rng(4)
    for data in (b"", b"a", b"aaaa" * 300, bytes(rng.integers(0, 256, 5000, np.uint8)), b"abcabcabd" * 700):
        assert tiff_media.packbits_decode(tiff_media.packbits_encode(data)) == data
        assert tiff_media.lzw_decode(tiff_media.lzw_encode(data)) == data


def test_files_of_every_kind(spark):
    """Strips and tiles, all codecs, both byte orders, predictors and several pages give their samples back, a row a page."""
    rng = np.random.default_rng(6)
    images = [rng.integers(0, 256, (37, 50), np.uint8), np.zeros((70, 16), np.uint8), np.tile(np.arange(90, dtype=np.uint8), (33, 1))]
    files, want = [], {}
    for compression in (tiff_media.NONE, tiff_media.LZW, tiff_media.DEFLATE, tiff_media.PACKBITS):
        for predictor in (1, 2):
            for tile in (0, 16):
                for order in "<>":
                    want[len(files)] = compression
                    files.append((len(files), tiff_media.write(images, compression, predictor, tile, 16, order), 3))
    whole = tiff_media.write(images[:1])
    broken = [b"", b"II", b"no tiff at all", whole[: len(whole) // 2], whole[:8], b"II*\0\x08\0\0\0\x01\0" + b"\xff" * 12 + b"\0\0\0\0"]
    ring = bytearray(whole)
    at = int.from_bytes(ring[4:8], "little")
    count = int.from_bytes(ring[at : at + 2], "little")
    ring[at + 2 + 12 * count : at + 6 + 12 * count] = ring[4:8]
    rows = files + [(100 + k, data, 3) for k, data in enumerate([*broken, bytes(ring)])] + [(200, None, 3)]
    found = tiff_media.page_rows(spark.createDataFrame(rows, "id long, media binary, page int")).collect()
    by_id: dict[int, list] = {}
    for r in found:
        by_id.setdefault(r.id, []).append(r)
    for k, compression in want.items():
        pages = sorted(by_id[k], key=lambda r: r.page)
        assert [(p.page, p.width, p.height, p.compression, bytes(p.samples)) for p in pages] == [(n, i.shape[1], i.shape[0], compression, i.tobytes()) for n, i in enumerate(images)]
    for k in range(len(broken)):
        assert [(r.page, bool(r.error)) for r in by_id[100 + k]] == [(None, True)], broken[k][:20]
    assert any(r.error for r in by_id[100 + len(broken)]) and 200 not in by_id
    assert tiff_media.page_rows(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_hostile_files_are_one_row(spark):
    """Sizes beyond the bytes at hand, tags without values or sizes, streams that grow: each an error row, none ends the job."""
    import struct

    def made(tags: dict[int, list[int] | None], body: bytes = b"") -> bytes:
        out = b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + struct.pack("<H", len(tags))
        for tag in sorted(tags):
            out += struct.pack("<HHII", tag, 4, 1 if tags[tag] else 0, (tags[tag] or [0])[0])
        return out + b"\0\0\0\0"

    page = {256: [4], 257: [4], 258: [8], 259: [1], 273: [8], 278: [4], 279: [16]}
    body = bytes(range(16))
    bomb = zlib.compress(bytes(40_000_000), 9)
    files = {
        "sound": made(page, body),
        "vast": made(page | {256: [2**31], 257: [2**31], 278: [2**31]}, body),
        "no width": made(page | {256: None}, body),
        "zero": made(page | {257: [0]}, body),
        "no rows a strip": made(page | {278: None}, body),
        "no samples": made(page | {277: None}, body),
        "no tile size": made({k: v for k, v in page.items() if k not in (273, 278, 279)} | {324: [8], 325: [16]}, body),
        "vast tile": made({k: v for k, v in page.items() if k not in (273, 278, 279)} | {322: [2**31], 323: [2**31], 324: [8], 325: [16]}, body),
        "no places": made(page | {273: None}, body),
        "cut": made(page | {279: [15]}, body),
        "far": made(page | {273: [2**31]}, body),
    }
    rows = [(name, data) for name, data in files.items()] + [("bomb", made(page | {259: [8], 279: [len(bomb)]}, bomb))]
    got = tiff_media.page_rows(spark.createDataFrame(rows, "name string, media binary")).collect()
    assert len(got) == len(rows)
    by = {r.name: r for r in got}
    assert bytes(by["sound"].samples) == body and bytes(by["bomb"].samples) == bytes(16)
    assert [n for n, r in by.items() if r.error is None] == ["sound", "bomb"] and by["vast"].page is None
    short = zlib.compress(body)[:-2]
    assert tiff_media.page_rows(spark.createDataFrame([(made(page | {259: [8], 279: [len(short)]}, short),)], "media binary")).first().error


def test_decoders_stop_where_the_place_ends():
    data = b"ab" * 5000
    assert len(tiff_media.lzw_decode(tiff_media.lzw_encode(data), 100)) < 200
    assert len(tiff_media.packbits_decode(tiff_media.packbits_encode(data), 100)) < 300
    endless = b"\x80\x00" + b"\x55" * 50_000
    try:
        tiff_media.lzw_decode(endless, 1 << 20)
    except tiff_media.TiffError:
        pass


def test_files_of_many_pages_go_by_one_at_a_time(spark):
    """Digests over batches of one row are those of the whole file."""
    rng = np.random.default_rng(8)
    files = {k: [rng.integers(0, 256, (int(rng.integers(1, 40)), 64), np.uint8) for _ in range(k)] for k in (1, 2, 5)}
    frame = spark.createDataFrame([(k, tiff_media.write(images)) for k, images in files.items()], "id long, media binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = {r.id: r for r in tiff_media.media_digests(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, images in files.items():
        whole = b"".join(i.tobytes() for i in images)
        assert (got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert got[k].feature.startswith(f"pages={k};pixels={len(whole)};")


def test_media_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (3, "é" * 700_000, 9), (4, "x" * 64, 9)], "doc_id long, text string, feature int")
    rows = sorted(tiff_media.media_digests(tiff_media.media_column(docs)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_bytes, r.payload_bytes) for r in rows] == [(1, 0, 64), (2, 0, 64), (2, 0, 64), (3, 1_400_000, 1_400_000), (4, 64, 64)]
    assert rows[0].media_sha256 == rows[1].media_sha256 == rows[2].media_sha256 and rows[0].feature == "pages=1;pixels=64;mean=0.0000;sd=0.0000;zero=1.000000;bits=0.0000"
    assert rows[3].feature.startswith("pages=2;pixels=1400000;mean=182.0000;sd=13.0000;zero=0.000000;bits=1.0000")
    assert tiff_media.media_digests(tiff_media.media_column(docs.limit(0))).count() == 0


def test_media_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = tiff_media.op6_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature is not None
