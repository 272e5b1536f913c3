"""Operators 1, 3, 4 and 6."""

from __future__ import annotations

import fnmatch
import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quirework.llm import html_text, quality_rules, tiff, url_rules
from tests.llm.helpers import docs, odd_rows, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# --- operator 1 -----------------------------------------------------------------------------


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.DEFLATE_OLD])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 64])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(scheme, predictor, tile, order):
    rng = np.random.default_rng(3)
    payloads = [prose(5, 400).encode()[:1280], b"a" * 6400, rng.integers(0, 256, 64 * 300, dtype=np.uint8).tobytes(), b"ab" * 32000]
    pages = list(tiff.read_pages(tiff.write_file(payloads, 64, scheme, predictor, tile, order=order)))
    assert [p.error for p in pages] == [None] * 4
    assert [p.pixels for p in pages] == payloads
    assert [p.number for p in pages] == [0, 1, 2, 3]


def test_sixteen_bit_and_float_predictors():
    x = np.arange(24, dtype="<u2").reshape(2, 4, 3) * 977
    step = x.copy()
    step[:, 1:] = x[:, 1:] - x[:, :-1]
    assert (tiff._undo(step, 2, "<") == x).all()
    f = np.linspace(-3, 7, 12, dtype=np.float32).reshape(2, 6, 1)
    planes = f.view("<u4").astype(">u4").view(np.uint8).reshape(2, 6, 4).transpose(0, 2, 1).reshape(2, 24)
    coded = planes.copy()
    coded[:, 1:] = planes[:, 1:] - planes[:, :-1]
    got = tiff._undo(coded.view("<u4").reshape(2, 6, 1), 3, "<")
    assert (np.ascontiguousarray(got).view(np.float32) == f).all()


def test_broken_files():
    good = tiff.write_page(b"a" * 640, 64, tiff.LZW)
    for bad in (None, b"", b"II*\0", b"PK\3\4" * 9, good[:40], good[:-30], good[:9] + b"\xff" * 20 + good[29:]):
        assert all(p.error for p in tiff.read_pages(bad)), bad
    looped = bytearray(good)
    looped[-4:] = looped[4:8]
    assert [p.error for p in tiff.read_pages(bytes(looped))] == [None, "directories loop"]


def test_many_pages_and_large_pages():
    n = 65_540
    many = struct.pack("<2sHI", b"II", 42, 8) + b"".join(struct.pack("<HI", 0, 8 + 6 * (i + 1) if i < n - 1 else 0) for i in range(n))
    pages = list(tiff.read_pages(many))
    assert [p.number for p in pages] == list(range(n)) and not any("loop" in p.error for p in pages)

    def file(width, height, data):
        tags = [(tiff.WIDTH, width), (tiff.HEIGHT, height), (tiff.BITS, 1), (tiff.COMPRESSION, tiff.DEFLATE), (tiff.STRIP_OFFSETS, 8), (tiff.ROWS_PER_STRIP, height), (tiff.STRIP_COUNTS, len(data))]
        return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)

    side = 1 << 15  # more than 2**30 samples of a bit
    (page,) = tiff.read_pages(file(side, side + 8, zlib.compress(bytes(side // 8 * (side + 8)), 1)))
    assert page.error is None and len(page.pixels) == side // 8 * (side + 8)
    (page,) = tiff.read_pages(file(side, side, zlib.compress(b"x")))
    assert "bad size" in page.error and not page.pixels


def test_tiff_query(spark, tmp_path):
    rows = odd_rows()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = tiff.query(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        _, media = tiff.store(text)
        want.append((doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    by_text = defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in by_text.values())


def test_tiff_pages_operator(spark):
    two = tiff.write_file([b"x" * 128, b"y" * 64], 64, tiff.PACKBITS)
    df = spark.createDataFrame([(1, two), (2, None), (3, b"junk junk")], "id long, file binary")
    rows = tiff.tiff_pages(df, "file", ["id"]).collect()
    assert sorted((r.id, r.page, r.error) for r in rows) == [(1, 0, None), (1, 1, None), (2, -1, "empty"), (3, -1, "not a TIFF file")]
    assert tiff.tiff_pages(df.limit(0), "file", ["id"]).count() == 0
    clash = tiff.tiff_pages(df.withColumnRenamed("id", "page"), "file", ["page"])
    assert clash.columns == ["page", *("tiff_page" if c == "page" else c for c in tiff.PAGE_COLUMNS)]
    assert sorted((r.page, r.tiff_page, r.error) for r in clash.collect()) == [(1, 0, None), (1, 1, None), (2, -1, "empty"), (3, -1, "not a TIFF file")]


# --- operator 3 -----------------------------------------------------------------------------

BODY = "It was the best of the times and it was the worst of the times, and all of us were going to the same place with the same people who had been there for a long time before we came to it, and no one of them was in a hurry to be anywhere else."


def test_main_text_templates():
    article = f"<article><h1>A title</h1><p>{BODY}<p>Er.<p>Yes &amp; no &copy; 2&nbsp;x<br>y</p><p>{BODY}</p></article>"
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>bad</p>";</script></head><body><header><p>Site name</p></header>'
        '<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies on all of the pages of this site and you have to agree to it.</div>'
        f'<!-- <p>gone</p> --><div class="ad">Buy now</div>{article}<aside>Related things</aside><form><p>Write to us</p></form><div id="comments"><p>{BODY} I am a reader.</p></div><footer>&copy; me</footer>'
    )
    want = f"A title\n{BODY}\nEr.\nYes & no © 2 x y\n{BODY}"
    assert html_text.main_text(page) == want
    assert html_text.main_text(page.replace("article>", "main>")) == want


def test_pages_without_marks():
    page = f'<body><div class="menu"><a href="a">One</a></div><div><p>{BODY}</p><p>Short one.</p><p>{BODY}</p></div><div><a href="x">a long list of links that leads to other places of this site and of others</a></div><p>{"qx " * 60}</p></body>'
    assert html_text.main_text(page) == f"{BODY}\nShort one.\n{BODY}"


def test_undecided_blocks_take_the_nearest_label():
    g, b, n, u = html_text.GOOD, html_text.BAD, html_text.NEAR_GOOD, html_text.UNDECIDED
    assert html_text.settle([g, u, u, b], [False] * 4) == [True, True, False, False]
    assert html_text.settle([b, u, b, u, g], [False] * 5) == [False, False, False, True, True]
    assert html_text.settle([b, n, g], [False] * 3) == [False, True, True]
    assert html_text.settle([u, n], [False] * 2) == [False, True]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "just text"), (4, "u", "<p"), (5, None, f"<article><p>{BODY}</p>" * 300), (5, None, "<article><p>&#x41;&#66; &amp</p>"), (None, "x", "</p></div><b>" + BODY)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html_text.extract_main_text(df).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id == 5} == {"\n".join([BODY] * 300), "AB &"}
    assert next(r.text for r in got if r.page_id is None) == BODY
    assert html_text.extract_main_text(df.limit(0)).count() == 0


# --- operator 4 -----------------------------------------------------------------------------


def brute_quality(text: bytes) -> tuple:
    words = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in text.split(b"\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = {}
    for n in quality_rules.NGRAM_LIMITS:
        held = defaultdict(list)
        for i in range(len(words) - n + 1):
            held[tuple(words[i : i + n])].append(i)
        inside = {j for at in held.values() if len(at) > 1 for i in at for j in range(i, i + n)}
        grams[n] = sum(len(words[j].decode()) for j in inside)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c.encode()) for c in "#*$%&|<>"), dup, len(repeated), grams


def test_quality_counts_and_verdicts(spark):
    rows = odd_rows() + [(20, prose(1, 90) + "\n" + prose(1, 90)), (21, "\n".join(["same line of a few words here now"] * 30 + [prose(9, 100)])), (22, prose(8, 100).replace(" ", "### ")), (23, prose(11, 300))]
    got = quality_rules.quality_rules(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append(r)
    for doc_id, text in rows:
        n, chars, symbols, dup, repeated, grams = brute_quality((text or "").encode())
        base = n < 50 or 100 * repeated > 50 * n
        match = [r for r in found[doc_id] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated) and all(r[f"dup_{k}gram_chars"] == v for k, v in grams.items())]
        assert match and all(r.base_failed == base and (not r.kept if base else True) for r in match), doc_id
    kept = {r.doc_id for r in got if r.kept}
    assert {6, 7, 8, 23, None} <= kept and not kept & {1, 2, 3, 4, 5, 10, 20, 21, 22}
    assert quality_rules.quality_rules(docs(spark, rows).limit(0)).count() == 0


# --- operator 6 -----------------------------------------------------------------------------


def test_automaton_against_fnmatch():
    globs = ["*", "", "a*", "*b", "a*b*c", "??", "a?c*", "*a*a*a*", "abc", "*é*", "x" * 90 + "*y", "*" + "z" * 70]
    texts = ["", "a", "b", "abc", "aXbXc", "aXbX", "ab", "éa", "aaa", "aabab", "abcabc", "x" * 90 + "y", "x" * 90 + "QQy", "q" + "z" * 70, "z" * 69, "cab"]
    raw = url_rules.Automaton([url_rules.glob_symbols(g) for g in globs]).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            want = fnmatch.fnmatchcase(t, g.replace("[", "[[]"))
            assert raw[i, j] == want, (t, g)


def test_rules_and_odd_urls(spark):
    rows = [
        (1, "https://a.example.com/en/712?q", "example.com/en/7", "allow"), (2, "http://EXAMPLE.COM/en/1", "com/en/", "block"), (3, "http://example.net/de/81#x", "example.net/de/8", "block"),
        (4, "http://x.net/de/9", "net/de/", "allow"), (5, "http://evil.com.au/en/1", None, "allow"), (6, "http://notexample.com/en/7", "com/en/", "block"), (7, "http://org/es/", "org/es/", "block"),
        (8, "http://h.fr/x.com/en/", None, "allow"), (9, None, None, "allow"), (10, "no scheme /en/", None, "allow"), (11, "http://spam-farm.fr/", None, "block"), (12, "http://h.fr/casino", None, "allow"),
        (13, "http://" + "h" * 5000 + ".com/en/" + "é" * 3000, "com/en/", "block"), (14, "://", None, "allow"), (15, "http://h.fr?x=/en/", None, "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "z") for r in rows], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_rules.filter_urls(df).collect()}
    for page_id, _, rule, verdict in rows:
        assert (got[page_id].rule, got[page_id].verdict) == (rule, verdict), page_id
    assert (got[1].host, got[1].path) == ("a.example.com", "/en/712") and (got[9].host, got[9].path) == ("", "")
    assert url_rules.filter_urls(df.limit(0)).count() == 0
