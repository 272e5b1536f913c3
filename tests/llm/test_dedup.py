"""Operators 5 and 7, and connected components."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quirework.llm import near_dedup as nd
from quirework.llm import suffix_dedup as sd
from quirework.llm.common import Scratch
from quirework.llm.components import connected_components
from tests.llm.helpers import docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def top(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def brute_groups(rows, percent=85):
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    u = Union(range(len(rows)))
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                u.join(i, j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        t = u.top(i)
        if doc_id is not None:
            least[t] = min(least.get(t, doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), least.get(u.top(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def edited(base: list[str], r: random.Random, changes: int) -> str:
    w = list(base)
    for _ in range(changes):
        w[r.randrange(len(w))] = "q" + str(r.randrange(10**9))
    return " ".join(w)


def near_rows():
    r = random.Random(5)
    rows = odd_rows()
    base = prose(50, 300).split()
    rows += [(100 + i, " ".join(base)) for i in range(40)]  # copies
    rows += [(200 + i, edited(base, r, r.choice([2, 5, 8, 10, 12]))) for i in range(160)]  # near copies on both sides of the threshold
    chain = prose(51, 200).split()
    for i in range(12):  # each like the one before, the ends unlike each other
        chain = edited(chain, r, 3).split()
        rows.append((400 + i, " ".join(chain)))
    for n in (1, 3, 5, 6, 7, 10, 11, 12):  # short ones: a word more or less
        w = prose(60 + n, 20).split()[:n]
        rows += [(500 + 3 * n, " ".join(w)), (501 + 3 * n, " ".join(w).upper()), (502 + 3 * n, " ".join(w + ["more"]))]
    passage = prose(70, 40)
    rows += [(700 + i, prose(700 + i, 100) + "\n" + passage) for i in range(60)]  # a shared passage alone links nothing
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    got = nd.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_unlike_sets_of_one_class_name(spark, monkeypatch):
    """As if the first 64 bits of unlike sets were often equal."""
    real = nd.digests
    part = nd._sketch_rows

    def poor(batches):
        for batch in part(batches):
            at = batch.schema.get_field_index("class")
            yield batch.set_column(at, "class", nd.pa.array(batch.column(at).to_numpy() % 7))

    monkeypatch.setattr(nd, "_sketch_rows", poor)
    rows = near_rows()[-140:] + odd_rows()
    got = nd.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    assert real is nd.digests


def test_no_rows(spark):
    assert nd.near_duplicates(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r)[:4] for r in nd.near_duplicates(docs(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_registers():
    keys, bounds = nd.shingle_sets([b"a b c d e f", b"", b"A B C D E F"])
    assert list(np.diff(bounds)) == [2, 0, 2]
    got = nd.sketch(keys, bounds)
    assert (got[0] == got[2]).all() and (got[1] == 0).all()
    x = np.array([1 << 63, (1 << 63) | (1 << 62), 1, 1 << 40], dtype=np.uint64)
    packed = nd.compress(x)
    assert list(packed >> nd.MANTISSA) == [0, 0, 63, 23] and packed[1] & 0x3FF == 0x200


def test_estimate_is_corrected():
    r = np.random.default_rng(1)
    for share in (0.5, 0.85):
        pairs = []
        for _ in range(60):
            both = r.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            more = r.integers(0, 2**63, (2, 200 - 100 * int(share > 0.6)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, m])) for m in more)
            s = nd.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            true = len(both) / (len(a) + len(b) - len(both))
            pairs.append(nd.estimate(np.array([(s[0] == s[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(pairs)) < 0.03
    assert 0 < nd.collision_rate(300, 300) < 0.01


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(200, 900), r.randrange(200, 900)) for _ in range(400)] + [(5, 5), (7, 3), (3, 7), (1, 2)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {(r.node, r.component) for r in got} == {(x, u.top(x)) for e in edges if e[0] != e[1] for x in e}


# --- operator 7 -----------------------------------------------------------------------------


def brute_cut(texts: list[bytes], n: int = sd.LENGTH):
    seen = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, dtype=np.int32)
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                covered[p] += 1
                covered[p + n] -= 1
        on = np.cumsum(covered[: len(t)]) > 0
        rest = bytes(np.frombuffer(t, dtype=np.uint8)[~on]) if len(t) else b""
        out.append((len(t), int(on.sum()), int((np.diff(np.concatenate([[0], on.astype(np.int8)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def repeat_rows():
    passage, other = prose(90, 130), prose(91, 75)
    rows = [(i, prose(1000 + i, 90) + " " + passage + " " + prose(2000 + i, 60)) for i in range(90)]  # more stretches than the pairwise limit
    rows += [(200 + i, prose(3000 + i, 40) + other[i * 3 :] + prose(4000 + i, 40)) for i in range(20)]  # ends at different places
    rows += [(300, "ab" * 700), (301, "z" * 399), (302, "z" * 400), (303, "é" * 300 + "x"), (304, passage + passage), (305, prose(5, 20_000)), (306, prose(5, 20_000)[50_000:51_500])]
    short = prose(92, 58)[:399]
    return rows + [(310, "a" + short), (311, "b" + short), (312, prose(6, 90)), (313, prose(6, 90))] + odd_rows()


def test_repeats_against_brute_force(spark):
    rows = repeat_rows()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_cut([(t or "").encode() for _, t in rows]), strict=True))
    got = sd.remove_repeats(docs(spark, rows), with_text=False).collect()
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("length", [sd.LEAST_LENGTH, 224])
def test_shorter_repeats_against_brute_force(spark, length):
    short = prose(95, 60)[: length + 30]
    rows = repeat_rows() + [(600 + i, prose(5000 + i, 40) + short[i % 9 :] + prose(6000 + i, 40)) for i in range(80)]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_cut([(t or "").encode() for _, t in rows], length), strict=True))
    got = sd.remove_repeats(docs(spark, rows), with_text=False, length=length).collect()
    assert Counter(tuple(r) for r in got) == want


def test_kept_text_and_other_columns(spark):
    rows = repeat_rows()[:60]
    got = sd.remove_repeats(docs(spark, rows))
    assert got.columns[:2] == ["doc_id", "text"] and "rank" in got.columns
    for r in got.collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 and r["rank"] == 2
    assert sd.remove_repeats(docs(spark, rows).limit(0)).count() == 0


def test_planted_passages_go_and_clean_texts_stay(spark, tmp_path):
    """The query itself: passages of over 50 words, some of wide characters, that repeat across documents."""
    plain, wide = " ".join(prose(510, 90).split()), " ".join(w + "é" for w in prose(511, 90).split())
    rows = [(i, prose(5200 + i, 60) + "\n" + (plain if i % 2 else wide) + "\nä" + prose(5300 + i, 60)) for i in range(10)]
    clean = [(100 + i, prose(5400 + i, 120) + (" ñandú" * (i % 2))) for i in range(10)]
    docs(spark, rows + clean).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sd.query(spark, str(tmp_path)).collect()}
    for i, text in rows:
        passage = plain if i % 2 else wide
        assert got[i].n_removed >= len(passage.encode()) and got[i].n_bytes == len(text.encode()) and passage[5:-5] not in got[i].text
        assert got[i].text.startswith(prose(5200 + i, 60)[:-20]) and got[i].text.endswith(prose(5300 + i, 60)[20:])
    for i, text in clean:
        assert got[i].text == text and got[i].n_removed == 0 and got[i].n_bytes == len(text.encode())


def test_text_without_split_characters(spark):
    shared = "é" * 250
    rows = [(1, "a" + "ñ" * 20 + shared + "b"), (2, "c" + shared + "ö" * 10), (3, "é" * 199 + "x"), (4, "\u20ac" * 140), (5, "z\u20ac" * 2 + "\u20ac" * 140)]
    for r in sd.remove_repeats(docs(spark, rows)).collect():
        raw = dict(rows)[r.doc_id]
        assert set(r.text) <= set(raw) and len(r.text.encode()) <= r.n_bytes - r.n_removed <= len(r.text.encode()) + 6 * r.n_spans


@pytest.mark.parametrize("size", [500, 700_000])
def test_long_texts_are_anchored_whole(size):
    r = random.Random(1)
    t = bytes(r.choice(b"abc \n") for _ in range(size))
    runs = []
    for _, bounds, data, offset in sd._pieces([t], sd.LENGTH):
        text, lo, hi, q = sd.anchors(data, bounds)
        assert ((q >= hi) & (q < lo + sd.REACH)).all()
        runs += list(zip(lo + offset[text], hi + offset[text], strict=True))
    held = sorted(runs)
    assert held[0][0] == 0 and held[-1][1] == size - sd.LENGTH
    assert all(b[0] == a[1] + 1 for a, b in zip(held, held[1:], strict=False))
