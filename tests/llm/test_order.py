"""Operators 2, 8, 9 and 10, and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import curve_packing as cp
from quirework.llm import license_scan as ls
from quirework.llm import source_mixing as sm
from quirework.llm import training_order as to
from quirework.llm.hashing import chunks
from quirework.llm.token_ids import WordCoder, coder, tokenizer_path
from tests.llm.helpers import docs, odd_rows, prose
from tests.llm.test_dedup import brute_cut, brute_groups, edited, repeat_rows
from tests.llm.test_measures_and_media import brute_quality


def library_ids(text):
    return [*coder(tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_the_librarys():
    c = WordCoder(tokenizer_path())
    texts = [t or "" for _, t in odd_rows()] + ["it's we'll X'S 3.14 a_b__ c²½ ÀÉß ﬁ ŉ’s", "<|startoftext|>x", "a\xa0b c", "ΣΑΣ", "“q”—d…€5 ¿q? «x» \xad", "a\x1cb\x85c\x0bd", "'s't", "x" * 3000]
    for part in chunks(texts, len, 4000):
        assert [np.frombuffer(x, dtype="<u2").tolist() + [1] for x in c.encode(part)] == [library_ids(t) for t in part]


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = cp.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    rows = odd_rows() + [(50 + i, prose(9, 70)) for i in range(30)]
    got = cp.pack_along_curve(docs(spark, rows), with_ids=True).collect()
    want = Counter((d, tuple(library_ids(t))) for d, t in rows)
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    held = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.piece)) == r.ids_crc32 and len(r.piece) == 4 * r.length and r.length <= cp.WIDTH
        held[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for s in range(len(held)):
        at = 0
        for offset, length in sorted(held[s]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(x == cp.WIDTH for x in sizes[:-1]) and 0 < sizes[-1] <= cp.WIDTH
    streams = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        streams[r.doc_id].append((r.start, np.frombuffer(bytes(r.piece), dtype="<u4").tolist(), r.doc_tokens))
    rebuilt = Counter()
    for d, pieces in streams.items():
        now = []
        for start, ids, n in pieces:
            assert start == len(now)
            now += ids
            if len(now) == n:
                rebuilt[(d, tuple(now))] += 1
                now = []
        assert not now
    assert rebuilt == want
    same = [r.curve >> cp.TIE_BITS for r in got if r.doc_id is not None and r.doc_id >= 50]
    assert len(set(same)) == 1
    assert cp.pack_along_curve(docs(spark, rows).limit(0)).count() == 0


def test_permutation():
    for n in (1, 2, 3, 64, 65, 1000):
        x = np.arange(n)
        slots = to.feistel(x, n)
        assert sorted(slots) == list(range(n)) and (to.unfeistel(slots, n) == x).all()
    assert (to.feistel(np.arange(1000), 1000, key=1) != to.feistel(np.arange(1000), 1000, key=2)).mean() > 0.9


def test_shards(spark, tmp_path):
    rows = odd_rows() + [(50 + i, prose(i, 70)) for i in range(30)]
    target = f"file://{tmp_path}/shards"
    sequences = to.training_sequences(docs(spark, rows), stride=128, shard_sequences=64)
    got = to.write_shards(sequences, target, stride=128, shard_sequences=64).collect()
    total = sum(len(library_ids(t)) for _, t in rows)
    n = -(-total // 128)
    assert sorted(r.slot for r in got) == list(range(n)) and sum(r.n_tokens for r in got) == total
    assert all(r.shard == r.slot // 64 and r.offset == 256 * (r.slot % 64) for r in got)
    read = list(to.read_slots(target, 0, n, stride=128, shard_sequences=64))
    assert len(read) == n and all(zlib.crc32(read[r.slot].tobytes()) == r.crc32 for r in got)
    resumed = list(to.read_slots(target, 70, 10, stride=128, shard_sequences=64))
    assert all((a == b).all() for a, b in zip(resumed, read[70:80], strict=True))
    # in the order of sequence numbers the records are the documents, one after another
    number = to.feistel(np.arange(n), n)
    flat = np.concatenate([read[s] for s in number])[:total].tolist()
    at, found = 0, Counter()
    while at < total:
        end = flat.index(1, at) + 1
        found[tuple(flat[at:end])] += 1
        at = end
    assert found == Counter(tuple(library_ids(t)) for _, t in rows)
    again = to.write_shards(to.training_sequences(docs(spark, rows).repartition(7), stride=128, shard_sequences=64), target + "2", stride=128, shard_sequences=64).collect()
    assert sorted((r.slot, r.crc32) for r in again) == sorted((r.slot, r.crc32) for r in got)
    assert to.training_sequences(docs(spark, rows).limit(0)).count() == 0


# --- operator 9 -----------------------------------------------------------------------------


def test_licences(spark):
    rows = odd_rows() + [
        (30, prose(1, 40) + "\nReleased under the MIT License.\n" + prose(2, 30)), (31, "Licensed under CC BY-SA 4.0."), (32, "This work is licensed under the GNU General Public License, version 3."),
        (33, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\nreleased under the mit license."), (34, "the license plate was granted permission by the software"), (35, "Licensed under the 3-clause BSD License."),
    ]
    found = ls.scan_licenses(docs(spark, rows))
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    got = {r.doc_id: r for r in found.collect() if r.doc_id and r.doc_id >= 30}
    names = {d: [f.family for f in r.findings if f.confirmed] for d, r in got.items()}
    assert names == {30: ["mit"], 31: ["cc"], 32: ["gpl"], 33: ["apache", "mit"], 34: [], 35: ["bsd"]}
    assert got[30].findings[0].paragraph == 1  # a long line, then a run of short ones with the notice in it
    assert found.count() == len(rows) and ls.scan_licenses(docs(spark, rows).limit(0)).count() == 0


def test_expression_scores_as_the_model(spark):
    r = random.Random(21)
    model = ls.train([prose(i, 12) for i in range(50)])
    pool = [n for f in ls.NOTICES for n in ls.NOTICES[f]] + ls.PLAIN + ls.OTHER + [prose(i, 30).replace("\n", " ") for i in range(20)]
    mixed = [" ".join(r.choices(" ".join(r.sample(pool, 2)).split(), k=9)) for _ in range(250)]  # words in any order
    texts = pool + mixed + ["", "  ", "MIT", "the GPL, version 2; see LICENSE"]
    got = {x.doc_id: x.findings for x in ls.scan_licenses(docs(spark, list(enumerate(texts))), model=model).collect()}
    for i, t in enumerate(texts):
        want = model.predict(t)
        assert [f.family for f in got[i]] == ([want] if want != ls.UNKNOWN else []), t
        if got[i]:
            assert got[i][0].probability == pytest.approx(model.probability(t), abs=2e-6)


def test_wrapped_notices(spark):
    notice = next(n for n in ls.NOTICES["mit"] if n.startswith("Permission is hereby"))
    w = notice.split()
    lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
    long = prose(5, 400).replace("\n", " ")
    rows = [(1, long + "\n" + "\n".join(lines) + "\n" + long), (2, "\r\n".join(lines) + "\r\n  \r\nLicensed under the ISC License.\n\nbye"), (3, lines[0]), (4, "a\n\nb\nc\n" + long)]
    got = {x.doc_id: x for x in ls.scan_licenses(docs(spark, rows)).collect()}
    assert [(f.family, f.paragraph) for f in got[1].findings if f.confirmed] == [("mit", 1)] and got[1].n_paragraphs == 3
    assert [f.family for f in got[2].findings if f.confirmed] == ["mit", "isc"] and got[2].n_paragraphs == 3
    assert not any(f.confirmed for f in got[3].findings) and got[4].n_paragraphs == 3


def test_calibrated_unknown():
    model = ls.train([prose(i, 12) for i in range(50)])
    assert model.margin > 0
    for text in ("He bought a license for the software.", "Licensed under the Ruby License.", "SPDX-License-Identifier: NCSA", "Licensed under the OpenSSL License.", prose(77, 20)):
        assert model.predict(text) == ls.UNKNOWN and model.probability(text) < 0.5
    for text, family in (("licensed under the Mozilla Public License, v. 2.0", "mpl"), ("Eclipse Public License 1.0", "epl"), ("lizenziert unter CC BY-SA 4.0", "cc"), ("under the GNU LGPL v2.1", "lgpl")):
        assert model.predict(text) == family and model.probability(text) > 0.5


def test_model_on_held_out_notices():
    model = ls.train([prose(i, 12) for i in range(50)])
    held = {
        "gpl": ["Licensed under the GNU GPL, version 3 or later.", "This file is free software under the GNU General Public License."],
        "apache": ["Apache License, Version 2.0 applies to this file.", "This code is licensed under the Apache 2.0 license."], "mit": ["Available under the MIT license.", "MIT License, see the file LICENSE."],
        "bsd": ["This is published under the BSD license.", "BSD-3-Clause"], "cc": ["Text available under CC BY-SA 3.0.", "Creative Commons Attribution 4.0 International"], "proprietary": ["Copyright 2019 by Acme. All rights reserved."],
        ls.UNKNOWN: ["The work began at nine.", "He was granted a copy of the plan.", "Our software runs on all machines.", "The general met the public."] + [prose(i, 15) for i in range(900, 960)],
    }
    pairs = [(want, model.predict(t)) for want, texts in held.items() for t in texts]
    right = sum(a == b for a, b in pairs)
    assert right / len(pairs) >= 0.95, [p for p in pairs if p[0] != p[1]]
    text = "This work is licensed under the GNU General Public License, version 3."
    assert any(w in model.triggers() for w in ls.words_of(text))


# --- operator 10 ----------------------------------------------------------------------------


def test_exponent_is_bisected():
    words = {"a": 8000, "b": 1000, "c": 500, "d": 0}
    x = sm.solve_exponent(words, max_repeats=3.0)
    assert math.isclose(max(sm.repeats(words, sm.shares(words, x), None).values()), 3.0, rel_tol=1e-6)
    e = sm.solve_exponent(words, target_entropy=0.8, max_repeats=None)
    assert math.isclose(sm.entropy(sm.shares(words, e)), 0.8, rel_tol=1e-9)
    assert sm.solve_exponent(words, max_repeats=100.0) == 0.0 and sm.solve_exponent({"a": 5}) == 1.0
    assert math.isclose(math.fsum(sm.shares(words, 0.3).values()), 1.0)


def mix_rows():
    rows = [(i, prose(i, 40), "big") for i in range(300)] + [(1000 + i, prose(i, 30), f"s{i % 4}") for i in range(60)]
    return rows + [(2000, None, "s1"), (2001, "", "void"), (2002, prose(3, 20), None), (2003, prose(4, 10), "s2"), (2003, prose(4, 10), "s2")]


def test_mixture(spark):
    rows = mix_rows()
    frame = docs(spark, rows)
    got = sm.mix_sources(frame, block_words=1000).collect()
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    used = sm.repeats(words, sm.shares(words, sm.solve_exponent(words)), None)
    taken = Counter()
    for r in got:
        taken[r.source] += r["__n_words"]
    longest = max(len((t or "").split()) for _, t, _ in rows)
    for s, n in words.items():
        want = max(n, round(used.get(s, 1.0) * n))
        assert n <= taken[s] and want <= taken[s] < want + longest + 1, (s, want, taken[s])
    first = Counter((r.doc_id, r.text, r.source) for r in got if r["__epoch"] == 0)
    assert first == Counter((d, t, s) for d, t, s in rows)
    assert all(0 <= r["__mix_key"] <= 1 << 62 for r in got) and set(frame.columns) <= set(got[0].asDict())
    # any stretch of the order holds the sources in about their weights
    order = sorted((r["__mix_key"], r.source, r["__n_words"]) for r in got)
    half = Counter()
    for _, s, n in order[: len(order) // 2]:
        half[s] += n
    assert abs(half["big"] / taken["big"] - 0.5) < 0.1
    assert sm.mix_sources(frame.limit(0)).count() == 0


def test_given_budget_and_blank_sources(spark):
    rows = mix_rows()
    got = sm.mix_sources(docs(spark, rows), budget_words=4000, max_repeats=1.5, block_words=500).collect()
    assert abs(sum(r["__n_words"] for r in got) - 4000) < 45 * 8
    blank = [(1, None, "a"), (2, "", None)]
    assert len(sm.mix_sources(docs(spark, blank)).collect()) == 2


def test_ids_equal_the_library(monkeypatch):
    from quirework.llm import token_ids

    monkeypatch.setattr(token_ids, "MOST_CHUNKS", 300)  # the table is halved again and again
    c = token_ids.WordCoder(token_ids.tokenizer_path())
    r = random.Random(1)
    signs = list("ab Zéñ×÷\n\t.,'-1²_µßİœĲſ日–…$") + ["'s", "'T", "<|endoftext|>", "  ", "The. ", "end, "]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", " ", "\n", prose(3, 2000), prose(4, 60_000).upper(), "é" * 3000, "a." * 2000]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in c.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 37) for x in c.encode(texts[i : i + 37])] == want


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = [r for r in repeat_rows() + odd_rows() if r[0] is not None]
    rows = list({d: (d, t) for d, t in rows}.values()) + [(900 + i, prose(800 + i % 3, 70), f"src{i % 3}") for i in range(9)]
    frame = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")

    kept = []
    for r in rows:
        n, chars, symbols, _, repeated, grams = brute_quality((r[1] or "").encode())
        lines, twice = set(), 0
        for line in (r[1] or "").split("\n"):
            if line.split():
                twice += len("".join(line.split())) if line in lines else 0
                lines.add(line)
        from quirework.llm import quality_rules as q

        if n >= 50 and 100 * repeated <= 50 * n and symbols <= q.SYMBOL_LIMIT * chars and twice <= q.LINE_LIMIT * chars and all(grams[k] <= v * chars for k, v in q.NGRAM_LIMITS.items()):
            kept.append(r)
    groups = brute_groups([(r[0], r[1]) for r in kept])
    leaders = {d for d, _, g in groups if d == g}
    kept = [r for r in kept if r[0] in leaders]
    cut = brute_cut([r[1].encode() for r in kept])
    left = {r[0]: c for r, c in zip(kept, cut, strict=True)}

    data = frame
    for name, stage in corpus_pipeline.STAGES[:3]:
        data = spark.createDataFrame(stage(spark, data, str(tmp_path)).collect(), frame.schema)
        assert data.columns == corpus_pipeline.COLUMNS, name
    import hashlib

    got = {r.doc_id: r for r in data.collect()}
    alive = {d: c for d, c in left.items() if c[0] > c[1]}
    assert set(got) == set(alive)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == alive[d][3] and r.n_chars == len(r.text) for d, r in got.items())

    packed = corpus_pipeline.run(spark, str(tmp_path))
    sizes = {d: len(library_ids(r.text)) for d, r in got.items()}
    copies = packed.filter("start = 0").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.t for r in copies} == sizes and all(1 <= r.n <= 2 for r in copies)


def test_near_copies_from_80_percent(spark, tmp_path):
    r = random.Random(8)
    base = prose(61, 300).split()
    rows = [(1, " ".join(base))] + [(10 + i, edited(base, r, 5 + i % 4)) for i in range(12)]
    far = [(30 + i, prose(700 + i, 80)) for i in range(3)]
    leaders = {p: {d for d, _, g in brute_groups(rows + far, p) if d == g} for p in (80, 85)}
    assert leaders[80] < leaders[85]  # some pairs lie between
    got = corpus_pipeline.near_dedup(spark, docs(spark, rows + far).select(*corpus_pipeline.COLUMNS), str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == sorted(leaders[80])


def test_near_dedup_decides_by_row(spark, tmp_path):
    r = random.Random(9)
    a, b, c, d = (prose(620 + i, 200).split() for i in range(4))
    near = lambda w: edited(w, r, 2)
    text = " ".join
    rows = [
        (None, text(a)), (None, near(a)), (None, text(b)), (None, text(b)),  # two groups without an id
        (5, text(c)), (5, prose(630, 90)), (5, prose(631, 90)),  # unlike texts under an id
        (1, text(d)), (8, near(d)), (8, prose(632, 90)),  # one of two rows of id 8 is a near copy of 1
        (9, prose(633, 90)), (9, prose(633, 90)), (None, prose(633, 90)), (3, None), (3, " \n"), (None, ""),
    ]
    frame = docs(spark, rows).select(*corpus_pipeline.COLUMNS)
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, frame, str(tmp_path)).collect()]
    firsts = [x for x in got if x[1] in (rows[0][1], rows[1][1])]
    assert len(firsts) == 1 and firsts[0][0] is None
    want = [rows[i] for i in (2, 4, 5, 6, 7, 9, 10, 13, 14, 15)]
    assert Counter(x for x in got if x not in firsts) == Counter(want)

    frame.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).filter("start = 0").select("doc_id", "doc_tokens").distinct().collect()
    left = Counter((i, len(library_ids(t))) for i, t in [*firsts, *(rows[i] for i in (2, 4, 5, 6, 7, 9, 10))])
    assert Counter((x.doc_id, x.doc_tokens) for x in packed) == left


def test_stage_cuts_passages_of_over_50_words(spark, tmp_path):
    passage = " ".join(w[:6] for w in prose(640, 51).split())
    assert len(passage) < 400
    rows = [(i, prose(650 + i, 60) + "\n" + passage + "\n" + prose(660 + i, 60)) for i in range(3)]
    got = corpus_pipeline.suffix_dedup(spark, docs(spark, rows).select(*corpus_pipeline.COLUMNS), str(tmp_path)).collect()
    assert len(got) == 3 and not any(passage[3:-3] in x.text for x in got)


def test_stage_without_rows(spark, tmp_path):
    empty = docs(spark, [(1, "a")]).select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
