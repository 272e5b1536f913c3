"""Golden cases of the engine's operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import quirework.queries as engine
from quirework.functions import measures
from quirework.operators import assemble, assess, dualrun, evaluate, metrics, provenance, reconcile, segment, structured, text, visual


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("lower-\ncase", "lowercase"), ("Upper-\nCase", "Upper- Case"), ("well-being", "well-being"), ("x-\ny-\nz", "xyz"), ("a\r\nb\rc", "a b c"), ("é   x ", "é x"), (None, None), ("", "")],
)
def test_normalize(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.normalize(F.col("t")).alias("x")).first().x == want


def test_canonical_text(spark):
    assert one(spark, text.canonical(F.lit("Straße 12 of 345"))) == "STRAßE # OF #"


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page_no int, block_seq int, text string, t double, b double, median_pt double, word_count int")


def test_recurring_header(spark):
    rows = [(1, p, 0, f"CHAPTER {p}", 0.02, 0.05, 10.0, 2) for p in (1, 2, 3)] + [(1, p, 1, f"body of page {p}", 0.4, 0.5, 10.0, 4) for p in (1, 2, 3)]
    rows += [(2, p, 0, f"CHAPTER {p}", 0.02, 0.05, 10.0, 2) for p in (1, 2)]  # on too few pages
    rows += [(3, 1, i, "SAME", 0.02, 0.05, 10.0, 1) for i in range(5)]  # often, on one page
    got = {(r.doc_id, r.page_no, r.block_seq): r.exclusion for r in text.normalize_blocks(blocks(spark, rows)).collect()}
    assert [got[(1, p, 0)] for p in (1, 2, 3)] == ["RepeatedHeader"] * 3
    assert all(v is None for k, v in got.items() if k[0] > 1 or k[2] == 1)


def test_lower_weighted_median(spark):
    rows = [(1, 1, i, "x", 0.3, 0.4, s, w) for i, (s, w) in enumerate([(10.0, 3), (12.0, 3)])] + [(2, 1, 0, "x", 0.3, 0.4, 9.0, 0)]
    got = {r.doc_id: r.body_pt for r in segment.body_font_size(blocks(spark, rows)).collect()}
    assert got == {1: 10.0}


@pytest.mark.parametrize(
    ("given", "words", "ratio", "want"),
    [("Structured Topic", 2, 1.2, True), ("eox 6.2", 2, 1.3, False), ("l) J'(l l) N J).f", 6, 1.4, False), ("Ends with a stop.", 4, 1.2, False), ("Ends with a stop.", 4, 1.31, True), ("Bad � sign", 3, 2.0, False), ("No ratio", 2, None, False), ("word " * 25, 25, 2.0, False)],
)
def test_native_heading(spark, given, words, ratio, want):
    frame = spark.createDataFrame([(given.strip(), words, ratio)], "t string, w int, r double")
    assert frame.select(segment.native_heading(F.col("t"), F.col("w"), F.col("r")).alias("x")).first().x is want


def test_heading_hints(spark):
    assert segment.clean_hints([" Intro ", "INTRO", "--", "", "End 1"]) == ["Intro", "End 1"]
    case = lambda t, src=None: one(spark, segment.hinted(F.lit(t), F.lit(src or t), ["Summary of Findings"]))
    assert case("summary of findings:") and case("IV. Summary of Findings") and case("other", "Summary-of findings\nrest")
    assert case("xiv Summary of Findings") and not case("four Summary of Findings") and not case("Long prefix Summary of Findings")


def test_cross_page_segments(spark):
    rows = [(1, 1, 0, "INTRODUCTION", 0.3, 0.4, 13.0, 1), (1, 1, 1, "body one", 0.4, 0.5, 10.0, 12), (1, 2, 0, "body two", 0.3, 0.4, 10.0, 12), (1, 3, 0, "NEXT SECTION", 0.3, 0.4, 13.0, 2), (1, 3, 1, "end", 0.5, 0.6, 10.0, 12)]
    rows += [(2, p, 0, f"plain {p}", 0.3, 0.4, 10.0, 2) for p in (1, 2)]
    got = [(r.doc_id, r.ordinal, r.first_page, r.last_page, r.heading_text, r.segment_id) for r in segment.segments(text.normalize_blocks(blocks(spark, rows))).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 0, 1, 2, "INTRODUCTION", "p000001-s000000"), (1, 1, 3, 3, "NEXT SECTION", "p000003-s000001"), (2, 0, 1, 1, None, "p000001-s000000"), (2, 1, 2, 2, None, "p000002-s000001")]


def test_segments_do_not_depend_on_partitions(spark):
    r = random.Random(1)
    rows = [(d, p, s, f"Word {r.random()}" * 2, s / 8, (s + 1) / 8, r.choice([10.0, 13.0]), r.randint(1, 9)) for d in range(20) for p in (1, 2, 3) for s in range(8)]
    a = segment.segments(text.normalize_blocks(blocks(spark, rows)))
    r.shuffle(rows)
    b = segment.segments(text.normalize_blocks(blocks(spark, rows).repartition(13)))
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize(
    ("pages", "want"),
    [([(10, 0.0), (8, 0.0)], ("HealthyBornDigital", 100.0)), ([(10, 0.0), (0, 0.95)], ("Hybrid", 50.0)), ([(0, 0.90), (0, 0.75)], ("RasterOrScanned", 0.0)), ([(0, 0.0), (0, 0.20)], ("Problematic", 0.0)), ([(0, 0.60)], ("RasterOrScanned", 0.0)), ([], ("Problematic", 0.0))],
)
def test_preflight(spark, pages, want):
    rows = [(1, i + 1, w, int(r > 0), r) for i, (w, r) in enumerate(pages)]
    found = spark.createDataFrame(rows, "doc_id long, page_no int, word_count long, raster_image_count int, largest_raster_ratio double")
    got = assess.preflight(spark.createDataFrame([(1,)], "doc_id long"), found).first()
    assert (got.classification, got.coverage) == want


def test_page_assessment_order(spark):
    rows = [(1, 1, 0, 0, 0, "x", 1, 0.9), (1, 2, 5, 5, 0, "x", 1, 0.9), (1, 3, 5, 5, 1, "x", 1, 0.6), (1, 4, 5, 5, 1, "a\tb\n", 0, 0.0), (1, 5, 5, 4, 1, "x", 0, 0.0), (1, 6, 5, 5, 1, " ", 0, 0.0), (1, 7, 5, 5, 1, "", 0, 0.0), (1, 8, 5, 5, 1, None, 0, 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, page_no int, word_count long, words long, block_count long, source_text string, raster_image_count int, largest_raster_ratio double")
    got = [r.status for r in assess.assess_pages(frame).orderBy("page_no").collect()]
    assert got == ["Missing", "Suspicious", "Unverified", "Healthy", "Suspicious", "Suspicious", "Suspicious", "Suspicious"]


@pytest.mark.parametrize(
    ("fragments", "native", "want"),
    [
        (["compan­", "ions,"], True, ("companions,", 1, 1)), (["of­fice", "study"], True, ("office study", 1, 0)), (["well-", "being"], True, ("well- being", 0, 0)), (["Upper­", "Case"], True, ("Upper Case", 1, 0)),
        (["compan-", "ions,"], False, ("companions,", 0, 1)), (["inter-", "national", "world"], False, ("international world", 0, 1)), (["a-", "B"], False, ("a- B", 0, 0)), ([], False, ("", 0, 0)),
    ],
)
def test_dehyphenation(spark, fragments, native, want):
    frame = spark.createDataFrame([(fragments,)], "f array<string>")
    got = frame.select(reconcile.dehyphenate_fragments(F.col("f"), native).alias("x")).first().x
    assert tuple(got) == want


@pytest.mark.parametrize(
    ("status", "native", "ocr", "want"),
    [
        ("Missing", None, "read", ("OcrOnly", "Ocr", "read")), ("Missing", None, " ", ("NoTextRecovered", "None", None)), ("Healthy", "n", None, ("NativeOnly", "Native", "n")), ("Suspicious", "n", None, ("SuspiciousNativeUnverified", "None", None)),
        ("Unverified", "of­fice x", "office x", ("Agreement", "Native", "of­fice x")), ("Healthy", "ﬁgure", "figure", ("Agreement", "Native", "ﬁgure")), ("Healthy", "Figure 11.1", "figure 11.1", ("HealthyNativePreferred", "Native", "Figure 11.1")),
        ("Suspicious", "word,", "word", ("Conflict", "None", None)),
    ],
)
def test_reconciliation(spark, status, native, ocr, want):
    frame = spark.createDataFrame([(status, native, ocr)], "status string, native_text string, ocr_text string")
    r = reconcile.reconcile(frame).first()
    assert (r.decision, r.origin, r.selected_text) == want and r.resolved == (want[2] is not None) and r.divergence == (want[0] in ("HealthyNativePreferred", "Conflict"))


def test_extent_spans_the_words_between(spark):
    words = spark.createDataFrame([(1, 1, 0, i, w, l, l + 0.1, 0.1, 0.2) for i, (w, l) in enumerate([("first", 0.0), ("middle", 0.8), ("last", 0.2)])], "doc_id long, page_no int, block_seq int, word_idx int, word string, wl double, wr double, t double, b double")
    box = spark.createDataFrame([(1, 1, 5, "Text", 0.0, 0.0, 0.5, 0.5), (1, 1, 6, "Text", 0.9, 0.2, 1.0, 0.4)], "doc_id long, page_no int, obs_seq int, kind string, l double, t double, r double, b double")
    blocks = spark.createDataFrame([(1, 1, 0, 0.0, 0.1, 1.0, 0.2)], "doc_id long, page_no int, block_seq int, l double, t double, r double, b double")
    extents = reconcile.native_extents(reconcile.with_words(blocks, words), box)
    r = extents.collect()
    assert [(x.obs_seq, x.first_word, x.last_word, x.intersecting) for x in r] == [(5, 0, 2, 2)]
    got = {x.obs_seq: (x.status, x.native_text) for x in reconcile.pairings(box, extents).collect()}
    assert got == {5: ("Comparable", "first middle last"), 6: ("NoNativeEvidence", None)}


@pytest.mark.parametrize(
    ("box", "size", "want"), [((0.1001, 0.2001, 0.4001, 0.3001), (1000, 1000), (100, 200, 401, 301)), ((-0.25, -0.10, 1.20, 1.50), (1000, 2000), (0, 0, 1000, 2000)), ((1.1, 0.1, 1.2, 0.2), (100, 100), (None,) * 4)]
)
def test_crop(spark, box, size, want):
    got = reconcile.crop({k: F.lit(v) for k, v in zip("ltrb", box, strict=True)}, F.lit(size[0]), F.lit(size[1]))
    assert tuple(spark.range(1).select(*(got[k] for k in "ltrb")).first()) == want


LAYOUT = "doc_id long, page_no int, obs_seq int, reading_order int, kind string, raw_label string, l double, t double, r double, b double"


def test_layout_figures(spark):
    rows = [
        (1, 1, 4, 4, "Figure", "image", 0.2426, 0.4363, 0.5716, 0.8593), (1, 1, 5, 5, "Caption", "figure_title", 0.2379, 0.8714, 0.5583, 0.9419),
        (2, 1, 0, 0, "Figure", "image", 0.1, 0.1, 0.9, 0.5), (3, 1, 0, 0, "Figure", "formula", 0.1, 0.1, 0.9, 0.9), (4, 1, 0, 0, "Figure", "image", 0.1, 0.1, 0.9, 0.5), (4, 1, 1, 1, "Text", "text", 0.2, 0.2, 0.3, 0.3),
        (5, 1, 0, 0, "Figure", "image", 0.1, 0.3, 0.9, 0.5), (5, 1, 1, 1, "Caption", "c", 0.1, 0.5, 0.9, 0.55), (5, 1, 2, 2, "Caption", "c", 0.1, 0.56, 0.9, 0.58), (6, 1, 0, 0, "Figure", "image", -1.0, -1.0, 0.3, 0.3),
    ]
    got = {r.doc_id: r.kind for r in visual.layout_figures(spark.createDataFrame(rows, LAYOUT)).collect()}
    assert got == {1: "CaptionedMeaningfulVisual", 2: "LargeIndependentVisual", 3: "Unknown", 4: "Unknown", 5: "Unknown", 6: "Unknown"}


def test_source_figures_are_placed_between_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, i, i, "Text", "text", 0.1, 0.2 * i, 0.9, 0.2 * i + 0.1) for i in range(3)] + [(2, 1, 0, None, "Text", "text", 0.1, 0.1, 0.9, 0.2)], LAYOUT)
    shown = spark.createDataFrame([(1, 1, 0, True, 0.2, 0.31, 0.8, 0.39), (1, 1, 1, False, 0.2, 0.0, 0.8, 0.1), (2, 1, 0, True, 0.1, 0.5, 0.9, 0.6)], "doc_id long, page_no int, visual_idx int, qualified boolean, l double, t double, r double, b double")
    got = visual.insert_source_figures(boxes, shown).orderBy("doc_id", "reading_order").collect()
    assert [(r.doc_id, r.kind, r.seq) for r in got] == [(1, "Text", 0), (1, "Text", 1), (1, "Figure", 0), (1, "Text", 2), (1, "Figure", 1), (2, "Text", 0)]


def test_reading_order_flags(spark):
    rows = [(1, 1, i, l, l + 0.4, t) for i, (l, t) in enumerate([(0.0, 0.1), (0.5, 0.1), (0.0, 0.2), (0.5, 0.05)])]
    got = metrics.column_flow(spark.createDataFrame(rows, "doc_id long, page_no int, block_seq int, l double, r double, t double"), 1000.0).first()
    assert (got.switches, got.reversals, got.candidate, got.interleaved, got.reversed) == (3, 1, True, True, True)
    with pytest.raises(ValueError):
        metrics.page_range(spark.range(1), 3, 2)


def test_textless_elements_join_segments(spark):
    schema = "doc_id long, page_no int, order int, kind string, norm_text string, text string, origin string, exclusion string, ratio double, word_count int, obs_seq int"
    rows = [
        (1, 1, 0, "Deferred", None, None, "None", None, None, None, 0), (1, 2, 0, "Text", "before", "before", "Ocr", None, None, None, 1), (1, 2, 1, "Heading", "Top", "Top", "Ocr", None, None, None, 2),
        (1, 3, 0, "Visual", None, None, "None", None, None, None, 3), (1, 3, 1, "Text", "native", "native", "Native", None, 1.0, 1, None), (1, 3, 2, "Text", "gone", "gone", "Native", "RepeatedFooter", 2.0, 1, None),
        (1, 4, 0, "Text", "Big Words", "Big Words", "Ocr", None, 2.0, 2, 4), (1, 5, 0, "Caption", "Caption", "Caption", "Ocr", None, 2.0, 1, 5),
    ]
    got = assemble.hybrid_segments(spark.createDataFrame(rows, schema)).orderBy("ordinal").collect()
    assert [(r.segment_id, r.text, r.origins, r.mixed, r.visual_members, r.has_unresolved) for r in got] == [("p000002-s000000", "before", "Ocr", False, 0, False), ("p000002-s000001", "Top\n\nnative\n\nBig Words\n\nCaption", "Native,Ocr", True, 1, False)]


def test_result_json_rejects_other_schemas(spark):
    rows = spark.createDataFrame([(1, 0, "e", "Text", "t")], "doc_id long, ordinal long, element_id string, kind string, text string")
    made = provenance.to_result_json(rows)
    assert provenance.from_result_json(made).collect() == rows.collect()
    other = made.withColumn("json", F.replace("json", F.lit("-v1"), F.lit("-v9")))
    assert provenance.from_result_json(other, strict=False).count() == 0
    with pytest.raises(Exception, match="unsupported schema"):
        provenance.from_result_json(other).collect()


def test_sampling_is_stable(spark):
    import hashlib

    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)] + ["0" * 64, "f" * 64]
    got = dualrun.select_profile(spark.createDataFrame([(d,) for d in digests], "sha256 string"), "Sampled", 2500).collect()
    assert all(r.bucket == int(r.sha256[:16], 16) % 10000 and r.selected == (r.bucket < 2500) for r in got)
    assert dualrun.select_profile(spark.createDataFrame([("0" * 64,)], "sha256 string"), "Sampled", 0).first().selected is False


def test_candidate_runs(spark):
    plans = spark.createDataFrame(
        [(1, 1, "TargetedOcrRecovery", "Missing"), (1, 2, "TargetedOcrRecovery", "Suspicious"), (1, 3, "NativeText", "Healthy"), (1, 4, "TargetedOcrVerification", None)], "doc_id long, page_no int, mode string, status string"
    )
    assert {r.page_no: r.outcome for r in dualrun.candidate_pages(plans).collect()} == {1: "Completed", 2: "Failed", 4: "Failed"}
    docs = spark.createDataFrame([(1, True, 3, 3, 3), (2, False, 3, 1, 3), (3, True, 3, 3, 2), (4, True, 3, 2, 3), (5, True, 3, 3, 3)], "doc_id long, supported boolean, pages long, authoritative long, candidate long")
    failures = spark.createDataFrame([(3, "RasterObservation", "no raster"), (5, "StructuralEnrichment", "b"), (5, "NativeNormalization", "a"), (4, "NativeNormalization", "late")], "doc_id long, stage string, message string")
    got = {r.doc_id: tuple(r)[1:] for r in dualrun.planning_outcomes(docs, failures).collect()}
    assert got == {
        1: ("Completed", None, None), 2: ("UnsupportedFormat", None, None), 3: ("Failed", "RasterObservation", "no raster"), 4: ("Failed", "Capability", "2 of 3 pages"), 5: ("Failed", "NativeNormalization", "a"),
    }


def test_fingerprint_bytes():
    import hashlib
    import struct

    text = lambda x: struct.pack("<i", len(x)) + x
    e = {"text": "é", "page_no": 9, "order": 2, "l": -0.0, "t": 0.5, "r": 1.0, "b": 1.0, "kind": "Caption", "origin": "Ocr", "block_seq": 7, "reconciled": True}
    body = text(b"dual-run-selected-text-sequence-v1") + struct.pack("<i", 1) + text("é".encode())
    assert measures.fingerprint([e], False) == hashlib.sha256(body).hexdigest()
    start = text(b"dual-run-text-projection-v1") + struct.pack("<iii4d", 1, 2, 2, 0.0, 0.5, 1.0, 1.0) + text("é".encode()) + struct.pack("<i", 2)
    assert measures.fingerprint([e], True) == hashlib.sha256(start + b"\x01" + struct.pack("<i", 7) + b"\x01").hexdigest()
    assert measures.fingerprint([{**e, "block_seq": None}], True) == hashlib.sha256(start + b"\x00" + b"\x01").hexdigest()
    assert measures.fingerprint([{**e, "l": 0.0}], True) == measures.fingerprint([e], True) == measures.fingerprint([{**e, "page_no": 1}], True)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_word_distances():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        assert measures.edit_distance(a, b) == brute_edits(a, b) and measures.common_subsequence(a, b) == brute_common(a, b)


def test_ordered_overlap_of_long_texts(spark, tmp_path):
    r = random.Random(6)
    a, b = ([r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(900)] for _ in range(2))
    assert measures.common_subsequence(a, b) == brute_common(a, b) and measures.common_subsequence([], b) == measures.common_subsequence(a, []) == 0
    words = [r.choice(["the", "then", "of", "tbe", "night"]) for _ in range(1200)]
    texts = {1: " ".join(words), 2: "", 3: None, 4: " ".join(f"w{i}" for i in range(20_000))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.common for x in engine.QUERIES["ordered_overlap"](spark, str(tmp_path)).collect()}
    assert got == {1: brute_common(words, [w.replace("the", "tbe") for w in words]), 2: 0, 3: None, 4: 20_000}


def test_error_rates(spark):
    rows = [("The inter-\nnational “wörld”", 'the international "world"'), ("", ""), ("", "x"), ("a b c", "a c")]
    got = evaluate.error_rates(spark.createDataFrame(rows, "reference string, recognised string")).collect()
    assert [(r.char_edits, r.word_edits) for r in got] == [(1, 1), (0, 0), (1, 1), (2, 1)]
    assert [r.cer for r in got][1:3] == [0.0, 0.0] and [r.wer for r in got][1:3] == [0.0, 0.0]
    strict = evaluate.strict_error_rates(spark.createDataFrame([("abc", "abd"), ("", "x")], "reference string, recognised string")).collect()
    assert [r.cer for r in strict] == [1 / 3, 0.0]


def test_character_folding(spark):
    fold = lambda x: one(spark, evaluate.cer_text(F.lit(x)))
    assert fold("A\u2018b\u2019c\u02bc \u201cd\u201d\u2013e\u2015\u00a0f\u00ad") == "a'b'c' \"d\"-e- f"
    assert fold("\u201a\u201b\u201e\u201f\u2212") == "\u201a\u201b\u201e\u201f\u2212"
    assert fold("split-\u2003\n\u00a0word, ODO\u03a3") == "splitword, odo\u03c3"


def test_containment_and_bands(spark):
    inside = lambda a, b: one(spark, evaluate.containment(F.lit(a), F.lit(b)))
    assert inside("ABCDEFGH", "XXABCDEFGHXX") == "OutlineWithinCandidate" and inside("XXABCDEFGHXX", "ABCDEFGH") == "CandidateWithinOutline"
    assert inside("ABCDEFG", "ABCDEFGX") == inside("ABCDEFGH", "ABCDEFGH" + "X" * 33) == inside("", "") == "None" and inside("A", "A") == "Equal"
    kinds = [one(spark, evaluate.band(F.lit("None"), F.lit(s), F.lit(a), F.lit(b))) for s, a, b in [(3, 0.7, 0.5), (2, 0.5, 0.1), (1, 1.0, 1.0), (0, 0.0, 0.0)]]
    assert kinds == ["HighOverlap", "ModerateOverlap", "WeakOverlap", "None"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("x", "y", "BothMissing"), ("Chapter 12 x", "y", "OutlineOnly"), ("x", " 3. y", "CandidateOnly"), ("excursus 7", "7", "Same"), ("1.2", "1.3", "Same"), ("1", "2", "Different"),
        ("12345", "x", "BothMissing"), ("7th", "x", "BothMissing"), ("Appendix 3", "x", "BothMissing"),
    ],
)
def test_labels(spark, a, b, want):
    assert one(spark, evaluate.label_relation(F.lit(a), F.lit(b))) == want


def test_outline_levels_of_any_depth(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(300)] + [(2, 0, None), (2, 1, 5), (2, 3, 4), (2, 4, 3), (2, 6, 6), (2, 7, 0)]
    got = {(r.doc_id, r.ordinal): r.level for r in evaluate.outline_levels(spark.createDataFrame(rows, "doc_id long, ordinal long, parent_ordinal long")).collect()}
    assert got == {(1, i): i + 1 for i in range(300)} | {(2, 0): 1, (2, 7): 2}


def test_alignment_ranks_shared_tokens_before_pages(spark):
    outline = spark.createDataFrame([(1, 0, "alpha beta gamma delta", 5, None, None)], "doc_id long, ordinal long, title string, target_page int, left double, top double")
    box = (0.0, 0.0, 1.0, 0.1)
    rows = [(1, 6, 0, "alpha beta xx yy", *box), (1, 4, 0, "alpha beta xx yy", *box), (1, 5, 0, "alpha zz", *box), (1, 8, 0, "alpha beta gamma delta", *box)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_no int, block_seq int, norm_text string, l double, t double, r double, b double")
    got = evaluate.align_outline(outline, blocks).orderBy("rank").collect()
    assert [(r.page_no, r.band, r.shared, r.distance) for r in got] == [(4, "ModerateOverlap", 2, None), (6, "ModerateOverlap", 2, None), (5, "WeakOverlap", 1, None)]


BOXES = "doc_id long, page_no int, seq int, l double, t double, r double, b double"


def test_box_matches(spark):
    expected = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.2, 0.2), (1, 2, 0, 0.0, 0.0, 0.1, 0.1)], BOXES)
    # the large box covers the expected one whole, the small one has the greater overlap over union
    predicted = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.2, 0.16), (1, 1, 1, 0.0, 0.0, 1.0, 1.0), (1, 1, 2, 0.0, 0.0, 1.0, 1.0)], BOXES)
    got = {r.page_no: r for r in evaluate.box_matches(expected, predicted).collect()}
    assert got[1].predicted == 1 and got[1].score == got[1].expected_coverage == pytest.approx(1.0) and got[1].iou == pytest.approx(0.04)
    assert got[2].predicted is None and got[2].score is None


def test_columns_beside_each_other(spark):
    rows = [
        (1, 1, 0, 0.05, 0.1, 0.45, 0.5), (1, 1, 1, 0.55, 0.1, 0.95, 0.5), (1, 1, 2, 0.05, 0.3, 0.45, 0.9),  # two columns
        (1, 2, 0, 0.05, 0.1, 0.2, 0.5), (1, 2, 1, 0.55, 0.1, 0.95, 0.5),  # too narrow
        (1, 3, 0, 0.05, 0.1, 0.85, 0.5), (1, 3, 1, 0.55, 0.1, 0.95, 0.5),  # too wide
        (1, 4, 0, 0.05, 0.1, 0.45, 0.15), (1, 4, 1, 0.55, 0.1, 0.95, 0.5),  # too low
    ]
    got = {r.page_no: (r.pairs, r.score) for r in evaluate.multi_column_score(spark.createDataFrame(rows, BOXES)).collect()}
    assert got[1] == (2, pytest.approx(1.5)) and got[2] == got[3] == got[4] == (0, 0.0)


def test_sentinels(spark):
    regions = spark.createDataFrame([(1, p, s, t) for p in (1, 2, 3, 4) for s, t in enumerate(["The  First", "second line", "first again"])], "doc_id long, page_no int, seq int, text string")
    marks = [(1, 1, 0, "the first"), (1, 1, 1, "SECOND"), (1, 2, 0, "first"), (1, 2, 1, "the"), (1, 3, 0, "none"), (1, 3, 1, "second"), (1, 4, 0, "second")]
    got = evaluate.sentinel_order(regions, spark.createDataFrame(marks, "doc_id long, page_no int, position int, sentinel string")).collect()
    assert {r.page_no: (r.passed, r.reason) for r in got} == {1: (True, None), 2: (False, "not in order"), 3: (False, "first not found"), 4: (False, "not two sentinels")}


def test_outline_matches(spark):
    outline = spark.createDataFrame([(1, 0, " Title One ", 1), (1, 1, "* title one", 1), (1, 2, "TitleOne", 1), (1, 3, "***", 1)], "doc_id long, ordinal long, title string, target_page int")
    blocks = spark.createDataFrame([(1, 1, 0, "---"), (1, 1, 1, "title one"), (1, 1, 2, "Title One")], "doc_id long, page_no int, block_seq int, norm_text string")
    got = {r.ordinal: (r.block_seq, r.match) for r in evaluate.match_outline(outline, blocks).collect()}
    assert got == {0: (1, "ExactText"), 1: (1, "NormalizedText"), 2: (1, "CompactText"), 3: (None, "None")}


def test_title_match(spark):
    titles = spark.createDataFrame([(1, 1, "The Long Title"), (1, 2, " "), (1, 3, "nothing alike")], "doc_id long, page_no int, title string")
    regions = spark.createDataFrame([(1, 1, 3, "noise"), (1, 1, 5, "the long"), (1, 1, 9, "title"), (1, 1, 10, "title"), (1, 2, 0, "x"), (1, 3, 0, "y z")], "doc_id long, page_no int, seq int, text string")
    got = evaluate.match_titles(titles, regions).collect()
    assert [(r.page_no, r.band, r.first_region, r["size"]) for r in got] == [(1, "ExactEquivalent", 1, 2)]


def test_specimens(spark):
    schema = "document_id string, name string, year int, chars int, regions int, score double"
    rows = [("a", "1", 1500, 999, 9, 0.0), ("b", "1", 1510, 1000, 1, 0.0), ("c", "1", 1750, 2000, 1, 0.0), ("d", "1", 1850, 2000, 1, 0.0), ("e", "1", None, 10, 5, 0.0)]
    pick = lambda r: [(x.category, x.document_id) for x in evaluate.select_specimens(spark.createDataFrame(r, schema)).orderBy("place").collect()]
    assert pick(rows) == [("early-print", "b"), ("eighteenth-century", "c"), ("nineteenth-century", "d"), ("complex-layout-fallback", "a")]
    more = [*rows, ("f", "hilbert_zahlkoerper_1897_0379.xml", None, 5, 1, 0.9), ("g", "1", None, 1000, 1, 0.5)]
    assert pick(more)[2:] == [("nineteenth-century", "f"), ("multi-column", "g")]
    with pytest.raises(ValueError, match="eighteenth"):
        pick([r for r in more if r[0] != "c"])


def test_raster_measurements():
    w, h = 64, 48
    image = np.full((h, w, 4), 255, dtype=np.uint8)
    assert measures.measure(image.tobytes(), w, h, [])["fg_state"] == "BlankCanvas"
    image[10:20, 10:30, :3] = 0
    image[30:32, 40:42, :3] = 0
    got = measures.measure(image.tobytes(), w, h, [])
    assert got["fg_state"] == "Measured" and got["components"] == 1 and got["interaction"] == "NoNativeWords" and got["effective"] == [10 / 64, 10 / 48, 30 / 64, 20 / 48]
    assert got["fg_ratio"] == (200 + 4) / (w * h)
    words = [(0.0, 0.0, 0.05, 0.05), (0.2, 0.25, 0.3, 0.35)]
    assert measures.measure(image.tobytes(), w, h, words)["interaction"] == "ForegroundWordInteraction"
    assert measures.measure(image.tobytes(), w, h, words[:1])["interaction"] == "NoForegroundWordIntersection"
    rng = np.random.default_rng(0)
    assert measures.measure(rng.integers(0, 255, (h, w, 4), dtype=np.uint8).tobytes(), w, h, [])["fg_state"] == "Unavailable"
    assert measures.measure(None, w, h, [])["fg_state"] == measures.measure(b"abc", w, h, [])["fg_state"] == "Unavailable"


def test_components_of_shapes():
    mask = np.array([[1, 0, 1, 0, 0], [0, 1, 0, 0, 1], [0, 0, 0, 0, 1], [1, 1, 0, 1, 1]], dtype=bool)
    assert sorted(p[0] for p in measures._components(mask)) == [2, 3, 4]


def test_visuals_behind_the_text(spark):
    texts = spark.createDataFrame([(1, "element-000001", "Heading", "segment-000001"), (1, "element-000002", "Text", "segment-000001")], "doc_id long, element_id string, kind string, segment_id string")
    kinds = ["PublicationPresentationVisual", "Unknown", "StructuredContentMeaningfulVisual"]
    images = spark.createDataFrame([(1, 5, kinds[2]), (1, 2, kinds[1]), (1, 0, kinds[0]), (2, 0, kinds[1])], "doc_id long, candidate long, kind string")
    got = structured.append_visuals(texts, images).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.element_id, r.kind, r.qualification) for r in got] == [
        (1, 0, "element-000001", "Heading", None), (1, 1, "element-000002", "Text", None), (1, 2, "element-000003", "Visual", "Unqualified"), (1, 3, "element-000004", "Visual", "Meaningful"),
        (2, 0, "element-000001", "Visual", "Unqualified"),
    ]


def test_preferred_uses_and_terminal_units(spark):
    schema = "doc_id long, use_idx int, resource string, in_figure boolean, presentation boolean, empty_alt boolean, is_cover boolean, is_nav boolean, is_preliminary boolean, is_auxiliary boolean, has_boundary boolean, is_terminal boolean, byte_length int"
    no, yes = False, True
    rows = [(1, 0, "x", no, no, yes, yes, no, no, no, yes, yes, 10), (1, 1, "x", no, no, yes, no, no, no, yes, yes, yes, 10), (1, 2, "x", no, no, yes, no, no, no, no, yes, no, 10), (1, 3, "y", no, yes, yes, no, no, no, yes, yes, yes, None)]
    got = {r.resource: r for r in structured.visual_candidates(spark.createDataFrame(rows, schema)).collect()}
    assert (got["x"].preferred_use, got["x"].candidate_id, got["x"].is_auxiliary, got["x"].is_terminal, got["x"].is_repeated) == (2, "structured-visual-000001", no, no, yes)
    assert (got["y"].preferred_use, got["y"].candidate_id, got["y"].is_auxiliary, got["y"].has_boundary, got["y"].is_repeated) == (3, "structured-visual-000002", yes, yes, no)
    units = [(1, 1, 1, 0, 0, yes, no), (2, 1, 2, 2, 3, no, no), (3, 1, 2, 2, 3, yes, no), (4, 1, 2, 2, 0, no, yes), (5, 1, 1, 5, 3, no, no), (6, 1, 0, 0, 0, no, no)]
    frame = spark.createDataFrame(units, "doc_id long, unit_no int, images int, links int, blocks int, listed boolean, boundary boolean")
    assert {r.doc_id: r.terminal for r in structured.terminal_units(frame).collect()} == {1: yes, 2: yes, 3: no, 4: no, 5: no, 6: no}


def test_visual_candidates_and_units(spark):
    schema = "doc_id long, use_idx int, resource string, in_figure boolean, presentation boolean, empty_alt boolean, is_cover boolean, is_nav boolean, is_preliminary boolean, byte_length int"
    rows = [(1, 0, "b", False, True, True, False, False, False, 900), (1, 1, "a", False, False, False, True, False, True, 10), (1, 2, "b", False, True, True, False, False, True, 900), (1, 3, "c", True, False, True, False, False, False, 900), (1, 4, "c", False, False, True, False, False, False, 900)]
    got = structured.visual_candidates(spark.createDataFrame(rows, schema)).orderBy("candidate").collect()
    assert [(r.resource, r.is_repeated, r.is_presentation, r.is_figure, r.is_cover) for r in got] == [("b", True, True, False, False), ("a", False, False, False, True), ("c", False, False, True, False)]
