"""What grows with the input: shuffles of evidence, buckets, Python frames."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import quirework.queries as engine
from quirework.plans import evaluate_queries as eq
from quirework.plans import evidence as ev
from quirework.plans import page_queries as pq
from quirework.plans import result_queries as rq
from quirework.plans import source_queries as sq
from quirework.sources import epub

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BY_DOCUMENT = (
    "segment_quality", "segment_provenance", "segment_assignment", "document_quality", "counterfactual_policies", "outline_levels", "gate_comparisons", "book_results", "book_segments", "title_matches", "book_elements", "page_results",
    "outline_alignment", "segments_native", "body_font_size", "normalization_metrics", "lexical_candidates", "hybrid_segments",
)


@pytest.fixture
def shuffled(spark):
    """Joins as over large tables, none by broadcast."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def exchanges(frame) -> list[str]:
    return re.findall(r"Exchange (?:hash|range|Single|RoundRobin)\S*", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_evidence_stays_where_it_lies(spark, shuffled, name):
    assert exchanges(engine.QUERIES[name](spark, DATA)) == []


@pytest.mark.parametrize("get", [ev.norm_blocks, ev.heading_blocks, ev.pages, pq._pairings, rq._raw_elements, rq._normalized_elements, rq.members, sq._book_blocks])
def test_evidence_is_made_where_it_lies(spark, shuffled, get):
    assert exchanges(get.build(spark, DATA)) == []


def test_summaries_shuffle_sums_alone(spark, shuffled):
    for name in ("typography_bands", "band_summary"):
        assert len(exchanges(engine.QUERIES[name](spark, DATA))) <= 2


def test_buckets_follow_the_input(spark, monkeypatch):
    before = {n: sorted(map(repr, engine.QUERIES[n](spark, DATA).collect())) for n in ("segment_quality", "segments_native")}
    ev.forget()
    monkeypatch.setattr(ev, "BUCKET_BYTES", 10_000)
    try:
        assert ev.buckets(spark, DATA) > 20
        assert ev.dealt(spark, DATA).rdd.getNumPartitions() == ev.buckets(spark, DATA)
        for n, rows in before.items():
            assert sorted(map(repr, engine.QUERIES[n](spark, DATA).collect())) == rows
    finally:
        ev.forget()


def test_frames_of_books_are_bounded(spark, monkeypatch):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words\n', 2000)").alias("text"))
    most = 0
    frame, real = epub.pd.DataFrame, epub.read_book

    def made(rows, columns):
        nonlocal most
        most = max(most, sum(len(b[3]) for r in rows for b in r[6]))
        return frame(rows, columns=columns)

    class Source:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _schema):
            return run

    content = [bytes(r.content) for r in docs.select(sq._as_book("doc_id", "text").alias("content")).collect()]
    run = epub.read_books(Source())
    monkeypatch.setattr(epub, "FRAME_BYTES", 1 << 20)
    monkeypatch.setattr(epub.pd, "DataFrame", made)
    out = list(run(iter([frame({"doc_id": range(40), "content": content})])))
    assert real is epub.read_book and sum(map(len, out)) == 40 and len(out) > 5 and most < 1 << 20


def test_numbers_are_read_before_the_pairs(spark, shuffled):
    plan = eq.outline_alignment(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan.split("Join Inner")[0]
    assert "cluster_text" not in ranked and "regexp_extract" not in ranked


def test_words_that_meet_a_box_are_found_once(spark, shuffled):
    plan = pq.native_extents(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any("lambda" in line for line in joins)
