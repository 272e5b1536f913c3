"""Candidate against authoritative plans and texts (ids N1-N6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.measures import projection_fingerprint, text_fingerprint
from quirework.operators.assemble import deferred_elements, reconciled_elements
from quirework.operators.reconcile import READ_KINDS

BUCKETS = 10_000


def sampling_bucket(sha256: Column) -> Column:
    """The first 16 hexadecimal digits as a number, modulo 10000."""
    return (F.conv(F.substring(sha256, 1, 16), 16, 10).cast("decimal(20,0)") % BUCKETS).cast("long")


def select_profile(documents: DataFrame, profile: str, basis_points: int) -> DataFrame:
    """Documents (with sha256) that a candidate run takes; Sampled takes a stable share."""
    if not 0 <= basis_points <= BUCKETS:
        raise ValueError("basis points are 0..10000")
    bucket = sampling_bucket(F.col("sha256"))
    taken = {"Disabled": F.lit(False), "PlanningOnly": F.lit(True), "Full": F.lit(True), "Sampled": bucket < basis_points}[profile]
    return documents.withColumns({"bucket": bucket, "selected": taken})


def compare_plans(authoritative: DataFrame, candidate: DataFrame) -> DataFrame:
    """(doc_id, page_no, mode, requires_ocr, visual_work) of both, page by page."""
    a, c = authoritative.alias("a"), candidate.alias("c")
    out = a.join(c, (F.col("a.doc_id") == F.col("c.doc_id")) & (F.col("a.page_no") == F.col("c.page_no")))
    return out.select(
        "a.doc_id", "a.page_no", (F.col("a.mode") == F.col("c.mode")).alias("agrees"), (F.col("a.requires_ocr") & ~F.col("c.requires_ocr")).alias("removes_text_work"), (F.col("c.visual_work") & ~F.col("a.visual_work")).alias("adds_visual_work")
    )


def planning_report(comparison: DataFrame) -> DataFrame:
    """N3."""
    return comparison.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if("agrees").alias("agreeing"), F.count_if("removes_text_work").alias("removing"), F.count_if("adds_visual_work").alias("adding"), F.bool_and("agrees").alias("all_agree")
    )


def compare_texts(authoritative: DataFrame, candidate: DataFrame, facts: list[str]) -> DataFrame:
    """Elements joined by position; is the text the same, and are all facts?"""
    key = ["doc_id", "page_no", "order"]
    on = [F.col(f"a.{k}") == F.col(f"c.{k}") for k in key]
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"c.{f}"))
    both = F.col("__a").isNotNull() & F.col("__c").isNotNull()
    out = authoritative.withColumn("__a", F.lit(1)).alias("a").join(candidate.withColumn("__c", F.lit(1)).alias("c"), on, "full_outer")
    return out.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"c.{k}")).alias(k) for k in key), (both & F.col("a.text").eqNullSafe(F.col("c.text"))).alias("same_text"), (both & same).alias("same_projection"))


def candidate_report(comparison: DataFrame) -> DataFrame:
    """N4 and N5."""
    return comparison.groupBy("doc_id").agg(F.count("*").alias("elements"), F.count_if("same_text").alias("same_text"), F.count_if("same_projection").alias("same_projection"), F.bool_and("same_text").alias("text_exact"), F.bool_and("same_projection").alias("projection_exact"))


#: The candidate text modes and the only native state each is valid for.
CANDIDATE_MODES = {"TargetedOcrRecovery": "Missing", "TargetedOcrVerification": "Unverified", "TargetedOcrReconciliation": "Suspicious"}


def candidate_pages(plans: DataFrame) -> DataFrame:
    """(doc_id, page_no, mode, status) of pages that a candidate run reads, and whether it may.

    A page whose mode doesn't belong to its native state fails; pages without a text mode
    aren't run.
    """
    valid = F.lit(False)
    for mode, state in CANDIDATE_MODES.items():
        valid = valid | ((F.col("mode") == mode) & (F.col("status") == state))
    out = plans.filter(F.col("mode") != "NativeText")
    return out.select("doc_id", "page_no", "mode", "status", F.when(F.coalesce(valid, F.lit(False)), "Completed").otherwise("Failed").alias("outcome"))


def candidate_elements(pages: DataFrame, reconciled: DataFrame, layout: DataFrame) -> DataFrame:
    """Of completed pages, the reconciled boxes and, as neutral evidence, boxes that are neither text nor figures."""
    key = ["doc_id", "page_no"]
    done = pages.filter("outcome = 'Completed'").select(*key)
    rest = layout.filter(~F.col("kind").isin(*READ_KINDS, "Figure"))
    return reconciled_elements(reconciled).unionByName(deferred_elements(rest)).join(done, key, "left_semi")


#: In the order a run goes through them.
PLANNING_STAGES = ("Capability", "NativeNormalization", "RasterObservation", "StructuralEnrichment", "CandidatePlanning")


def planning_outcomes(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """(doc_id, status, stage, message) of a candidate planning run of each document.

    documents: doc_id, supported, pages, authoritative and candidate (planned pages of both
    sides). failures: doc_id, stage, message. The first stage that fails ends a run; a plan
    that doesn't cover all pages fails at Capability (authoritative) or CandidatePlanning.
    """
    place = F.array_position(F.array(*map(F.lit, PLANNING_STAGES)), F.col("stage"))
    told = failures.select("doc_id", place.alias("at"), "stage", "message")
    covers = lambda side: F.concat(F.col(side).cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(" pages"))
    short = [(1, "Capability", "authoritative"), (len(PLANNING_STAGES), "CandidatePlanning", "candidate")]
    for at, stage, side in short:
        missing = documents.filter(F.col(side) != F.col("pages")).select("doc_id", F.lit(at).cast("long").alias("at"), F.lit(stage).alias("stage"), covers(side).alias("message"))
        told = told.unionByName(missing)
    first = told.groupBy("doc_id").agg(F.min(F.struct("at", "message", "stage")).alias("first"))
    out = documents.join(first, "doc_id", "left")
    failed = F.col("supported") & F.col("first").isNotNull()
    status = F.when(~F.col("supported"), "UnsupportedFormat").when(failed, "Failed").otherwise("Completed")
    return out.select("doc_id", status.alias("status"), F.when(failed, F.col("first.stage")).alias("stage"), F.when(failed, F.col("first.message")).alias("message"))


def fingerprints(elements: DataFrame) -> DataFrame:
    """(doc_id, text_fingerprint, projection_fingerprint) of the elements with a text of their own, in order."""
    own = elements.filter(F.col("text").isNotNull() & F.col("origin").isin("Native", "Ocr"))
    place = [F.col(c).cast("int").alias(c) for c in ("page_no", "order")]
    entry = F.struct(*place, "text", "l", "t", "r", "b", "kind", "origin", F.col("block_seq").cast("int").alias("block_seq"), F.col("decision").isNotNull().alias("reconciled"))
    held = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("held"))
    return held.select("doc_id", text_fingerprint("held").alias("text_fingerprint"), projection_fingerprint("held").alias("projection_fingerprint"))
