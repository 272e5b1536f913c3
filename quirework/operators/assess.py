"""Page and document assessment and planning (ids E1-E11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMINANT_RASTER = 0.60

ROUTES = {"Healthy": "NativeOnly", "Missing": "LayoutWithTargetedOcrRecovery", "Suspicious": "LayoutWithTargetedOcrReconciliation", "Unverified": "LayoutWithTargetedOcrReconciliation"}
AUTHORITY = {"Missing": "Missing", "Healthy": "Trusted", "Unverified": "NeedsVerification", "Suspicious": "Corrupted"}
DISPOSITION = {
    "Unknown": "RequiresVisualAnalysis", "BlankCanvas": "PresentationOnly", "TinyOrNoise": "PresentationOnly", "SmallHeadingAssociatedVisual": "PresentationOnly",
    "HeadingBackplateOrPresentation": "PresentationOnly", "NativeTextContainerOrFrame": "PresentationOnly", "PublicationPresentationVisual": "PresentationOnly",
    "SourceBackedMeaningfulVisual": "PreserveMeaningfulVisual", "SourceBackedUnqualifiedVisual": "PreserveUnqualifiedVisual", "CaptionedMeaningfulVisual": "PreserveMeaningfulVisual",
    "LargeIndependentVisual": "PreserveMeaningfulVisual", "StructuredContentMeaningfulVisual": "PreserveMeaningfulVisual",
}
ACTIONS = {"NoVisual": "NoAdditionalSemanticProcessing", "PresentationOnly": "NoAdditionalSemanticProcessing", "PreserveMeaningfulVisual": "PreserveMeaningfulVisual", "PreserveUnqualifiedVisual": "PreserveUnqualifiedVisual", "RequiresVisualAnalysis": "AnalyzeVisual"}
MODES = {"UseNativeText": "NativeText", "RecoverMissingNativeText": "TargetedOcrRecovery", "VerifyNativeText": "TargetedOcrVerification", "ReconcileCorruptedNativeText": "TargetedOcrReconciliation"}
#: Text modes that may replace a page's authoritative treatment.
ALLOWED = {"Missing": ["TargetedOcrRecovery"], "Suspicious": ["TargetedOcrReconciliation"], "Unverified": ["NativeText", "TargetedOcrVerification"], "Healthy": ["NativeText"]}


def mapped(key: Column, table: dict[str, str]) -> Column:
    """A closed map of names; a name outside it is an error of the caller's data and gives null."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def hard_failure(source_text: Column, word_count: Column, words: Column, blocks: Column) -> Column:
    """No blocks, counts that differ, blank text, or replacement, private-use or control characters."""
    spoilt = source_text.rlike("[\\ufffd\\p{Co}]") | source_text.rlike(r"[\p{Cc}&&[^\r\n\t]]")
    blank = ~source_text.rlike(r"[^\t\n\x0B\f\r\x85\p{Z}]")
    return (blocks == 0) | (words != word_count) | F.coalesce(blank, F.lit(True)) | F.coalesce(spoilt, F.lit(False))


def page_status(word_count: Column, failed: Column, images: Column, ratio: Column) -> Column:
    """The order of the tests matters."""
    return F.when(word_count == 0, "Missing").when(failed, "Suspicious").when((images > 0) & (ratio >= DOMINANT_RASTER), "Unverified").otherwise("Healthy")


def assess_pages(pages: DataFrame) -> DataFrame:
    """Status, route and text authority of (word_count, words, block_count, source_text, raster_image_count, largest_raster_ratio)."""
    failed = hard_failure(F.col("source_text"), F.col("word_count"), F.col("words"), F.col("block_count"))
    out = pages.withColumn("status", page_status(F.col("word_count"), failed, F.col("raster_image_count"), F.col("largest_raster_ratio")))
    return out.withColumns({"route": mapped(F.col("status"), ROUTES), "authority": mapped(F.col("status"), AUTHORITY)})


def preflight(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for every document, with or without pages."""
    text, raster = F.col("word_count") > 0, (F.col("raster_image_count") > 0) & (F.col("largest_raster_ratio") >= DOMINANT_RASTER)
    found = pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.count_if(text).alias("text_pages"), F.count_if(raster).alias("raster_pages"), F.count_if(~text & raster).alias("bare_raster_pages"),
        F.array_sort(F.collect_list(F.when(~text, F.col("page_no").cast("long")))).alias("textless"), F.sum("word_count").alias("words"),
    )
    out = documents.select("doc_id").join(found, "doc_id", "left")
    n, t = F.coalesce("page_count", F.lit(0)), F.coalesce("text_pages", F.lit(0))
    kind = F.when(n == 0, "Problematic").when(t == n, "HealthyBornDigital").when(t > 0, "Hybrid").when(F.col("bare_raster_pages") == n, "RasterOrScanned").otherwise("Problematic")
    coverage = F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * t / n, 1))
    return out.select(
        "doc_id", n.cast("long").alias("page_count"), t.cast("long").alias("text_pages"), F.coalesce("raster_pages", F.lit(0)).cast("long").alias("raster_pages"),
        F.coalesce("words", F.lit(0)).cast("long").alias("words"), coverage.alias("coverage"), F.array_join(F.transform(F.coalesce("textless", F.array().cast("array<bigint>")), lambda x: x.cast("string")), ",").alias("textless_pages"), kind.alias("classification"),
    )


def text_requirements(pages: DataFrame, visuals: DataFrame) -> DataFrame:
    """The text requirement of each page, given the kinds of its visuals.

    A page that needs verification keeps its text if it has visuals and none is unexplained.
    """
    placed = visuals.withColumn("disposition", mapped(F.col("kind"), DISPOSITION))
    found = placed.groupBy("doc_id", "page_no").agg(F.count("*").alias("visuals"), F.bool_or(F.col("disposition") == "RequiresVisualAnalysis").alias("unexplained"))
    out = pages.join(found, ["doc_id", "page_no"], "left").fillna({"visuals": 0, "unexplained": False})
    explained = (F.col("visuals") > 0) & ~F.col("unexplained")
    need = (
        F.when(F.col("authority") == "Trusted", "UseNativeText").when(F.col("authority") == "Missing", "RecoverMissingNativeText")
        .when(F.col("authority") == "Corrupted", "ReconcileCorruptedNativeText").when(explained, "UseNativeText").otherwise("VerifyNativeText")
    )
    return out.withColumn("requirement", need)


def compile_plans(pages: DataFrame, visuals: DataFrame) -> DataFrame:
    """Execution mode and derived flags of each page."""
    actions = visuals.withColumn("action", mapped(mapped(F.col("kind"), DISPOSITION), ACTIONS))
    found = actions.groupBy("doc_id", "page_no").agg(F.bool_or(F.col("action") == "AnalyzeVisual").alias("analyze"), F.bool_or(F.col("action").startswith("Preserve")).alias("preserve"))
    out = text_requirements(pages, visuals).join(found, ["doc_id", "page_no"], "left").fillna({"analyze": False, "preserve": False})
    out = out.withColumn("mode", mapped(F.col("requirement"), MODES))
    text = F.col("mode") != "NativeText"
    return out.withColumns(
        {
            "requires_ocr": text,
            "requires_layout": text | F.col("analyze"),
            "requires_raster": text | F.col("analyze") | F.col("preserve"),
            "requires_reconciliation": F.col("mode").isin("TargetedOcrVerification", "TargetedOcrReconciliation"),
            "requires_preservation": F.col("preserve"),
        }
    )


def guard_plans(plans: DataFrame) -> DataFrame:
    """Is the candidate mode one that the page's status allows?"""
    allowed = F.lit(False)
    for status, modes in ALLOWED.items():
        allowed = allowed | ((F.col("status") == status) & F.col("mode").isin(modes))
    return plans.withColumn("allowed", allowed)


def visual_coverage(visuals: DataFrame, declared: DataFrame) -> DataFrame:
    """Pages whose visual indexes aren't exactly 0 .. n-1."""
    seen = visuals.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.countDistinct("visual_idx").alias("k"), F.min("visual_idx").alias("least"), F.max("visual_idx").alias("most"))
    out = declared.join(seen, ["doc_id", "page_no"], "full_outer").fillna({"n": 0, "k": 0, "expected": 0})
    wrong = (F.col("n") != F.col("expected")) | (F.col("k") != F.col("n")) | ((F.col("n") > 0) & ((F.col("least") != 0) | (F.col("most") != F.col("n") - 1)))
    return out.filter(wrong).select("doc_id", "page_no", "expected", F.col("n").alias("found"))


def needs_layout(pages: DataFrame) -> DataFrame:
    """Pages for the layout provider; filter before any provider call."""
    return pages.filter((F.col("route") != "NativeOnly") | ((F.col("status") == "Healthy") & (F.col("raster_image_count") > 0)))


def unsafe_documents(preflights: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents that aren't healthy though all their pages are native only."""
    native = pages.groupBy("doc_id").agg(F.bool_and(F.col("route") == "NativeOnly").alias("all_native"))
    return preflights.filter("classification <> 'HealthyBornDigital'").join(native.filter("all_native"), "doc_id").select("doc_id", "classification")
