"""Structured, non-paged documents (ids J5-J7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.assess import DISPOSITION, mapped
from quirework.operators.text import collapse

REPEATED_BYTES = 1024


def visual_candidates(usages: DataFrame) -> DataFrame:
    """A row for each resource of a document, first seen first, with its uses folded.

    usages: doc_id, use_idx, resource, in_figure, presentation, empty_alt, is_cover, is_nav,
    is_preliminary, byte_length, and where known is_auxiliary, has_boundary, is_terminal (else
    false). preferred_use is the first that is neither cover, navigation, presentation nor
    auxiliary, or else the first.
    """
    known = lambda c: F.col(c) if c in usages.columns else F.lit(False)
    plain = ~(F.col("is_cover") | F.col("is_nav") | F.col("presentation") | known("is_auxiliary"))
    out = usages.groupBy("doc_id", "resource").agg(
        F.count("*").alias("uses"), F.min("use_idx").alias("first_use"), F.min(F.when(plain, F.col("use_idx"))).alias("plain_use"), F.bool_or("in_figure").alias("is_figure"),
        F.bool_and("presentation").alias("is_presentation"), F.bool_or("is_cover").alias("is_cover"), F.bool_and("is_nav").alias("is_nav"), F.bool_and("is_preliminary").alias("is_preliminary"),
        F.bool_and(known("is_auxiliary")).alias("is_auxiliary"), F.bool_and(known("has_boundary")).alias("has_boundary"), F.bool_and(known("is_terminal")).alias("is_terminal"),
        F.bool_and(F.col("empty_alt") & ~F.col("in_figure")).alias("mute"), F.max("byte_length").alias("byte_length"),
    )
    repeated = (F.col("uses") > 1) & F.col("mute") & F.coalesce(F.col("byte_length") <= REPEATED_BYTES, F.lit(False))
    order = Window.partitionBy("doc_id").orderBy("first_use", "resource")
    out = out.withColumns({"is_repeated": repeated, "candidate": (F.row_number().over(order) - 1).cast("long"), "preferred_use": F.coalesce("plain_use", "first_use")})
    return out.withColumn("candidate_id", F.format_string("structured-visual-%06d", F.col("candidate") + 1)).drop("mute", "plain_use")


def terminal_units(units: DataFrame) -> DataFrame:
    """The last unit of a document, if it is images for show: no text, or several unlisted images with as many links.

    units: doc_id, unit_no, images, links, blocks, listed, and where known boundary (the book
    marks where its body is: then nothing is for show).
    """
    last = Window.partitionBy("doc_id").orderBy(F.desc("unit_no"))
    out = units.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    boundary = F.col("boundary") if "boundary" in units.columns else F.lit(False)
    linked = (F.col("images") >= 2) & ~F.col("listed") & (F.col("links") >= F.col("images"))
    return out.withColumn("terminal", ~boundary & (F.col("images") > 0) & ((F.col("blocks") == 0) | linked))


def project_units(blocks: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Elements with ids from 1, hashes and the segment of their unit; units for show and blank blocks go.

    blocks: doc_id, unit_no, block_idx, kind, text. units: doc_id, unit_no, presentation_only;
    without them each block has its unit's presentation_only. One sort numbers both.
    """
    live = blocks.filter("not presentation_only") if units is None else blocks.join(units.filter("not presentation_only").select("doc_id", "unit_no"), ["doc_id", "unit_no"], "left_semi")
    live = live.withColumn("text", collapse(F.col("text"))).filter("text <> ''")
    flow = Window.partitionBy("doc_id").orderBy("unit_no", "block_idx")
    out = live.withColumns({"element_no": F.row_number().over(flow), "__new": F.coalesce(F.lag("unit_no").over(flow) != F.col("unit_no"), F.lit(True)).cast("int")})
    out = out.withColumn("segment_no", F.sum("__new").over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select("doc_id", "unit_no", "block_idx", F.format_string("element-%06d", "element_no").alias("element_id"), F.format_string("segment-%06d", "segment_no").alias("segment_id"), "kind", "text", F.sha2("text", 256).alias("text_sha256"))


def append_visuals(elements: DataFrame, visuals: DataFrame) -> DataFrame:
    """(doc_id, ordinal, element_id, kind, segment_id, qualification): preserved images behind a document's text.

    visuals: doc_id, candidate, kind (of G9). Those that are preserved or still to be looked at
    become elements in the order of their candidates, outside all segments; the others aren't
    part of the result.
    """
    kept = visuals.withColumn("disposition", mapped(F.col("kind"), DISPOSITION)).filter(F.col("disposition").isin("PreserveMeaningfulVisual", "RequiresVisualAnalysis"))
    order = Window.partitionBy("doc_id").orderBy("candidate")
    texts = elements.groupBy("doc_id").agg(F.count("*").alias("texts"))
    behind = kept.withColumn("nth", F.row_number().over(order)).join(texts, "doc_id", "left")
    number = F.coalesce("texts", F.lit(0)) + F.col("nth")
    meaningful = F.when(F.col("kind") == "StructuredContentMeaningfulVisual", "Meaningful").otherwise("Unqualified")
    shown = behind.select("doc_id", (number - 1).cast("long").alias("ordinal"), F.format_string("element-%06d", number).alias("element_id"), F.lit("Visual").alias("kind"), F.lit(None).cast("string").alias("segment_id"), meaningful.alias("qualification"))
    number = F.substring("element_id", 9, 20).cast("long") - 1
    told = elements.select("doc_id", number.alias("ordinal"), "element_id", "kind", "segment_id", F.lit(None).cast("string").alias("qualification"))
    return told.unionByName(shown)


def unit_segments(elements: DataFrame) -> DataFrame:
    """A segment a unit; its first heading names it."""
    held = F.array_sort(F.collect_list(F.struct("block_idx", "text")))
    out = elements.groupBy("doc_id", "segment_id").agg(
        F.count("*").alias("elements"), F.min(F.when(F.col("kind") == "Heading", F.struct("block_idx", "text"))).alias("h"), F.array_join(F.transform(held, lambda x: x["text"]), "\n\n").alias("text")
    )
    return out.select("doc_id", "segment_id", "elements", F.col("h.text").alias("heading_text"), "text", F.sha2("text", 256).alias("text_sha256"))
