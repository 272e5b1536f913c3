"""Assembly of elements (H1-H8), hybrid normalisation (B7) and hybrid segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.segment import hint_keys, hinted, native_heading, numbered_segments
from quirework.operators.text import normalize_blocks

ELEMENT = ["doc_id", "page_no", "order", "kind", "text", "origin", "obs_seq", "block_seq", "decision"]


def textual_kind(layout_kind: Column) -> Column:
    """H2."""
    return F.when(layout_kind == "Heading", "Heading").when(layout_kind == "Caption", "Caption").when(layout_kind.isin("Text", "Table"), "Text")


def _element(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    null = {"text": F.lit(None).cast("string"), "obs_seq": F.lit(None).cast("int"), "block_seq": F.lit(None).cast("int"), "decision": F.lit(None).cast("string"), "origin": F.lit("None")}
    made = null | columns
    return df.select("doc_id", "page_no", *(made[c].alias(c) for c in ELEMENT[2:]), *(keep or []))


def native_elements(blocks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """H1 and H5: a block's own reading order, or its sequence. keep: columns to carry along, here as below."""
    order = F.coalesce(F.col("reading_order"), F.col("block_seq")) if "reading_order" in blocks.columns else F.col("block_seq")
    return _element(blocks, keep, order=order, kind=F.lit("Text"), text=F.col("text"), origin=F.lit("Native"), block_seq=F.col("block_seq"))


def reconciled_elements(reconciled: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """H1: a resolved box is text of its kind, an unresolved one has none."""
    done = F.col("selected_text").isNotNull()
    kind = F.when(done, textual_kind(F.col("kind"))).otherwise("UnresolvedText")
    order = F.coalesce("reading_order", F.lit(2147483647))
    return _element(reconciled, keep, order=order, kind=kind, text=F.col("selected_text"), origin=F.col("origin"), obs_seq=F.col("obs_seq"), decision=F.col("decision"))


def visual_elements(figures: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """H1 and H9: (reading_order, obs_seq, element_kind) of preserved and deferred figures."""
    return _element(figures, keep, order=F.col("reading_order"), kind=F.col("element_kind"), obs_seq=F.col("obs_seq"))


def deferred_elements(layout: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """H6: boxes of kinds that nothing processes."""
    return _element(layout, keep, order=F.coalesce("reading_order", F.lit(2147483647)), kind=F.lit("Deferred"), obs_seq=F.col("obs_seq"))


def assembly_violations(elements: DataFrame, word_ranges: DataFrame | None = None) -> DataFrame:
    """H3: orders and layout boxes used twice on a page, and native word ranges that overlap in a block.

    word_ranges: doc_id, page_no, block_seq, element, first_word, last_word. Ranges are put in
    order once; a range overlaps an earlier one if it begins before the last end so far.
    """
    key = ["doc_id", "page_no"]
    orders = elements.groupBy(*key, "order").agg(F.count("*").alias("n")).filter("n > 1").select(*key, F.lit("duplicate-order").alias("rule"), F.col("order").cast("long").alias("detail"))
    boxes = elements.filter("obs_seq is not null").groupBy(*key, "obs_seq").agg(F.count("*").alias("n")).filter("n > 1").select(*key, F.lit("duplicate-layout").alias("rule"), F.col("obs_seq").cast("long").alias("detail"))
    out = orders.unionByName(boxes)
    if word_ranges is not None:
        earlier = Window.partitionBy(*key, "block_seq").orderBy("first_word", "last_word", "element").rowsBetween(Window.unboundedPreceding, -1)
        crossed = word_ranges.withColumn("end", F.max("last_word").over(earlier)).filter(F.col("first_word") <= F.col("end"))
        out = out.unionByName(crossed.select(*key, F.lit("overlapping-words").alias("rule"), F.col("block_seq").cast("long").alias("detail")).distinct())
    return out


def repeated_pages(pages: DataFrame) -> DataFrame:
    """H4: pages that a document has twice."""
    return pages.groupBy("doc_id", "page_no").agg(F.count("*").alias("times")).filter("times > 1")


def place_beside_visuals(blocks: DataFrame, visuals: DataFrame, targets: DataFrame) -> DataFrame:
    """H8: native blocks in the bands between a healthy page's visuals, numbered anew.

    A block goes behind the visuals that precede all boxes it is paired with (targets:
    doc_id, page_no, block_seq, reading_order); a block without a pair goes behind the visuals
    that end above its middle. visuals: visual_idx, reading_order, t, b.
    """
    key = ["doc_id", "page_no"]
    first = targets.groupBy(*key, "block_seq").agg(F.min("reading_order").alias("first_target"))
    paired = blocks.join(first, [*key, "block_seq"], "left")
    ranked = visuals.withColumn("visual_rank", F.row_number().over(Window.partitionBy(*key).orderBy("reading_order", "visual_idx")) - 1)
    same = (F.col("n.doc_id") == F.col("v.doc_id")) & (F.col("n.page_no") == F.col("v.page_no"))
    behind = F.when(F.col("n.first_target").isNotNull(), F.col("n.first_target") > F.col("v.reading_order")).otherwise((F.col("n.t") + F.col("n.b")) / 2 >= F.col("v.b"))
    bands = paired.alias("n").join(ranked.alias("v"), same, "left").groupBy("n.doc_id", "n.page_no", "n.block_seq", "n.text").agg(F.count_if(behind).alias("band"))
    rows = bands.select(*key, "band", F.lit(0).alias("is_visual"), F.col("block_seq").alias("seq"), F.lit("Text").alias("kind"))
    rows = rows.unionByName(ranked.select(*key, F.col("visual_rank").cast("long").alias("band"), F.lit(1).alias("is_visual"), F.col("visual_idx").alias("seq"), F.lit("Visual").alias("kind")))
    order = Window.partitionBy(*key).orderBy("band", "is_visual", "seq")
    return rows.withColumn("order", F.row_number().over(order) - 1).drop("is_visual")


def normalize_elements(elements: DataFrame) -> DataFrame:
    """B6 over elements with text and geometry; textless ones pass through."""
    return normalize_blocks(elements)


def segment_members(elements: DataFrame, hints: list[str] | None = None) -> DataFrame:
    """Adds is_heading, seg_no and fallback_page to the elements that no margin excludes.

    elements: doc_id, page_no, order, kind, norm_text, text, origin, exclusion, ratio,
    word_count, obs_seq. A heading box always begins a segment, other text by hint, and by
    type only where no layout box backs it.
    """
    key, first = hint_keys(F.col("norm_text"), F.col("text"))
    live = elements.filter("exclusion is null").withColumns({"__key": key, "__first": first})
    by_hint = hinted(F.col("norm_text"), F.col("text"), hints or [], (F.col("__key"), F.col("__first")))
    typographic = F.col("obs_seq").isNull() & native_heading(F.col("norm_text"), F.col("word_count"), F.col("ratio"))
    plain = (F.col("kind") == "Text") & F.col("norm_text").isNotNull() & (by_hint | typographic)
    marked = live.withColumn("is_heading", F.coalesce((F.col("kind") == "Heading") | plain, F.lit(False)))
    return numbered_segments(marked.drop("__key", "__first"), ["page_no", "order"])


def segments_of_members(members: DataFrame) -> DataFrame:
    """Segments of numbered elements, with what their members say.

    Elements without text join the segment they are in; a page's textless part before any
    heading goes if the page has no text by then.
    """
    named = members.withColumn("has_text", F.col("norm_text").isNotNull() & (F.col("norm_text") != ""))
    held = F.array_sort(F.collect_list(F.when(F.col("has_text"), F.struct("page_no", "order", "norm_text"))))
    out = named.groupBy("doc_id", "seg_no", "fallback_page").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("members"), F.bool_or("has_text").alias("any_text"),
        F.array_join(F.transform(held, lambda x: x["norm_text"]), "\n\n").alias("text"), F.max(F.when(F.col("is_heading"), F.col("norm_text"))).alias("heading_text"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("origin") != "None", F.col("origin")))), ",").alias("origins"),
        F.count_if(F.col("kind") == "Visual").alias("visual_members"), F.bool_or(F.col("kind").isin("UnresolvedText", "Deferred")).alias("has_unresolved"),
    )
    out = out.filter("any_text or seg_no > 0")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_no", "fallback_page")) - 1
    out = out.withColumns({"ordinal": ordinal, "mixed": F.col("origins").contains(",")})
    return out.withColumn("segment_id", F.format_string("p%06d-s%06d", "first_page", "ordinal"))


def hybrid_segments(elements: DataFrame, hints: list[str] | None = None) -> DataFrame:
    """Segments over elements of all kinds."""
    return segments_of_members(segment_members(elements, hints))
