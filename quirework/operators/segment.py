"""Heading inference and segmentation (ids I1-I10, O9-O12, O16-O18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.text import collapse, upper_invariant

# Fixed values of the heading rules.
MOST_HEADING_CHARS, LEAST_LETTERS, LEAST_ALNUM, MOST_WORDS = 180, 4, 0.55, 24
SUBSECTION, SECTION, CHAPTER = 1.18, 1.30, 1.55


def body_font_size(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_pt), the lower median of point sizes weighted by words.

    Sums weights by distinct size first, so the running total has a row a size, not a block.
    """
    sizes = blocks.filter("median_pt > 0 and word_count > 0").groupBy("doc_id", "median_pt").agg(F.sum("word_count").alias("weight"))
    by_size = Window.partitionBy("doc_id").orderBy("median_pt").rowsBetween(Window.unboundedPreceding, 0)
    running = sizes.withColumns({"upto": F.sum("weight").over(by_size), "total": F.sum("weight").over(Window.partitionBy("doc_id"))})
    return running.filter(F.expr("upto >= (total + 1) div 2")).groupBy("doc_id").agg(F.min("median_pt").alias("body_pt"))


def heading_text(text: Column) -> Column:
    """Could the text be a heading at all?"""
    solid = F.length(F.regexp_replace(text, r"[\t\n\x0B\f\r\x85\p{Z}]", ""))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    sized = (F.length(text) >= 1) & (F.length(text) <= MOST_HEADING_CHARS)
    return sized & ~text.rlike("[\\ufffd\\p{Cc}]") & (letters >= LEAST_LETTERS) & (alnum >= LEAST_ALNUM * solid)


def sentence_like(text: Column) -> Column:
    """I3."""
    return text.rlike("[.;,]$")


def font_ratio(size: Column, body: Column) -> Column:
    return F.when((size > 0) & (body > 0), size / body)


def native_heading(text: Column, words: Column, ratio: Column) -> Column:
    """I4: typography decides; a missing ratio doesn't."""
    big = (ratio >= SUBSECTION) & ~((ratio < SECTION) & sentence_like(text))
    return F.coalesce(heading_text(text) & (words <= MOST_WORDS) & big, F.lit(False))


def heading_key(text: Column) -> Column:
    """Collapsed, without other signs at the ends, upper case."""
    return upper_invariant(F.regexp_replace(collapse(text), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))


def compact_key(text: Column) -> Column:
    return upper_invariant(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def clean_hints(hints: list[str]) -> list[str]:
    """Trimmed, with a letter or digit, the first of those that differ in case alone."""
    out: dict[str, str] = {}
    for h in (h.strip() for h in hints):
        if any(c.isalnum() for c in h):
            out.setdefault(h.upper(), h)
    return list(out.values())


def hint_keys(text: Column, source: Column) -> tuple[Column, Column]:
    """What hints are compared with: the heading key, and the compact first line. As columns they are made once a row."""
    return heading_key(text), compact_key(F.regexp_extract(F.regexp_replace(source, "\r\n?", "\n"), r"^\s*([^\n]*)", 1))


def hinted(text: Column, source: Column, hints: list[str], keys: tuple[Column, Column] | None = None) -> Column:
    """Equal keys, a short decoration before the hint, or an equal compact first line. keys: hint_keys, where they are known."""
    hints = clean_hints(hints)
    if not hints:
        return F.lit(False)
    key, first = keys or hint_keys(text, source)
    out = F.lit(False)
    for h in hints:
        wanted, compact = heading_key(F.lit(h)), compact_key(F.lit(h))
        prefix = F.trim(F.substring(key, F.lit(1), F.length(key) - F.length(wanted)))
        decorated = F.endswith(key, wanted) & (F.length(key) > F.length(wanted)) & (F.length(prefix) >= 1) & (F.length(prefix) <= 3) & ~prefix.rlike(r"[\p{L}&&[^\p{Lu}]]")
        out = out | (key == wanted) | decorated | (first == compact)
    return out


def with_headings(blocks: DataFrame, hints: list[str] | None = None) -> DataFrame:
    """Adds body_pt, ratio and is_heading to normalised blocks that no margin excludes and that aren't blank."""
    live = blocks.filter("exclusion is null and norm_text <> ''")
    out = live.join(body_font_size(live), "doc_id", "left").withColumn("ratio", font_ratio(F.col("median_pt"), F.col("body_pt")))
    typographic = native_heading(F.col("norm_text"), F.col("word_count"), F.col("ratio"))
    if not clean_hints(hints or []):
        return out.withColumn("is_heading", typographic)
    key, first = hint_keys(F.col("norm_text"), F.col("text"))
    named = hinted(F.col("norm_text"), F.col("text"), hints, (F.col("__key"), F.col("__first")))
    return out.withColumns({"__key": key, "__first": first}).withColumn("is_heading", typographic | named).drop("__key", "__first")


def numbered_segments(blocks: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds seg_no (headings so far) and fallback_page (the page before the first heading, else 0)."""
    by = by or ["doc_id"]
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("seg_no", F.sum(F.col("is_heading").cast("int")).over(so_far))
    return out.withColumn("fallback_page", F.when(F.col("seg_no") == 0, F.col("page_no")).otherwise(F.lit(0)))


def segments(blocks: DataFrame, hints: list[str] | None = None) -> DataFrame:
    """A row for each segment, ordinals from 0 in document order."""
    numbered = numbered_segments(with_headings(blocks, hints), ["page_no", "block_seq"])
    held = F.array_sort(F.collect_list(F.struct("page_no", "block_seq", "norm_text")))
    out = numbered.groupBy("doc_id", "seg_no", "fallback_page").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("block_count"), held.alias("held"),
        F.max(F.when(F.col("is_heading"), F.col("norm_text"))).alias("heading_text"),
    )
    out = out.withColumn("text", F.array_join(F.transform("held", lambda x: x["norm_text"]), "\n\n"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_no", "fallback_page")) - 1
    out = out.withColumn("ordinal", ordinal)
    return out.select(
        "doc_id", F.col("ordinal").cast("long"), F.format_string("p%06d-s%06d", "first_page", "ordinal").alias("segment_id"), F.col("first_page").cast("long"),
        F.col("last_page").cast("long"), "block_count", "heading_text", "text", F.sha2("text", 256).alias("text_sha256"),
    )
