"""Plain-text source: documents as pages of lines, with page geometry on a monospace grid.

A document's lines (split at newlines) fill pages of ``LINES_PER_PAGE``; a line is a block.
The plain text has no boxes, fonts or layout, so evidence for operators that need them is
derived from line numbers by fixed arithmetic, the same in every run: a running head on
every third document, three kinds of block width, point sizes that mark some lines as
headings, and a recognised text that differs from the native one in places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES_PER_PAGE = 8
RECT = "struct<l:double,t:double,r:double,b:double>"


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text); a null text is one empty line. A column composed is split along with the text."""
    if "composed" in docs.columns:  # a newline composes with nothing, so both have as many lines
        none = F.array().cast("array<string>")
        both = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("text"), F.coalesce(F.split("composed", "\n"), none).alias("composed"))
        return both.select("doc_id", F.posexplode(F.arrays_zip("text", "composed")).alias("line_no", "line")).select("doc_id", "line_no", "line.text", "line.composed")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_seq, line_no, text, bounds l t r b, font, median_pt, word_count)."""
    n = F.lit(LINES_PER_PAGE)
    seq = F.col("line_no") % n
    page = (F.floor(F.col("line_no") / n) + 1).cast("int")
    head = (seq == 0) & (F.col("doc_id") % 3 == 0)
    text = F.when(head, F.concat(F.lit("Chapter "), page.cast("string"))).otherwise(F.col("text"))
    left = F.when(F.col("line_no") % 3 == 2, F.lit(0.5)).otherwise(F.lit(0.0625))
    width = F.when(F.col("line_no") % 3 == 0, F.lit(0.875)).otherwise(F.lit(0.375))
    form = [F.when(~head, F.col("composed")).alias("composed")] if "composed" in docs.columns else []
    out = lines(docs).select("doc_id", page.alias("page_no"), seq.alias("block_seq"), "line_no", text.alias("text"), *form, left.alias("l"), (seq / n.cast("double")).alias("t"), (left + width).alias("r"), ((seq + 1) / n.cast("double")).alias("b"))
    size = F.when(F.col("line_no") % 6 == 1, F.lit(13.0)).otherwise(F.lit(10.0) + F.col("line_no") % 2)
    return out.withColumns(
        {
            "font": F.concat(F.lit("Font"), (F.col("line_no") % 4).cast("string")),
            "median_pt": size,
            "word_count": F.coalesce(F.regexp_count("text", F.lit(r"[^ ]+")), F.lit(0)).cast("int"),
        }
    )


def words(blocks_: DataFrame) -> DataFrame:
    """Words of blocks in equal columns of their block's box: (…, word_idx, word, wl, wr)."""
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    out = blocks_.select("doc_id", "page_no", "block_seq", "l", "t", "r", "b", F.size(tokens).alias("n"), F.posexplode(tokens).alias("word_idx", "word"))
    step = (F.col("r") - F.col("l")) / F.col("n")
    return out.withColumns({"wl": F.col("l") + step * F.col("word_idx"), "wr": F.col("l") + step * (F.col("word_idx") + 1)})


def with_words(blocks_: DataFrame) -> DataFrame:
    """Blocks with their words as an array of (word, wl, t, wr, b)."""
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    step = (F.col("r") - F.col("l")) / F.size("__w")
    place = lambda w, i: F.struct(w.alias("word"), (F.col("l") + step * i).alias("wl"), F.col("t").alias("t"), (F.col("l") + step * (i + 1)).alias("wr"), F.col("b").alias("b"))
    return blocks_.withColumn("__w", tokens).withColumn("words", F.transform("__w", place)).drop("__w")


def pages(blocks_: DataFrame) -> DataFrame:
    """(doc_id, page_no, word_count, raster_image_count, largest_raster_ratio): every fifth page an image, textless."""
    bare = (F.col("doc_id") + F.col("page_no")) % 5 == 0
    out = blocks_.groupBy("doc_id", "page_no").agg(F.sum("word_count").cast("long").alias("words"), F.count("*").alias("block_count"))
    return out.select(
        "doc_id", "page_no", F.when(bare, F.lit(0)).otherwise(F.col("words")).cast("long").alias("word_count"), F.when(bare | (F.col("page_no") % 4 == 0), F.lit(1)).otherwise(F.lit(0)).alias("raster_image_count"),
        F.when(bare, F.lit(0.5) + (F.col("doc_id") % 4) * F.lit(0.125)).when(F.col("page_no") % 4 == 0, F.lit(0.25) + (F.col("doc_id") % 3) * F.lit(0.25)).otherwise(F.lit(0.0)).alias("largest_raster_ratio"), "block_count",
    )


def layout(blocks_: DataFrame) -> DataFrame:
    """A layout box a block, every third begins an eighth of a line lower and on some pages ends in the next line; kinds by line number."""
    third = (F.col("doc_id") + F.col("block_seq")) % 3 == 0
    shift = F.when(third, F.lit(0.015625)).otherwise(F.lit(0.0))
    reach = F.when(third & ((F.col("doc_id") + F.col("page_no")) % 9 == 4), F.lit(0.015625)).otherwise(F.lit(0.0))
    labels = F.array(*(F.lit(x) for x in ("text", "paragraph_title", "figure_title", "image", "table", "text", "formula", " Text ", "seal")))
    return blocks_.select(
        "doc_id", "page_no", F.col("block_seq").alias("obs_seq"), F.col("block_seq").alias("reading_order"),
        F.element_at(labels, (F.col("line_no") % 9 + 1).cast("int")).alias("raw_label"), "l", (F.col("t") + shift).alias("t"), "r", (F.col("b") + reach).alias("b"),
    )


def recognised(blocks_: DataFrame) -> DataFrame:
    """Recognised text of each block, in fragments of about half a block: some words differ, some fragments end in a hyphen."""
    first, rest = F.expr("substr(text, 1, int(length(text) / 2))"), F.expr("substr(text, int(length(text) / 2) + 1)")
    pieces = F.array(F.concat(first, F.when(F.col("line_no") % 2 == 0, F.lit("-")).otherwise(F.lit(""))), rest)
    changed = F.when(F.col("line_no") % 4 == 3, F.transform(pieces, lambda x: F.replace(x, F.lit("th"), F.lit("tb")))).otherwise(pieces)
    out = blocks_.select("doc_id", "page_no", F.col("block_seq").alias("obs_seq"), "line_no", F.posexplode(changed).alias("text_seq", "text"))
    return out.withColumn("confidence", F.lit(1.0) - (F.col("line_no") % 8) / F.lit(16.0))


INTERACTIONS = ("NoForegroundWordIntersection", "LowForegroundWordInteraction", "ForegroundWordInteraction", "NoNativeWords")


def visuals(blocks_: DataFrame) -> DataFrame:
    """Two measured visuals on every page, placed on eighths of it."""
    pages_ = blocks_.select("doc_id", "page_no").distinct()
    out = pages_.withColumn("visual_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    d, p, i = F.col("doc_id"), F.col("page_no"), F.col("visual_idx")
    left, top = (d + i) % 3 * F.lit(0.125), (d + p * 2 + i) % 6 * F.lit(0.125)
    right, bottom = left + F.lit(0.25) + (d + p + i) % 3 * F.lit(0.25), top + F.lit(0.125) * (1 + (d + i) % 3)
    kind = (d + p + i) % 7
    return out.select(
        "doc_id", "page_no", "visual_idx", left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"),
        F.when(kind == 0, "BlankCanvas").when(kind == 1, "Unavailable").otherwise("Measured").alias("fg_state"), ((d * 7 + p * 3 + i) % 20 / F.lit(200.0)).alias("fg_ratio"),
        ((d + p) % 4 / F.lit(100.0)).alias("words_touched"), ((d + i) % 4).cast("int").alias("components"), ((right - left) * (bottom - top)).alias("area"),
        F.element_at(F.array(*map(F.lit, INTERACTIONS)), ((d + p * 3 + i) % 4 + 1).cast("int")).alias("interaction"),
    )
