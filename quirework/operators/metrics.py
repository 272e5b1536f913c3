"""Diagnostics of extraction, reading order, typography and segmentation (ids O1-O18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.segment import CHAPTER, MOST_HEADING_CHARS, MOST_WORDS, SECTION, SUBSECTION, hint_keys, hinted, native_heading, sentence_like
from quirework.operators.text import upper_invariant

WIDE, MIDDLE = 0.55, 0.5
SMALL, LARGE, VERY_LARGE = 120, 4000, 12000
LOOSE_LETTERS, STRONG_RATIO = 3, 0.95
STRONG_HEADING = r"(?i)^(?:CHAPTER|PART|SECTION|BOOK)\b"


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """O1: pages first..last; an empty or reversed range is an error."""
    if first < 1 or last < first:
        raise ValueError(f"pages {first}..{last}")
    return pages.filter(F.col("page_no").between(first, last))


def extraction_metrics(pages: DataFrame) -> DataFrame:
    """O2."""
    text = F.col("word_count") > 0
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("word_count").cast("long").alias("words"), F.sum("block_count").cast("long").alias("blocks"), F.count_if(text).alias("pages_with_words"),
        F.count_if(~text).alias("pages_without_words"), F.bround(F.lit(100.0) * F.count_if(text) / F.count("*"), 1).alias("coverage"),
    )


def normalization_metrics(blocks: DataFrame) -> DataFrame:
    """O3."""
    out = F.col("exclusion")
    return blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(out.isNull()).alias("included"), F.count_if(out == "RepeatedHeader").alias("headers"), F.count_if(out == "RepeatedFooter").alias("footers")
    )


def column_class(left: Column, right: Column) -> Column:
    """W (wide), L or R."""
    return F.when(right - left >= WIDE, "W").when((left + right) / 2 < MIDDLE, "L").otherwise("R")


def column_flow(blocks: DataFrame, page_height: float) -> DataFrame:
    """Switches between columns, vertical reversals inside them, and the flags of multi-column pages."""
    placed = blocks.withColumn("column", column_class(F.col("l"), F.col("r"))).filter("column <> 'W'")
    page = Window.partitionBy("doc_id", "page_no").orderBy("block_seq")
    column = Window.partitionBy("doc_id", "page_no", "column").orderBy("block_seq")
    slack = max(2 / page_height, 0.03)
    marked = placed.withColumns({"switch": F.lag("column").over(page) != F.col("column"), "reversal": F.col("t") < F.lag("t").over(column) - slack})
    out = marked.groupBy("doc_id", "page_no").agg(
        F.count_if(F.col("column") == "L").alias("left_blocks"), F.count_if(F.col("column") == "R").alias("right_blocks"), F.count_if("switch").alias("switches"), F.count_if("reversal").alias("reversals")
    )
    return out.withColumns({"candidate": (F.col("left_blocks") >= 2) & (F.col("right_blocks") >= 2), "interleaved": F.col("switches") > 1, "reversed": F.col("reversals") > 0})


def probe(blocks: DataFrame, needle: str) -> DataFrame:
    """Pages whose word stream, and blocks whose text, contain the needle in any case."""
    wanted = needle.lower()
    held = F.array_sort(F.collect_list(F.struct("block_seq", "text")))
    pages = blocks.groupBy("doc_id", "page_no").agg(F.lower(F.array_join(F.transform(held, lambda x: x["text"]), " ")).alias("stream"), F.count_if(F.lower("text").contains(wanted)).alias("blocks_found"))
    return pages.filter(F.col("stream").contains(wanted)).select("doc_id", "page_no", "blocks_found")


def segment_metrics(segments: DataFrame) -> DataFrame:
    """Over all segments of each document."""
    size = F.length("text")
    return segments.groupBy("doc_id").agg(
        F.count("*").alias("segments"), F.count_if(F.col("last_page") > F.col("first_page")).alias("cross_page"), F.min(size).cast("long").alias("min_chars"),
        F.median(size).alias("median_chars"), F.bround(F.avg(size), 3).alias("avg_chars"), F.max(size).cast("long").alias("max_chars"), F.max("block_count").alias("max_blocks"),
        F.count_if(size <= SMALL).alias("small"), F.count_if(size >= LARGE).alias("large"), F.count_if(size >= VERY_LARGE).alias("very_large"),
    )


def outliers(segments: DataFrame, k: int = 10) -> DataFrame:
    """The k smallest and the k largest segments; ties by document and ordinal."""
    size = F.length("text").cast("long")
    chosen = segments.select("doc_id", "ordinal", size.alias("chars"))
    small = chosen.orderBy("chars", "doc_id", "ordinal").limit(k).withColumn("side", F.lit("smallest"))
    return small.unionByName(chosen.orderBy(F.desc("chars"), "doc_id", "ordinal").limit(k).withColumn("side", F.lit("largest")))


def ratio_band(ratio: Column) -> Column:
    """O11."""
    return F.when(ratio.isNull(), "unknown").when(ratio < SUBSECTION, "body").when(ratio < SECTION, "1.18-1.30").when(ratio < CHAPTER, "1.30-1.55").otherwise("1.55+")


def candidate_kind(ratio: Column) -> Column:
    """Null below the least heading ratio."""
    return F.when(ratio >= CHAPTER, "Chapter").when(ratio >= SECTION, "Section").when(ratio >= SUBSECTION, "Subsection")


def size_distribution(blocks: DataFrame) -> DataFrame:
    """Blocks and words by point size."""
    return blocks.groupBy(F.round("median_pt", 3).alias("size")).agg(F.count("*").alias("blocks"), F.sum("word_count").cast("long").alias("words"))


def top_fonts(blocks: DataFrame, k: int = 5) -> DataFrame:
    """Fonts by letters; ties by name."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return blocks.groupBy("font").agg(F.sum(letters).cast("long").alias("letters")).orderBy(F.desc("letters"), "font").limit(k)


def heading_context(blocks: DataFrame) -> DataFrame:
    """Each heading with the blocks before and after it."""
    flow = Window.partitionBy("doc_id").orderBy("page_no", "block_seq")
    around = blocks.withColumns({"previous_words": F.lag("word_count").over(flow), "next_words": F.lead("word_count").over(flow), "previous_heading": F.coalesce(F.lag("is_heading").over(flow), F.lit(False))})
    return around.filter("is_heading").select("doc_id", "page_no", "block_seq", "norm_text", "previous_words", "next_words", "previous_heading")


def repeated_headings(headings: DataFrame) -> DataFrame:
    """Headings that a document repeats."""
    return headings.groupBy("doc_id", upper_invariant(F.col("norm_text")).alias("key")).agg(F.count("*").alias("times"), F.min("page_no").cast("long").alias("first_page")).filter("times > 1")


def acceptable_heading(text: Column) -> Column:
    """The looser text gate of the counterfactual policies: three letters, half of the signs letters or digits."""
    solid = F.length(F.regexp_replace(text, r"[\t\n\x0B\f\r\x85\p{Z}]", ""))
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    sized = (F.length(text) >= 1) & (F.length(text) <= MOST_HEADING_CHARS)
    return sized & ~text.rlike("[\\ufffd\\p{Cc}]") & (letters >= LOOSE_LETTERS) & (2 * alnum >= solid)


def typography_heading(text: Column, words: Column, ratio: Column) -> Column:
    """Type decides behind the looser gate."""
    big = (ratio >= SUBSECTION) & ~((ratio < SECTION) & sentence_like(text))
    return F.coalesce(acceptable_heading(text) & (words <= MOST_WORDS) & big, F.lit(False))


def strong_heading(text: Column, words: Column, ratio: Column) -> Column:
    """Names a chapter, part, section or book, in type hardly smaller than the body's."""
    return F.coalesce(acceptable_heading(text) & (words <= MOST_WORDS) & text.rlike(STRONG_HEADING) & (ratio.isNull() | (ratio >= STRONG_RATIO)), F.lit(False))


#: What each policy takes for a heading, of typography t, strict typography s, strong wording e and hints h.
POLICIES = {
    "A-ProductionStrictTypographyV4": lambda t, s, e, h: s,
    "B-TypographyOnly": lambda t, s, e, h: t,
    "C-TypographyPlusStrongExplicit": lambda t, s, e, h: t | e,
    "D-TypographyPlusHints": lambda t, s, e, h: t | h,
    "E-StrictTypographyOnly": lambda t, s, e, h: s,
    "F-StrictTypographyPlusHints": lambda t, s, e, h: s | h,
    "G-ProductionStrictTypographyPlusHintsV4": lambda t, s, e, h: s | h,
}
#: What the stricter gate changes, with hints and without.
GATES = (("B-TypographyOnly", "E-StrictTypographyOnly"), ("D-TypographyPlusHints", "F-StrictTypographyPlusHints"))


def policy_choices(blocks: DataFrame, hints: list[str]) -> DataFrame:
    """Blocks (norm_text, text, word_count, ratio) with one boolean a policy, named p0, p1, ..."""
    text, words, ratio = F.col("norm_text"), F.col("word_count"), F.col("ratio")
    facts = {"__t": typography_heading(text, words, ratio), "__s": native_heading(text, words, ratio), "__e": strong_heading(text, words, ratio), "__h": hinted(text, F.col("text"), hints, (F.col("__key"), F.col("__first")))}
    key, first = hint_keys(text, F.col("text"))
    named = blocks.withColumns({"__key": key, "__first": first}).withColumns(facts)
    chosen = [rule(*(F.col(c) for c in facts)).alias(f"p{i}") for i, rule in enumerate(POLICIES.values())]
    return named.select("doc_id", "page_no", "block_seq", F.length("norm_text").alias("chars"), *chosen)


def counterfactual(blocks: DataFrame, hints: list[str]) -> DataFrame:
    """Each document's segments under every policy, and the headings each adds to or takes from policy A.

    One sort of a document's blocks numbers the segments of all policies; only numbers are then
    repeated for the policies, and sums of them cross no further shuffle.
    """
    flow = Window.partitionBy("doc_id").orderBy("page_no", "block_seq").rowsBetween(Window.unboundedPreceding, 0)
    chosen = policy_choices(blocks, hints)
    numbered = chosen.withColumns({f"n{i}": F.sum(F.col(f"p{i}").cast("int")).over(flow) for i in range(len(POLICIES))})
    each = [F.struct(F.lit(name).alias("policy"), F.col(f"p{i}").alias("chosen"), F.col(f"n{i}").alias("seg_no")) for i, name in enumerate(POLICIES)]
    spread = numbered.select("doc_id", "page_no", "chars", F.col("p0").alias("engine"), F.explode(F.array(*each)).alias("x")).select("doc_id", "page_no", "chars", "engine", "x.*")
    fallback = F.when(F.col("seg_no") == 0, F.col("page_no")).otherwise(F.lit(0))
    segments = spread.groupBy("doc_id", "policy", "seg_no", fallback.alias("fallback_page")).agg(
        (F.sum("chars") + 2 * (F.count("*") - 1)).alias("chars"), F.countDistinct("page_no").alias("pages"), F.count_if("chosen").alias("headings"),
        F.count_if(F.col("chosen") & ~F.col("engine")).alias("added"), F.count_if(~F.col("chosen") & F.col("engine")).alias("removed"),
    )
    return segments.groupBy("doc_id", "policy").agg(
        F.count("*").alias("segments"), F.count_if(F.col("headings") > 0).alias("headed"), F.count_if(F.col("headings") == 0).alias("fallback"), F.count_if(F.col("pages") > 1).alias("cross_page"),
        F.count_if(F.col("chars") <= SMALL).alias("small"), F.count_if(F.col("chars") >= LARGE).alias("large"), F.min("chars").alias("min_chars"), F.median("chars").alias("median_chars"),
        (F.sum("chars") / F.count("*")).alias("avg_chars"), F.max("chars").alias("max_chars"), F.sum("added").alias("added"), F.sum("removed").alias("removed"),
    )


def gate_comparisons(blocks: DataFrame, hints: list[str]) -> DataFrame:
    """Headings that the stricter text gate takes away and adds, with hints and without, for each document."""
    chosen, at = policy_choices(blocks, hints), {name: F.col(f"p{i}") for i, name in enumerate(POLICIES)}
    each = [F.struct(F.lit(a).alias("from_policy"), F.lit(b).alias("to_policy"), (at[a] & ~at[b]).alias("gone"), (~at[a] & at[b]).alias("new")) for a, b in GATES]
    spread = chosen.select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.*")
    return spread.groupBy("doc_id", "from_policy", "to_policy").agg(F.count_if("gone").alias("removed"), F.count_if("new").alias("added"))


def heading_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Headings of one set alone, with the side they are on."""
    key = ["doc_id", "page_no", "block_seq"]
    return a.join(b, key, "left_anti").select(*key, F.lit("first").alias("side")).unionByName(b.join(a, key, "left_anti").select(*key, F.lit("second").alias("side")))
