"""Visual evidence (ids G1-G14) and execution by disposition (H9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the association and classification rules.
STRONG_DISTANCE, POSSIBLE_DISTANCE, STRONG_OVERLAP = 0.025, 0.060, 0.45
LEAST_HEIGHT_RATIO, MOST_HEIGHT_RATIO = 0.35, 3.50
FULL_TOLERANCE, CONTAINED_SHARE = 0.003, 0.75
PARAGRAPH_WORDS, PARAGRAPH_CHARS, RICH_SHARE = 12, 80, 0.08
CAPTION_GAP, STRONG_CAPTION_GAP, POSSIBLE_CAPTION_GAP = 0.08, 0.06, 0.025
LEXICAL_TOLERANCE = 0.03
LAYOUT_CAPTION_OVERLAP, LAYOUT_CAPTION_GAP, INDEPENDENT_AREA = 0.40, 0.08, 0.25
BLOCK_CAPTION = {"overlap": 0.10, "tolerance": 0.02, "strong_overlap": 0.15, "possible_overlap": 0.50, "least_words": 2, "most_words": 50, "most_chars": 320}
LOW_INTERACTION = ("NoForegroundWordIntersection", "LowForegroundWordInteraction", "BlankCanvas")
LEAD_WORDS = ("figure", "fig", "table", "plate", "exhibit")
HINTS = ("figure ", "fig. ", "fig ", "table ", "plate ", "exhibit ")


def axis_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.when(a1 < b0, b0 - a1).when(b1 < a0, a0 - b1).otherwise(F.lit(0.0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter one's."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / shorter)


def _c(side: str, *names: str) -> list[Column]:
    return [F.col(f"{side}.{n}") for n in names]


def structural_blocks(blocks: DataFrame) -> DataFrame:
    """G1: blocks that no margin excludes and that aren't blank, with word and character counts."""
    out = blocks.filter("exclusion is null and norm_text <> ''")
    count = F.size(F.filter(F.split("norm_text", " "), lambda w: w != ""))
    return out.withColumns({"words": count.cast("long"), "chars": F.length("norm_text").cast("long")})


def _heading(out: DataFrame) -> DataFrame:
    """G2 from the nearest heading (distance, block_seq, ht, hb): how strong the tie is."""
    near = lambda k: F.col(f"heading.{k}")
    height = near("hb") - near("ht")
    ratio = F.when(height > 0, (F.col("b") - F.col("t")) / height)
    side = overlap_ratio(F.col("t"), F.col("b"), near("ht"), near("hb")) >= STRONG_OVERLAP
    strong = (near("distance") <= STRONG_DISTANCE) & side & ratio.between(LEAST_HEIGHT_RATIO, MOST_HEIGHT_RATIO) & F.col("interaction").isin(*LOW_INTERACTION)
    kind = F.when(F.coalesce(strong, F.lit(False)), "StrongAdjacentVisual").when(near("distance") <= POSSIBLE_DISTANCE, "PossibleAdjacentVisual")
    return out.withColumn("heading_evidence", kind.otherwise("NoStrongAssociation"))


def _heading_parts() -> dict[str, Column]:
    """The nearest heading of the page; ties by block."""
    dx = axis_gap(*_c("v", "l", "r"), *_c("x", "l", "r"))
    dy = axis_gap(*_c("v", "t", "b"), *_c("x", "t", "b"))
    near = F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), F.col("x.block_seq").alias("seq"), F.col("x.t").alias("ht"), F.col("x.b").alias("hb"))
    return {"heading": F.min(F.when(F.col("x.is_heading"), near))}


def _containment_parts() -> dict[str, Column]:
    """Blocks and words inside the visual, and the words of its page."""
    l, t, r, b = _c("v", "l", "t", "r", "b")
    bl, bt, br, bb = _c("x", "l", "t", "r", "b")
    cx, cy = (bl + br) / 2, (bt + bb) / 2
    centre = (cx >= l) & (cx <= r) & (cy >= t) & (cy <= b)
    full = (bl >= l - FULL_TOLERANCE) & (br <= r + FULL_TOLERANCE) & (bt >= t - FULL_TOLERANCE) & (bb <= b + FULL_TOLERANCE)
    area = (br - bl) * (bb - bt)
    shared = F.greatest(F.lit(0.0), F.least(r, br) - F.greatest(l, bl)) * F.greatest(F.lit(0.0), F.least(b, bb) - F.greatest(t, bt))
    inside = F.coalesce(centre | full | F.coalesce(F.when(area > 0, shared / area) >= CONTAINED_SHARE, F.lit(False)), F.lit(False))
    title, words = F.col("x.is_heading"), F.col("x.words")
    long_body = inside & ~title & ((words >= PARAGRAPH_WORDS) | (F.col("x.chars") >= PARAGRAPH_CHARS))
    return {
        "headings": F.count_if(inside & title), "bodies": F.count_if(inside & ~title), "paragraphs": F.count_if(long_body), "page_words": F.sum(words),
        "inside_words": F.sum(F.when(inside, words).otherwise(0)), "heading_words": F.sum(F.when(inside & title, words).otherwise(0)), "body_words": F.sum(F.when(inside & ~title, words).otherwise(0)),
    }


def _containment(out: DataFrame) -> DataFrame:
    """What native text lies inside each visual."""
    dominated = (F.col("headings") > 0) & (F.col("body_words") <= F.greatest(F.lit(3), F.expr("heading_words div 2")))
    share = F.when(F.col("page_words") > 0, F.col("inside_words") / F.col("page_words"))
    rich = (F.col("bodies") >= 2) | (F.col("paragraphs") >= 1) | (share >= RICH_SHARE)
    kind = F.when(F.coalesce(F.col("inside_words"), F.lit(0)) == 0, "NoContainedNativeText").when(dominated, "HeadingDominatedContainedText")
    return out.withColumn("containment_evidence", kind.when(rich, "TextRichContainer").otherwise("SparseContainedText"))


def _vertical(t: Column, b: Column, xt: Column, xb: Column) -> tuple[Column, Column]:
    below, above = xt >= b, xb <= t
    return below | above, F.when(below, xt - b).when(above, t - xb)


def _caption_parts() -> dict[str, Column]:
    """Of the blocks that could be a caption, the one with a hint, the least gap, the greatest overlap, the first."""
    apart, gap = _vertical(*_c("v", "t", "b"), *_c("x", "t", "b"))
    overlap = overlap_ratio(*_c("v", "l", "r"), *_c("x", "l", "r"))
    middle = (F.col("x.l") + F.col("x.r")) / 2
    aligned = (middle >= F.col("v.l") - BLOCK_CAPTION["tolerance"]) & (middle <= F.col("v.r") + BLOCK_CAPTION["tolerance"])
    start = F.lower(F.ltrim("x.norm_text"))
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | F.startswith(start, F.lit(h))
    fits = ~F.col("x.is_heading") & apart & (gap <= CAPTION_GAP) & ((overlap >= BLOCK_CAPTION["overlap"]) | aligned | hint)
    order = [(~hint).alias("plain"), gap.alias("gap"), (-overlap).alias("apart"), F.col("x.block_seq").alias("seq")]
    facts = [hint.alias("hint"), overlap.alias("overlap"), aligned.alias("aligned"), F.col("x.words").alias("words"), F.col("x.chars").alias("chars")]
    return {"caption": F.min(F.when(fits, F.struct(*order, *facts)))}


def _caption(out: DataFrame) -> DataFrame:
    """A lead word above or below decides if there is one, else the best block that could be a caption."""
    best = lambda k: F.col(f"caption.{k}")
    short = best("words").between(BLOCK_CAPTION["least_words"], BLOCK_CAPTION["most_words"]) & (best("chars") <= BLOCK_CAPTION["most_chars"])
    strong = best("hint") & short & (best("gap") <= STRONG_CAPTION_GAP) & ((best("overlap") >= BLOCK_CAPTION["strong_overlap"]) | best("aligned"))
    possible = short & (best("gap") <= POSSIBLE_CAPTION_GAP) & (best("overlap") >= BLOCK_CAPTION["possible_overlap"])
    by_block = F.when(F.col("caption").isNull(), "NoAssociation").when(strong, "StrongAssociation").when(possible, "PossibleAssociation").otherwise("NoStrongAssociation")
    by_word = F.when(F.col("lead_gap") <= STRONG_CAPTION_GAP, "StrongAssociation").when(F.col("lead_gap").isNotNull(), "PossibleAssociation")
    return out.withColumn("caption_evidence", F.coalesce(by_word, by_block))


def lead_words(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, wl, t, wr, b) of the words of blocks (an array) that begin a caption.

    One look at a block's text leaves nearly all blocks out before any word is a row.
    """
    clean = lambda w: F.lower(F.regexp_replace(F.trim(w["word"]), "[:.]+$", ""))
    some = blocks.filter(F.lower("text").rlike("|".join(LEAD_WORDS)))
    found = some.select("doc_id", "page_no", F.explode(F.filter("words", lambda w: clean(w).isin(*LEAD_WORDS))).alias("w"))
    return found.select("doc_id", "page_no", "w.wl", "w.t", "w.wr", "w.b")


def enrich(visuals: DataFrame, blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Adds heading_evidence, containment_evidence and caption_evidence; a visual that isn't measured has none.

    blocks: of G1, with headings marked. words: blocks with an array of their words. Each
    visual meets the blocks of its page once, in one grouped pass for all three.
    """
    key = ["doc_id", "page_no", "visual_idx"]
    measured = visuals.filter("fg_state = 'Measured'")
    same = lambda s: (F.col("v.doc_id") == F.col(f"{s}.doc_id")) & (F.col("v.page_no") == F.col(f"{s}.page_no"))
    of_visual = [F.col(f"v.{k}") for k in key]
    parts = _heading_parts() | _containment_parts() | _caption_parts()
    box = ["l", "t", "r", "b", "interaction"]
    met = measured.alias("v").join(blocks.alias("x"), same("x"), "left").groupBy(*of_visual, *(F.col(f"v.{c}") for c in box)).agg(*(c.alias(n) for n, c in parts.items()))
    apart, gap = _vertical(*_c("v", "t", "b"), *_c("w", "t", "b"))
    centre = (F.col("w.wl") + F.col("w.wr")) / 2
    aligned = (centre >= F.col("v.l") - LEXICAL_TOLERANCE) & (centre <= F.col("v.r") + LEXICAL_TOLERANCE)
    lexical = measured.alias("v").join(lead_words(words).alias("w"), same("w") & apart & aligned & (gap <= CAPTION_GAP))
    met = met.join(lexical.groupBy(*of_visual).agg(F.min(gap).alias("lead_gap")), key, "left")
    names = ["heading_evidence", "containment_evidence", "caption_evidence"]
    found = _caption(_containment(_heading(met))).select(*key, *names)
    return visuals.join(found, key, "left").fillna(dict.fromkeys(names, "NotMeasured"))


def classify_source_visual() -> Column:
    """Over fg_state, fg_ratio, words_touched, components, area, interaction and the three kinds of evidence."""
    touched, fg = F.col("words_touched"), F.col("fg_ratio")
    small = (F.col("heading_evidence") == "StrongAdjacentVisual") & (fg <= 0.005) & (touched <= 0.01) & (F.col("area").isNull() | (F.col("area") <= 0.02))
    tiny = (fg <= 0.005) & (F.col("components").isNull() | (F.col("components") <= 2)) & (touched <= 0.02)
    large = (fg >= 0.05) & (F.col("interaction") == "NoForegroundWordIntersection") & (F.col("heading_evidence") != "StrongAdjacentVisual")
    return (
        F.when(F.col("fg_state") == "BlankCanvas", "BlankCanvas").when(F.col("fg_state") != "Measured", "Unknown").when(F.col("caption_evidence") == "StrongAssociation", "CaptionedMeaningfulVisual")
        .when(small, "SmallHeadingAssociatedVisual").when(tiny, "TinyOrNoise").when(F.col("containment_evidence") == "HeadingDominatedContainedText", "HeadingBackplateOrPresentation")
        .when(F.col("containment_evidence") == "TextRichContainer", "NativeTextContainerOrFrame").when(large, "LargeIndependentVisual").otherwise("Unknown")
    )


def layout_figures(layout: DataFrame) -> DataFrame:
    """Figures of a layout by their captions, or by size and independence."""
    figures, captions = layout.filter("kind = 'Figure'"), layout.filter("kind = 'Caption'")
    key = ["doc_id", "page_no", "obs_seq"]
    page = lambda s: (F.col("f.doc_id") == F.col(f"{s}.doc_id")) & (F.col("f.page_no") == F.col(f"{s}.page_no"))
    _, gap = _vertical(*_c("f", "t", "b"), *_c("c", "t", "b"))
    place = lambda s: F.coalesce(F.col(f"{s}.reading_order"), F.col(f"{s}.obs_seq"))
    strong = (place("f") < place("c")) & (overlap_ratio(*_c("f", "l", "r"), *_c("c", "l", "r")) >= LAYOUT_CAPTION_OVERLAP) & (F.coalesce(gap, F.lit(0.0)) <= LAYOUT_CAPTION_GAP)
    counted = figures.alias("f").join(captions.alias("c"), page("c")).groupBy(*(f"f.{k}" for k in key)).agg(F.count("*").alias("captions"), F.count_if(strong).alias("strong"))
    meets = (F.col("f.l") < F.col("x.r")) & (F.col("x.l") < F.col("f.r")) & (F.col("f.t") < F.col("x.b")) & (F.col("x.t") < F.col("f.b"))
    touched = figures.alias("f").join(layout.filter("kind in ('Text', 'Heading', 'Table')").alias("x"), page("x") & meets, "left_semi").select(*key, F.lit(True).alias("touched"))
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    visible = F.greatest(F.lit(0.0), clamp("r") - clamp("l")) * F.greatest(F.lit(0.0), clamp("b") - clamp("t"))
    out = figures.join(counted, key, "left").join(touched, key, "left").fillna({"captions": 0, "strong": 0, "touched": False})
    kind = F.when(F.lower("raw_label") == "formula", "Unknown").when(F.col("strong") == 1, "CaptionedMeaningfulVisual").when(F.col("captions") > 0, "Unknown").when((visible >= INDEPENDENT_AREA) & ~F.col("touched"), "LargeIndependentVisual").otherwise("Unknown")
    return out.select(*key, "raw_label", kind.alias("kind"), F.col("captions"), F.col("strong"))


def classify_structured_visual() -> Column:
    """Over the nine facts of a packaged image."""
    shown = F.col("is_cover") | F.col("is_nav") | F.col("is_presentation") | F.col("is_preliminary") | F.col("is_repeated") | F.col("is_terminal")
    return F.when(shown, "PublicationPresentationVisual").when(F.col("is_figure") | F.col("has_body_boundary"), "StructuredContentMeaningfulVisual").otherwise("Unknown")


def qualify_by_layout(visuals: DataFrame, layout: DataFrame) -> DataFrame:
    """Unresolved images of a readable type are meaningful if their layout has a figure or table."""
    seen = layout.filter("kind in ('Figure', 'Table')").select("resource").distinct().withColumn("seen", F.lit(True))
    readable = F.col("media_type").isin("image/jpeg", "image/png", "image/gif", "image/bmp") & (F.col("kind") == "Unknown")
    out = visuals.join(seen, "resource", "left")
    return out.withColumn("kind", F.when(readable & F.coalesce("seen", F.lit(False)), "StructuredContentMeaningfulVisual").otherwise(F.col("kind"))).drop("seen")


def insert_source_figures(layout: DataFrame, visuals: DataFrame) -> DataFrame:
    """One synthetic figure for each planned source visual, placed among the boxes beside it in its column.

    A visual goes behind the last box above it and before the first box below it, of those
    that overlap it horizontally; with neither, or with bounds that contradict each other,
    or on a page with a box without order, the page stays as it is. Unqualified visuals go
    to the end. The order is numbered anew.
    """
    page = ["doc_id", "page_no"]
    open_pages = layout.groupBy(*page).agg(F.bool_or(F.col("reading_order").isNull()).alias("loose")).filter("not loose").select(*page)
    ranked = layout.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy("reading_order", "obs_seq")) - 1)
    wanted = visuals.join(open_pages, page, "left_semi")
    same = (F.col("v.doc_id") == F.col("o.doc_id")) & (F.col("v.page_no") == F.col("o.page_no"))
    beside = (F.col("v.l") < F.col("o.r")) & (F.col("o.l") < F.col("v.r"))
    around = wanted.alias("v").join(ranked.alias("o"), same & beside, "left").groupBy("v.doc_id", "v.page_no", "v.visual_idx", "v.qualified", "v.l", "v.t", "v.r", "v.b").agg(
        F.max(F.when(F.col("o.b") <= F.col("v.t"), F.col("o.rank") + 1)).alias("after"), F.min(F.when(F.col("o.t") >= F.col("v.b"), F.col("o.rank"))).alias("before")
    )
    place = F.when(~F.col("qualified"), F.lit(1 << 30)).when(F.col("after").isNotNull() & F.col("before").isNotNull() & (F.col("after") > F.col("before")), None).otherwise(F.coalesce("after", "before"))
    placed = around.withColumn("rank", place)
    stuck = placed.groupBy(*page).agg(F.bool_or(F.col("rank").isNull()).alias("stuck")).filter("stuck").select(*page)
    figures = placed.join(stuck, page, "left_anti").select(*page, "rank", F.lit(0).alias("side"), F.col("visual_idx").alias("seq"), F.lit("Figure").alias("kind"), F.lit("source_visual").alias("raw_label"), "l", "t", "r", "b")
    boxes = ranked.select(*page, "rank", F.lit(1).alias("side"), F.col("obs_seq").alias("seq"), "kind", "raw_label", "l", "t", "r", "b")
    order = Window.partitionBy(*page).orderBy("rank", "side", "seq")
    return boxes.unionByName(figures).withColumn("reading_order", F.row_number().over(order) - 1).drop("rank", "side")


def resolve_source_kind(visuals: DataFrame, layout: DataFrame) -> DataFrame:
    """Preserved visuals as they are; analysed ones by a cover page's title or an overlapping table or formula."""
    page = (F.col("v.doc_id") == F.col("o.doc_id")) & (F.col("v.page_no") == F.col("o.page_no"))
    key = ["doc_id", "page_no", "visual_idx"]
    titled = layout.filter("lower(raw_label) = 'doc_title'").select("doc_id", "page_no").distinct().withColumn("titled", F.lit(True))
    shared = F.greatest(F.lit(0.0), F.least(F.col("v.r"), F.col("o.r")) - F.greatest(F.col("v.l"), F.col("o.l"))) * F.greatest(F.lit(0.0), F.least(F.col("v.b"), F.col("o.b")) - F.greatest(F.col("v.t"), F.col("o.t")))
    area = lambda s: (F.col(f"{s}.r") - F.col(f"{s}.l")) * (F.col(f"{s}.b") - F.col(f"{s}.t"))
    strong = F.coalesce(shared / F.when(F.least(area("v"), area("o")) > 0, F.least(area("v"), area("o"))) >= 0.5, F.lit(False))
    found = visuals.alias("v").join(layout.filter("kind = 'Table' or lower(raw_label) = 'formula'").alias("o"), page & strong, "left_semi").select(*key, F.lit(True).alias("strong"))
    out = visuals.join(titled, ["doc_id", "page_no"], "left").join(found, key, "left").fillna({"titled": False, "strong": False})
    whole = (F.col("l") <= 0.01) & (F.col("t") <= 0.01) & (F.col("r") >= 0.99) & (F.col("b") >= 0.99)
    kind = (
        F.when(F.col("action") == "PreserveMeaningfulVisual", "SourceBackedMeaningfulVisual").when(F.col("action") == "PreserveUnqualifiedVisual", "SourceBackedUnqualifiedVisual")
        .when((F.col("page_no") == 1) & whole & F.col("titled"), "PublicationPresentationVisual").when(F.col("strong"), "SourceBackedMeaningfulVisual").otherwise("SourceBackedUnqualifiedVisual")
    )
    return out.withColumn("resolved_kind", kind).drop("titled", "strong")


def uncovered_figures(layout: DataFrame, visuals: DataFrame, share: float = 0.5) -> DataFrame:
    """Layout figures that no source visual covers by more than the share of their area."""
    page = (F.col("o.doc_id") == F.col("v.doc_id")) & (F.col("o.page_no") == F.col("v.page_no"))
    shared = F.greatest(F.lit(0.0), F.least(F.col("v.r"), F.col("o.r")) - F.greatest(F.col("v.l"), F.col("o.l"))) * F.greatest(F.lit(0.0), F.least(F.col("v.b"), F.col("o.b")) - F.greatest(F.col("v.t"), F.col("o.t")))
    area = (F.col("o.r") - F.col("o.l")) * (F.col("o.b") - F.col("o.t"))
    return layout.filter("kind = 'Figure'").alias("o").join(visuals.alias("v"), page & (shared > share * area), "left_anti")


def singleton_figures(figures: DataFrame, visuals: DataFrame) -> DataFrame:
    """Pages where one unresolved layout figure stands for one planned visual."""
    f = figures.groupBy("doc_id", "page_no").agg(F.count("*").alias("figures"), F.min("obs_seq").alias("obs_seq"))
    v = visuals.groupBy("doc_id", "page_no").agg(F.count("*").alias("visuals"), F.min("visual_idx").alias("visual_idx"))
    return f.join(v, ["doc_id", "page_no"]).filter("figures = 1 and visuals = 1").select("doc_id", "page_no", "obs_seq", "visual_idx")


def execute_visuals(visuals: DataFrame) -> DataFrame:
    """H9: presentation goes, unexplained ones are deferred, the others become visual elements."""
    kept = visuals.filter("disposition <> 'PresentationOnly'")
    return kept.withColumn("element_kind", F.when(F.col("disposition") == "RequiresVisualAnalysis", "Deferred").otherwise("Visual"))
