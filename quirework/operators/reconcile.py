"""Layout interpretation (C1-C5) and reconciliation of native with recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators.text import SPACE, nfkc

LABELS = {
    "text": "Text", "paragraph_title": "Heading", "doc_title": "Heading", "figure_title": "Caption", "figure_caption": "Caption", "image": "Figure", "figure": "Figure",
    "formula": "Figure", "header_image": "Figure", "footer_image": "Figure", "table": "Table",
}
READ_KINDS = ("Text", "Heading", "Caption", "Table")
LAYOUT_JSON = "struct<res:struct<parsing_res_list:array<struct<block_label:string,block_bbox:array<double>>>>,parsing_res_list:array<struct<block_label:string,block_bbox:array<double>>>>"


def layout_kind(label: Column) -> Column:
    """C2."""
    name = F.lower(F.trim(label))
    out = F.lit("Unknown")
    for k, v in LABELS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def parse_layout(pages: DataFrame) -> DataFrame:
    """Pages with layout_json, px_width and px_height to a row a box; order is the place in the list."""
    parsed = pages.withColumn("__json", F.from_json("layout_json", LAYOUT_JSON))
    found = parsed.withColumn("__list", F.coalesce("__json.res.parsing_res_list", "__json.parsing_res_list"))
    out = found.select("doc_id", "page_no", "px_width", "px_height", F.posexplode("__list").alias("obs_seq", "o"))
    box = [F.col("o.block_bbox")[i] / F.col("px_width" if i % 2 == 0 else "px_height") for i in range(4)]
    return out.select(
        "doc_id", "page_no", "obs_seq", F.col("obs_seq").alias("reading_order"), layout_kind(F.col("o.block_label")).alias("kind"), F.col("o.block_label").alias("raw_label"), *(c.alias(n) for c, n in zip(box, "ltrb", strict=True))
    )


def parse_recognition(regions: DataFrame) -> DataFrame:
    """Parallel arrays of texts, scores and boxes to a row a text; blank ones go, unequal lengths are an error row."""
    kind = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_boxes:array<array<double>>>"
    found = regions.withColumn("o", F.from_json("ocr_json", kind))
    zipped = F.arrays_zip(F.col("o.rec_texts").alias("text"), F.col("o.rec_scores").alias("confidence"), F.col("o.rec_boxes").alias("box"))
    even = (F.size("o.rec_texts") == F.size("o.rec_scores")) & (F.size("o.rec_texts") == F.size("o.rec_boxes"))
    out = found.select("doc_id", "page_no", "obs_seq", "crop_l", "crop_t", "px_width", "px_height", even.alias("valid"), F.posexplode(zipped).alias("text_seq", "x"))
    place = {"l": (F.col("crop_l") + F.col("x.box")[0]) / F.col("px_width"), "t": (F.col("crop_t") + F.col("x.box")[1]) / F.col("px_height"), "r": (F.col("crop_l") + F.col("x.box")[2]) / F.col("px_width"), "b": (F.col("crop_t") + F.col("x.box")[3]) / F.col("px_height")}
    out = out.filter(F.trim(F.coalesce("x.text", F.lit(""))) != "")
    return out.select("doc_id", "page_no", "obs_seq", "text_seq", F.col("x.text").alias("text"), F.col("x.confidence").alias("confidence"), *(c.alias(n) for n, c in place.items()), "valid")


def crop(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """A box in pixels, clamped to the page and rounded outwards; an empty one has null sides."""
    inside = {k: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for k, v in box.items()}
    out = {"l": F.floor(inside["l"] * width), "t": F.floor(inside["t"] * height), "r": F.ceil(inside["r"] * width), "b": F.ceil(inside["b"] * height)}
    full = (out["r"] > out["l"]) & (out["b"] > out["t"])
    return {k: F.when(full, v) for k, v in out.items()}


def reading_plan(layout: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes whose text is to be recognised, with their crops."""
    wanted = layout.filter(F.col("kind").isin(*READ_KINDS))
    cut = crop({k: F.col(k) for k in "ltrb"}, F.lit(width), F.lit(height))
    return wanted.select("doc_id", "page_no", "obs_seq", "kind", *(c.alias(f"px_{k}") for k, c in cut.items()))


def box_overlap(a: str, b: str) -> Column:
    """Strict: boxes that share an area."""
    c = lambda s, k: F.col(f"{s}.{k}")
    return (c(a, "l") < c(b, "r")) & (c(b, "l") < c(a, "r")) & (c(a, "t") < c(b, "b")) & (c(b, "t") < c(a, "b"))


def with_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks with an array of their words in order: (word, wl, t, wr, b) from rows of word_idx 0, 1, ..."""
    key = ["doc_id", "page_no", "block_seq"]
    held = F.array_sort(F.collect_list(F.struct("word_idx", "word", "wl", "t", "wr", "b")))
    return blocks.join(words.groupBy(*key).agg(held.alias("words")), key, "left")


def native_extents(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """Of each block and box that overlap, the words from the first to the last that meet the box.

    blocks carry their words as an array (word, wl, t, wr, b), so a word is never a row of its
    own. The equal keys are the page: a page's few boxes meet its few blocks, never the corpus'.
    """
    page = (F.col("n.doc_id") == F.col("o.doc_id")) & (F.col("n.page_no") == F.col("o.page_no"))
    near = blocks.alias("n").join(layout.alias("o"), page & box_overlap("n", "o"))

    def place(w: Column, i: Column) -> Column:
        meets = (w["wl"] < F.col("o.r")) & (F.col("o.l") < w["wr"]) & (w["t"] < F.col("o.b")) & (F.col("o.t") < w["b"])
        return F.when(meets, i)

    met = F.filter(F.transform("n.words", place), lambda i: i.isNotNull())
    # exploded, as a plain column would be worked out again in the filter and in the join's condition
    out = near.select("n.doc_id", "n.page_no", "o.obs_seq", "o.kind", "n.block_seq", "n.words", F.explode(F.array(met)).alias("met")).filter(F.size("met") > 0)
    out = out.withColumns({"first_word": F.array_min("met"), "last_word": F.array_max("met"), "intersecting": F.size("met").cast("long")})
    extent = F.slice("words", F.col("first_word") + 1, F.col("last_word") - F.col("first_word") + 1)
    out = out.withColumn("extent", extent)
    part = lambda c: F.transform("extent", lambda w: w[c])
    bounds = [F.array_min(part("wl")).alias("l"), F.array_min(part("t")).alias("t"), F.array_max(part("wr")).alias("r"), F.array_max(part("b")).alias("b")]
    return out.select("doc_id", "page_no", "obs_seq", "kind", "block_seq", "first_word", "last_word", "intersecting", F.array_join(part("word"), " ").alias("text"), *bounds)


def pairings(layout: DataFrame, extents: DataFrame) -> DataFrame:
    """Of each box to be read, its native text, bounds and status, with the box's kind and reading order.

    A word that more than one box owns makes all of them ambiguous. The boxes of a block are
    compared with each other in one row a block: as many as meet it on its page.
    """
    box = ["doc_id", "page_no", "obs_seq"]
    told = [c for c in ("kind", "reading_order") if c in layout.columns]
    wanted = layout.filter(F.col("kind").isin(*READ_KINDS)).select(*box, *told)
    own = F.collect_list(F.struct("obs_seq", "first_word", "last_word", "text", "l", "t", "r", "b"))
    of_block = extents.filter(F.col("kind").isin(*READ_KINDS)).groupBy("doc_id", "page_no", "block_seq").agg(own.alias("boxes"))

    def shared(x: Column) -> Column:
        def owned(i: Column) -> Column:
            return F.exists("boxes", lambda y: (y["obs_seq"] != x["obs_seq"]) & i.between(y["first_word"], y["last_word"]))

        alone = ~F.exists("boxes", lambda y: (y["obs_seq"] != x["obs_seq"]) & (y["first_word"] <= x["last_word"]) & (x["first_word"] <= y["last_word"]))
        return F.when(alone, F.lit(0)).otherwise(F.size(F.filter(F.sequence(x["first_word"], x["last_word"]), owned)))

    counted = F.transform("boxes", lambda x: F.struct(*(x[c].alias(c) for c in ("obs_seq", "text", "l", "t", "r", "b")), shared(x).alias("shared")))
    each = of_block.select("doc_id", "page_no", "block_seq", F.explode(counted).alias("x")).select("doc_id", "page_no", "block_seq", "x.*")
    held = F.array_sort(F.collect_list(F.struct("block_seq", "text")))
    native = each.groupBy(*box).agg(
        F.array_join(F.transform(held, lambda h: h["text"]), " ").alias("native_text"), F.sum("shared").alias("ambiguous_words"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")
    )
    status = F.when(F.col("native_text").isNull(), "NoNativeEvidence").when(F.col("ambiguous_words") > 0, "AmbiguousWordOwnership").otherwise("Comparable")
    out = wanted.join(native, box, "left")
    return out.select(*box, *told, status.alias("status"), "native_text", F.coalesce("ambiguous_words", F.lit(0)).alias("ambiguous_words"), "l", "t", "r", "b")


def page_outcomes(pairs: DataFrame, statuses: DataFrame) -> DataFrame:
    """H7: (doc_id, page_no, outcome, ambiguous_boxes): a page fails if two of its boxes own one word.

    statuses: doc_id, page_no, page_status. Pages without native text aren't paired and can't fail.
    """
    crossed = pairs.groupBy("doc_id", "page_no").agg(F.count_if(F.col("status") == "AmbiguousWordOwnership").alias("crossed"))
    out = statuses.join(crossed, ["doc_id", "page_no"], "left")
    boxes = F.when(F.col("page_status") != "Missing", F.coalesce("crossed", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "page_no", F.when(boxes > 0, "Failed").otherwise("Completed").alias("outcome"), boxes.alias("ambiguous_boxes"))


def dehyphenate_fragments(fragments: Column, native: bool) -> Column:
    """Fragments in order to struct(text, removals, joins).

    Soft hyphens go. A boundary is joined before a lower-case letter if the fragment ends in
    a soft hyphen (native words) or a hyphen (recognised fragments; this one goes too).
    """
    soft = "­"
    after = F.when(F.size(fragments) > 0, F.concat(F.slice(fragments, F.lit(2), F.greatest(F.size(fragments) - 1, F.lit(0))), F.array(F.lit(""))))
    pairs = F.arrays_zip(fragments.alias("now"), after.alias("next"))

    def step(acc: Column, p: Column) -> Column:
        clean = F.replace(p["now"], F.lit(soft), F.lit(""))
        evidence = F.endswith(p["now"], F.lit(soft)) if native else F.endswith(clean, F.lit("-"))
        joins = evidence & p["next"].rlike(r"^\p{Ll}")
        kept = clean if native else F.when(joins, F.substring(clean, F.lit(1), F.length(clean) - 1)).otherwise(clean)
        gap = F.when(joins, F.lit("")).otherwise(F.lit(" "))
        return F.struct(
            F.concat(acc["text"], acc["gap"], kept).alias("text"), gap.alias("gap"), (acc["removals"] + F.length(p["now"]) - F.length(clean)).alias("removals"), (acc["joins"] + joins.cast("int")).alias("joins")
        )

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("gap"), F.lit(0).alias("removals"), F.lit(0).alias("joins"))
    out = F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<now:string,next:string>>")), start, step)
    return F.struct(out["text"].alias("text"), out["removals"].alias("removals"), out["joins"].alias("joins"))


def ocr_fragments(recognised: DataFrame) -> DataFrame:
    """(doc_id, page_no, obs_seq, fragments): trimmed, not empty, in order."""
    out = recognised.withColumn("text", F.trim("text")).filter("text <> ''")
    held = F.array_sort(F.collect_list(F.struct("text_seq", "text")))
    return out.groupBy("doc_id", "page_no", "obs_seq").agg(F.transform(held, lambda x: x["text"]).alias("fragments"))


def comparable(text: Column) -> Column:
    """What two texts must have in common to be equal; case and punctuation count."""
    return F.trim(F.regexp_replace(F.replace(nfkc(text), F.lit("­"), F.lit("")), SPACE, " "))


def reconcile(pairs: DataFrame) -> DataFrame:
    """(status, native_text, ocr_text) to decision, origin, text and the two flags.

    status: Missing, Healthy, Suspicious or Unverified.
    """
    native, ocr = F.col("native_text"), F.col("ocr_text")
    read = F.coalesce(F.trim(ocr) != "", F.lit(False))
    missing = (F.col("status") == "Missing") | native.isNull()
    same = F.when(~missing & read, comparable(native) == comparable(ocr))
    healthy = F.col("status") == "Healthy"
    decision = (
        F.when(missing & read, "OcrOnly").when(missing, "NoTextRecovered").when(~read & healthy, "NativeOnly").when(~read, "SuspiciousNativeUnverified")
        .when(F.col("equivalent"), "Agreement").when(healthy, "HealthyNativePreferred").otherwise("Conflict")
    )
    out = pairs.withColumn("equivalent", same).withColumn("decision", decision)
    origin = F.when(F.col("decision") == "OcrOnly", "Ocr").when(F.col("decision").isin("NativeOnly", "Agreement", "HealthyNativePreferred"), "Native").otherwise("None")
    out = out.withColumn("origin", origin)
    text = F.when(F.col("origin") == "Ocr", ocr).when(F.col("origin") == "Native", native)
    return out.withColumns({"selected_text": text, "resolved": text.isNotNull(), "divergence": F.col("decision").isin("HealthyNativePreferred", "Conflict")})


def reconciliation_violations(inputs: DataFrame) -> DataFrame:
    """Rows that contradict themselves; has_native, status, page_no, ocr_page_no, and the boxes n and o."""
    rules = [
        ("missing-with-native", (F.col("status") == "Missing") & F.col("has_native")),
        ("present-without-native", (F.col("status") != "Missing") & ~F.col("has_native")),
        ("other-page", F.col("ocr_page_no") != F.col("page_no")),
        ("no-overlap", F.col("has_native") & ~box_overlap("n", "o")),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())
    return inputs.withColumn("rule", F.explode(found))
