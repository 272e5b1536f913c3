"""Evaluation: error rates, outlines, titles, zones, sentinels, box overlap (ids O19-O38, P1-P9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions.measures import ordered_overlap, token_edits, word_edits
from quirework.operators.segment import compact_key, heading_key
from quirework.operators.text import SPACE, collapse_ends, nfc, upper_invariant

NEAR_PAGES, MOST_CLUSTER, BEST_MATCHES, LEXICAL_MATCHES = 2, 3, 5, 3
LEAST_CONTAINED, LEAST_SHARE = 8, 0.20
BANDS = ("ExactEquivalent", "Containment", "HighOverlap", "ModerateOverlap", "WeakOverlap", "None")
#: Fixed values of the character folding: what becomes an apostrophe, a quotation mark, a hyphen.
APOSTROPHES, QUOTES, DASHES = "\u2018\u2019\u02bc", "\u201c\u201d", "\u2010\u2011\u2012\u2013\u2014\u2015"
_BLANK = SPACE.removesuffix("+")


def cer_text(text: Column) -> Column:
    """Composed, line ends, words split by a hyphen joined, soft hyphens gone, signs folded, lower case, collapsed."""
    out = F.regexp_replace(nfc(text), "\r\n?", "\n")
    out = F.regexp_replace(out, rf"(?<=\p{{L}})-{_BLANK}*\n{_BLANK}*(?=\p{{L}})", "")
    # a capital sigma is lowered by itself, whatever stands behind it
    out = F.translate(F.replace(out, F.lit("\u00ad"), F.lit("")), "\u00a0\u03a3" + APOSTROPHES + QUOTES + DASHES, " \u03c3" + "'" * 3 + '"' * 2 + "-" * 6)
    return F.trim(F.regexp_replace(F.lower(out), SPACE, " "))


def share_of(edits: Column, length: Column) -> Column:
    """Edits for each sign of the reference; 0 where it has none."""
    return F.when(length > 0, edits / length).otherwise(F.lit(0.0))


def rate(edits: Column, length: Column) -> Column:
    """To six places."""
    return F.bround(share_of(edits, length), 6)


def error_rates(pairs: DataFrame) -> DataFrame:
    """Adds character and word edits and rates to (reference, recognised)."""
    a, b = cer_text(F.col("reference")), cer_text(F.col("recognised"))
    out = pairs.withColumns({"__a": a, "__b": b})
    tokens = F.regexp_count("__a", F.lit(r"[\p{L}\p{Nd}]+(?:'[\p{L}\p{Nd}]+)*"))
    out = out.withColumns({"char_edits": F.levenshtein("__a", "__b").cast("long"), "chars": F.length("__a").cast("long"), "word_edits": word_edits("__a", "__b"), "words": tokens.cast("long")})
    return out.withColumns({"cer": rate(F.col("char_edits"), F.col("chars")), "wer": rate(F.col("word_edits"), F.col("words"))}).drop("__a", "__b")


def strict_error_rates(pairs: DataFrame) -> DataFrame:
    """Case kept, white space collapsed, words by white space, rates as they are."""
    clean = lambda c: F.trim(F.regexp_replace(nfc(F.col(c)), SPACE, " "))
    out = pairs.withColumns({"__a": clean("reference"), "__b": clean("recognised")})
    words = F.size(F.filter(F.split("__a", " "), lambda x: x != ""))
    out = out.withColumns({"char_edits": F.levenshtein("__a", "__b").cast("long"), "chars": F.length("__a").cast("long"), "word_edits": token_edits("__a", "__b"), "words": words.cast("long")})
    return out.withColumns({"cer": share_of(F.col("char_edits"), F.col("chars")), "wer": share_of(F.col("word_edits"), F.col("words"))}).drop("__a", "__b")


def micro_average(rates: DataFrame, by: str) -> DataFrame:
    """Edits of all over lengths of all."""
    out = rates.groupBy(by).agg(*(F.sum(c).cast("long").alias(c) for c in ("char_edits", "chars", "word_edits", "words")))
    return out.withColumns({"cer": share_of(F.col("char_edits"), F.col("chars")), "wer": share_of(F.col("word_edits"), F.col("words"))})


def _centre_in_zone() -> Column:
    x, y = (F.col("g.l") + F.col("g.r")) / 2, (F.col("g.t") + F.col("g.b")) / 2
    return (F.col("g.doc_id") == F.col("z.doc_id")) & (F.col("g.page_no") == F.col("z.page_no")) & x.between(F.col("z.l"), F.col("z.r")) & y.between(F.col("z.t"), F.col("z.b"))


def zone_texts(zones: DataFrame, regions: DataFrame) -> DataFrame:
    """Texts of the regions whose centre lies in each zone, in order, joined by newlines."""
    held = F.array_sort(F.collect_list(F.struct("g.seq", "g.text")))
    found = regions.alias("g").join(zones.alias("z"), _centre_in_zone()).groupBy("z.doc_id", "z.page_no", "z.zone_id").agg(held.alias("held"))
    out = zones.join(found, ["doc_id", "page_no", "zone_id"], "left")
    return out.select("doc_id", "page_no", "zone_id", F.coalesce(F.array_join(F.transform("held", lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


def region_zones(zones: DataFrame, regions: DataFrame) -> DataFrame:
    """The zone of each region; more than one is an error."""
    found = regions.alias("g").join(zones.alias("z"), _centre_in_zone(), "left").groupBy("g.doc_id", "g.page_no", "g.seq").agg(F.count("z.zone_id").alias("zones"), F.min("z.zone_id").alias("zone_id"))
    return found.withColumn("status", F.when(F.col("zones") == 0, "outside").when(F.col("zones") == 1, "inside").otherwise("ambiguous"))


# --- outlines -------------------------------------------------------------------------------


def _levels(entries: pd.DataFrame) -> pd.DataFrame:
    parent = {int(o): None if pd.isna(p) else int(p) for o, p in zip(entries["ordinal"], entries["parent_ordinal"], strict=True)}
    level: dict = {}
    for start in parent:
        way, at = [], start
        while at is not None and at in parent and at not in level and at not in way[-1:]:
            level[at] = 0  # on the way: met again, it is part of a ring
            way.append(at)
            at = parent[at]
        above = 0 if at is None else level.get(at, 0)
        known = at is None or above > 0
        for i, x in enumerate(reversed(way)):
            level[x] = above + i + 1 if known else 0
    rows = [(o, n) for o, n in level.items() if n]
    return pd.DataFrame({"doc_id": [entries["doc_id"].iloc[0]] * len(rows), "ordinal": [o for o, _ in rows], "level": [n for _, n in rows]})


def outline_levels(entries: DataFrame) -> DataFrame:
    """The level of each entry (doc_id, ordinal, parent_ordinal, title), roots at 1, however deep.

    A document's outline is walked in one pass, each entry once. An entry whose parents form a
    ring, or whose parent isn't there, has no level and no row.
    """
    return entries.select("doc_id", "ordinal", "parent_ordinal").groupBy("doc_id").applyInPandas(_levels, "doc_id long, ordinal long, level long")


def match_outline(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each title's block on its page by equality in any case, then by heading key, then by compact key; the first block.

    Keys without a letter or digit match nothing.
    """
    page = (F.col("o.doc_id") == F.col("x.doc_id")) & (F.col("o.target_page") == F.col("x.page_no"))
    keys = lambda df, text: df.withColumns({"k0": upper_invariant(collapse_ends(F.col(text))), "k1": heading_key(F.col(text)), "k2": compact_key(F.col(text))})
    titles, found = keys(outline, "title").alias("o"), keys(blocks, "norm_text").alias("x")
    same = [(F.col(f"o.k{i}") == F.col(f"x.k{i}")) & ((F.length(f"o.k{i}") > 0) if i else F.lit(True)) for i in range(3)]
    rank = F.when(same[0], 0).when(same[1], 1).when(same[2], 2)
    hits = titles.join(found, page & (same[0] | same[1] | same[2])).select("o.doc_id", "o.ordinal", "x.block_seq", rank.alias("rank"))
    best = hits.groupBy("doc_id", "ordinal").agg(F.min(F.struct("rank", "block_seq")).alias("best"))
    out = outline.join(best, ["doc_id", "ordinal"], "left")
    kind = F.when(F.col("best.rank") == 0, "ExactText").when(F.col("best.rank") == 1, "NormalizedText").when(F.col("best.rank") == 2, "CompactText").otherwise("None")
    return out.select("doc_id", "ordinal", F.col("best.block_seq").alias("block_seq"), kind.alias("match"))


def tokens(text: Column) -> Column:
    """Distinct upper-case runs of letters and digits of two signs or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(upper_invariant(text), F.lit(r"([\p{L}\p{Nd}]+)"), 1), lambda x: F.length(x) >= 2))


def lexical_candidates(titles: DataFrame, blocks: DataFrame, k: int = LEXICAL_MATCHES) -> DataFrame:
    """The k blocks of a title's page that share most of its tokens. A token join, so that only sharing pairs arise."""
    a = titles.withColumn("__t", tokens(F.col("title"))).withColumn("n", F.size("__t")).select("doc_id", "ordinal", "target_page", "n", F.explode("__t").alias("token"))
    b = blocks.select("doc_id", F.col("page_no").alias("target_page"), "block_seq", "is_heading", F.explode(tokens(F.col("norm_text"))).alias("token"))
    shared = a.join(b, ["doc_id", "target_page", "token"]).groupBy("doc_id", "ordinal", "n", "block_seq", "is_heading").agg(F.count("*").alias("shared"))
    shared = shared.withColumn("coverage", F.bround(F.col("shared") / F.col("n"), 3))
    best = Window.partitionBy("doc_id", "ordinal").orderBy(F.desc("coverage"), F.desc("shared"), F.desc("is_heading"), "block_seq")
    return shared.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("doc_id", "ordinal", "block_seq", "shared", "coverage", "rank")


def clusters(blocks: DataFrame) -> DataFrame:
    """One to three consecutive blocks of a page, with their text and bounds.

    One window for each page gathers a block and the two behind it; its prefixes are the clusters.
    """
    ahead = Window.partitionBy("doc_id", "page_no").orderBy("block_seq").rowsBetween(0, MOST_CLUSTER - 1)
    held = blocks.withColumn("held", F.collect_list(F.struct("norm_text", "l", "t", "r", "b")).over(ahead))
    out = held.select("doc_id", "page_no", "block_seq", F.explode(F.sequence(F.lit(1), F.size("held"))).alias("size"), "held")
    part = lambda c: F.transform(F.slice("held", F.lit(1), F.col("size")), lambda x: x[c])
    box = [F.array_min(part("l")).alias("cl"), F.array_min(part("t")).alias("ct"), F.array_max(part("r")).alias("cr"), F.array_max(part("b")).alias("cb")]
    return out.select("doc_id", "page_no", "block_seq", "size", F.array_join(part("norm_text"), " ").alias("cluster_text"), *box)


def containment(a: Column, b: Column) -> Column:
    """Of compact texts a (outline) and b (candidate): equal, or the shorter in the longer if not too short and not too small a part."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    some = (short >= LEAST_CONTAINED) & (short >= LEAST_SHARE * long)
    inside = F.when(some & F.contains(b, a), "OutlineWithinCandidate").when(some & F.contains(a, b), "CandidateWithinOutline")
    return F.when(short == 0, "None").when(a == b, "Equal").otherwise(F.coalesce(inside, F.lit("None")))


def band(inside: Column, shared: Column, of_title: Column, of_text: Column) -> Column:
    """O25."""
    high = (shared >= 3) & (of_title >= 0.70) & (of_text >= 0.50)
    return (
        F.when(inside == "Equal", "ExactEquivalent").when(inside != "None", "Containment").when(high, "HighOverlap").when((shared >= 2) & (of_title >= 0.50), "ModerateOverlap").when(shared >= 1, "WeakOverlap").otherwise("None")
    )


def band_rank(name: Column) -> Column:
    """Smaller is better."""
    return F.array_position(F.array(*map(F.lit, BANDS)), name)


def vertical_distance(y: Column, top: Column, bottom: Column) -> Column:
    """O26."""
    return F.bround(F.when(y < top, top - y).when(y > bottom, y - bottom).otherwise(F.when(y.isNotNull(), F.lit(0.0))), 4)


def point_distance(x: Column, y: Column, l: Column, t: Column, r: Column, b: Column) -> Column:
    """O26."""
    dx, dy = F.greatest(l - x, F.lit(0.0), x - r), F.greatest(t - y, F.lit(0.0), y - b)
    return F.when(x.isNotNull() & y.isNotNull(), F.bround(F.sqrt(dx * dx + dy * dy), 4))


def leading_number(text: Column) -> Column:
    """The number of at most four digits that a title begins with, a chapter word before it or not."""
    found = F.regexp_extract(text, rf"(?i)^{_BLANK}*(?:(?:chapter|part|section|book|excursus){_BLANK}+)?([0-9]{{1,4}})(?![\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}])", 1)
    return F.when(found != "", found.cast("int"))


def label_relation(a: Column, b: Column) -> Column:
    """Leading numbers of an outline title and a candidate."""
    return relation_of(leading_number(a), leading_number(b))


def relation_of(x: Column, y: Column) -> Column:
    """Of the numbers themselves."""
    return (
        F.when(x.isNull() & y.isNull(), "BothMissing").when(y.isNull(), "OutlineOnly").when(x.isNull(), "CandidateOnly").when(x == y, "Same").otherwise("Different")
    )


def _lexical(titles: DataFrame, texts: DataFrame, title: str, text: str, on: list[str], how: str = "inner") -> DataFrame:
    """O23-O25 over titles and candidate texts that share the keys: pairs in some relation, with its measures.

    Tokens and compact keys are made once a title and once a text, not once a pair.
    """
    a = titles.withColumns({"__a": tokens(F.col(title)), "__ka": compact_key(F.col(title))})
    b = texts.withColumns({"__b": tokens(F.col(text)), "__kb": compact_key(F.col(text))})
    pairs = a.join(b, on, how).withColumns({"shared": F.size(F.array_intersect("__a", "__b")), "containment": containment(F.col("__ka"), F.col("__kb"))})
    pairs = pairs.filter("shared > 0 or containment <> 'None'")
    share = lambda c: F.when(F.size(c) > 0, F.bround(F.col("shared") / F.size(c), 3)).otherwise(F.lit(0.0))
    pairs = pairs.withColumns({"of_title": share("__a"), "of_text": share("__b")}).drop("__a", "__b", "__ka", "__kb")
    return pairs.withColumn("band", band(F.col("containment"), F.col("shared"), F.col("of_title"), F.col("of_text")))


def align_outline(outline: DataFrame, blocks: DataFrame, k: int = BEST_MATCHES) -> DataFrame:
    """The k best clusters for each title (ordinal, title, target_page, left, top), on pages up to two away.

    The range over pages is an equi-join: a title is repeated for the five pages it may be on.
    Distances are known on the target page alone.
    """
    spread = outline.withColumn("page_no", F.explode(F.sequence(F.col("target_page") - NEAR_PAGES, F.col("target_page") + NEAR_PAGES)))
    # a title's and a cluster's number are read once each, not once a pair; the texts stay out of the pairs
    spread = spread.withColumn("__x", leading_number(F.col("title")))
    texts = clusters(blocks).withColumn("__y", leading_number(F.col("cluster_text")))
    near = _lexical(spread, texts, "title", "cluster_text", ["doc_id", "page_no"])
    here = F.col("page_no") == F.col("target_page")
    at = [F.col(c) for c in ("left", "top", "cl", "ct", "cr", "cb")]
    near = near.withColumns(
        {
            "offset": F.col("page_no") - F.col("target_page"), "labels": relation_of(F.col("__x"), F.col("__y")),
            "distance": F.when(here, vertical_distance(at[1], at[3], at[5])), "point": F.when(here, point_distance(*at)),
        }
    )
    best = Window.partitionBy("doc_id", "ordinal").orderBy(
        band_rank(F.col("band")), F.desc("of_title"), F.desc("of_text"), F.desc("shared"), F.abs("offset"), "offset", F.asc_nulls_last("distance"), "size", "block_seq"
    )
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("doc_id", "ordinal", "rank", "page_no", "block_seq", "size", "band", "containment", "labels", "shared", "of_title", "of_text", "distance", "point")


def match_titles(titles: DataFrame, regions: DataFrame) -> DataFrame:
    """The best cluster of one to three regions for each page's expected title; pages without one have no row.

    titles: doc_id, page_no, title. regions: doc_id, page_no, seq, text in reading order; the
    first region of a cluster is numbered by its place on the page, from 0.
    """
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    placed = regions.withColumns({"first_region": (F.row_number().over(page) - 1).cast("long"), "held": F.collect_list("text").over(page.rowsBetween(0, MOST_CLUSTER - 1))})
    made = placed.select("doc_id", "page_no", "first_region", F.explode(F.sequence(F.lit(1), F.size("held"))).alias("size"), "held")
    made = made.select("doc_id", "page_no", "first_region", "size", F.array_join(F.slice("held", F.lit(1), F.col("size")), " ").alias("candidate"))
    wanted = titles.filter(F.trim(F.regexp_replace("title", SPACE, " ")) != "")
    near = _lexical(wanted, made, "title", "candidate", ["doc_id", "page_no"])
    best = Window.partitionBy("doc_id", "page_no").orderBy(band_rank(F.col("band")), F.desc("of_title"), F.desc("of_text"), F.desc("shared"), "size", "first_region")
    found = near.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return found.select("doc_id", "page_no", "band", "containment", "first_region", "size", "shared", "of_title", "of_text")


def band_summary(matches: DataFrame) -> DataFrame:
    """Counts of every band, those without a title too."""
    domain = matches.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    return domain.join(matches.groupBy("band").agg(F.count("*").alias("titles")), "band", "left").fillna({"titles": 0})


def page_group_summary(pages: DataFrame) -> DataFrame:
    """Pages by native state."""
    state = F.when((F.col("word_count") == 0) & (F.col("raster_image_count") > 0) & (F.col("largest_raster_ratio") >= 0.60), "TextlessDominantRaster").when(F.col("word_count") > 0, "NativeText").otherwise("Other")
    return pages.groupBy(state.alias("state")).agg(F.count("*").alias("pages"), F.sum("word_count").cast("long").alias("words"))


def page_set_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """O34."""
    key = ["doc_id", "page_no"]
    missing = expected.select(*key).subtract(actual.select(*key)).withColumn("rule", F.lit("missing"))
    return missing.unionByName(actual.select(*key).subtract(expected.select(*key)).withColumn("rule", F.lit("unexpected")))


def sentinel_order(regions: DataFrame, sentinels: DataFrame) -> DataFrame:
    """(doc_id, page_no, passed, reason): is the first of a page's two sentinels read before the second?

    regions: doc_id, page_no, seq, text, in reading order. sentinels: doc_id, page_no, position,
    sentinel. A sentinel is where the first text holds it; both in one text aren't in order.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), SPACE, " "))
    same = (F.col("s.doc_id") == F.col("g.doc_id")) & (F.col("s.page_no") == F.col("g.page_no")) & F.contains(clean("g.text"), clean("s.sentinel"))
    found = sentinels.alias("s").join(regions.alias("g"), same, "left").groupBy("s.doc_id", "s.page_no", "s.position").agg(F.min("g.seq").alias("seq"))
    held = F.array_sort(F.collect_list(F.struct("position", "seq")))
    pages = found.groupBy("doc_id", "page_no").agg(held.alias("held"))
    at = [F.col("held")[i]["seq"] for i in (0, 1)]
    reason = (
        F.when(F.size("held") != 2, "not two sentinels").when(at[0].isNull(), "first not found").when(at[1].isNull(), "second not found").when(at[0] >= at[1], "not in order")
    )
    return pages.select("doc_id", "page_no", reason.isNull().alias("passed"), reason.alias("reason"))


def compare_expectations(found: DataFrame, expected: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """Each control with its found and expected facts; a control on one side alone fails."""
    on = [F.col(f"f.{k}") == F.col(f"e.{k}") for k in key]
    same = F.lit(True)
    for c in facts:
        same = same & F.coalesce(F.col(f"f.{c}") == F.col(f"e.{c}"), F.lit(False))
    out = found.alias("f").join(expected.alias("e"), on, "full_outer")
    return out.select(*(F.coalesce(F.col(f"f.{k}"), F.col(f"e.{k}")).alias(k) for k in key), same.alias("passed"))


def document_fingerprint(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Counts, and the hash of all block texts joined by blank lines."""
    held = F.array_sort(F.collect_list(F.struct(*order, "text")))
    out = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.array_join(F.transform(held, lambda x: x["text"]), "\n\n").alias("text"))
    return out.select("doc_id", "blocks", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("fingerprint"))


# --- boxes and specimens ----------------------------------------------------------------------


def _area(s: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{s}.r") - F.col(f"{s}.l")) * F.greatest(F.lit(0.0), F.col(f"{s}.b") - F.col(f"{s}.t"))


def box_matches(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """The best predicted box of each expected one, by the greater of overlap over union and coverage of the expected box.

    Ties go to the coverage, the overlap over union, the first box. A page without predicted
    boxes has rows without measures.
    """
    page = (F.col("e.doc_id") == F.col("p.doc_id")) & (F.col("e.page_no") == F.col("p.page_no"))
    w = F.greatest(F.lit(0.0), F.least(F.col("e.r"), F.col("p.r")) - F.greatest(F.col("e.l"), F.col("p.l")))
    h = F.greatest(F.lit(0.0), F.least(F.col("e.b"), F.col("p.b")) - F.greatest(F.col("e.t"), F.col("p.t")))
    both = w * h
    ratio = lambda y: F.when(F.col("p.seq").isNotNull(), F.when(y > 0, both / y).otherwise(F.lit(0.0)))
    pairs = expected.alias("e").join(predicted.alias("p"), page, "left").select(
        "e.doc_id", "e.page_no", F.col("e.seq").alias("seq"), F.col("p.seq").alias("predicted"), ratio(_area("p") + _area("e") - both).alias("iou"), ratio(_area("e")).alias("expected_coverage"), ratio(_area("p")).alias("predicted_coverage")
    )
    pairs = pairs.withColumn("score", F.greatest("iou", "expected_coverage"))
    best = Window.partitionBy("doc_id", "page_no", "seq").orderBy(F.desc("score"), F.desc("expected_coverage"), F.desc("iou"), F.asc_nulls_last("predicted"))
    return pairs.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def x_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """P5: shared width over the narrower one's."""
    narrow = F.least(a1 - a0, b1 - b0)
    return F.when(narrow <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / narrow)


def vertical_gap(upper_bottom: Column, lower_top: Column) -> Column:
    """P5: from the upper box down to the lower one."""
    return F.greatest(F.lit(0.0), lower_top - upper_bottom)


#: Fixed values of the column rule, in shares of the page.
LEAST_COLUMN_WIDTH, MOST_COLUMN_WIDTH, LEAST_COLUMN_HEIGHT, LEAST_SEPARATION, LEAST_BESIDE, MOST_CROSSING = 0.18, 0.70, 0.08, 0.22, 0.30, 0.05


def multi_column_score(regions: DataFrame) -> DataFrame:
    """Of every page, the best two boxes side by side: distance of their middles and shared height; 0 without any.

    regions: doc_id, page_no, seq, l, t, r, b in shares of the page.
    """
    key = ["doc_id", "page_no"]
    width, height = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    columns = regions.filter(width.between(LEAST_COLUMN_WIDTH, MOST_COLUMN_WIDTH) & (height >= LEAST_COLUMN_HEIGHT))
    page = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.seq") < F.col("b.seq"))
    centre = lambda s: (F.col(f"{s}.l") + F.col(f"{s}.r")) / 2
    apart = F.abs(centre("a") - centre("b"))
    high = x_overlap(F.col("a.t"), F.col("a.b"), F.col("b.t"), F.col("b.b"))
    wide = F.greatest(F.lit(0.0), F.least(F.col("a.r"), F.col("b.r")) - F.greatest(F.col("a.l"), F.col("b.l")))
    beside = (apart >= LEAST_SEPARATION) & (high >= LEAST_BESIDE) & (wide <= MOST_CROSSING)
    best = columns.alias("a").join(columns.alias("b"), page & beside).groupBy("a.doc_id", "a.page_no").agg(F.count("*").alias("pairs"), F.max(apart + high).alias("score"))
    return regions.select(*key).distinct().join(best, key, "left").fillna({"pairs": 0, "score": 0.0})


#: Fixed values of the specimen rules: category, first and last year; least characters; the page preferred for the nineteenth century.
PERIODS = (("early-print", None, 1550), ("eighteenth-century", 1700, 1799), ("nineteenth-century", 1800, 1900))
LEAST_SPECIMEN_CHARS = 1000
PREFERRED = {"nineteenth-century": "hilbert_zahlkoerper_1897_0379.xml"}


def select_specimens(candidates: DataFrame) -> DataFrame:
    """Four specimens of different kinds, none taken twice.

    candidates: document_id, name, year, chars, regions, score. A period takes its first page
    by document and name (a preferred page goes first, whatever its year); the last place goes
    to the page with most columns side by side, or to the one with most regions if no page has
    columns. Fewer than four candidates, or a place that nobody can take, is an error. Each
    step is a top-1 of what is left.
    """
    order, key = ["document_id", "name"], ["document_id", "name"]
    spark: SparkSession = candidates.sparkSession
    if candidates.limit(4).count() < 4:
        raise ValueError("fewer than four candidates")
    taken: list[tuple] = []

    def first(df: DataFrame, *by: Column | str) -> tuple | None:
        gone = F.lit(False)
        for _, document, name in taken:
            gone = gone | ((F.col("document_id") == document) & (F.col("name") == name))
        row = df.filter(~gone).orderBy(*by, *order).select(*key).first()
        return tuple(row) if row else None

    full = F.col("chars") >= LEAST_SPECIMEN_CHARS
    for category, since, until in PERIODS:
        found = first(candidates.filter(F.col("name") == PREFERRED[category])) if category in PREFERRED else None
        inside = (F.col("year") <= until) if since is None else F.col("year").between(since, until)
        found = found or first(candidates.filter(inside & full))
        if found is None:
            raise ValueError(f"no {category} specimen")
        taken.append((category, *found))
    columns = first(candidates.filter((F.col("score") > 0) & full), F.desc("score"))
    taken.append(("multi-column", *columns) if columns else ("complex-layout-fallback", *first(candidates, F.desc("regions"), F.desc("chars"))))
    rows = [(i + 1, *t) for i, t in enumerate(taken)]
    return spark.createDataFrame(rows, "place int, category string, document_id string, name string")


def multiset_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words in common, with their counts. a, b: doc_id, text."""
    count = lambda df: df.select("doc_id", F.explode(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    both = count(a).join(count(b).withColumnRenamed("n", "m"), ["doc_id", "word"])
    return both.groupBy("doc_id").agg(F.sum(F.least("n", "m")).cast("long").alias("common"))


def ordered_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Words in common in the same order."""
    return a.join(b.withColumnRenamed("text", "other"), "doc_id").select("doc_id", ordered_overlap("text", "other").alias("common"))
