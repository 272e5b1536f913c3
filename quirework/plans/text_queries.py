"""Queries over normalisation, margins, headings, segments, assessment and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import assess, metrics, segment, text
from quirework.plans import evidence as ev

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


_ROUGH = "replace(replace(replace(text, ', ', '-' || chr(10)), 'é', 'e' || chr(769)), '. ', '.' || chr(13) || chr(10) || chr(160))"


def _joined(x: str) -> str:
    """One pass of dehyphenation; two do what a lookaround does in one."""
    return f"regexp_replace({x}, '(\\p{{L}})-[\\t ]*\\n[\\t ]*(\\p{{Ll}})', '\\1\\2', 'g')"


@register("normalize_text", "SELECT doc_id, " + ev.norm_sql(_joined(_joined(f"regexp_replace(nfc_normalize({_ROUGH}), '\\r\\n?', chr(10), 'g')"))) + " AS norm_text FROM documents")
def normalize_text(spark, sf_dir):
    """B1: on texts with hyphens at line ends, decomposed accents, CRLF and NBSP put in."""
    rough = F.replace("text", F.lit(", "), F.lit("-\n"))
    rough = F.replace(F.replace(rough, F.lit("é"), F.lit("e\u0301")), F.lit(". "), F.lit(".\r\n\u00a0"))
    return ev.documents(spark, sf_dir).select("doc_id", text.normalize(rough).alias("norm_text"))


@register("canonical_text", "WITH " + ev.NORM_BLOCKS + " SELECT doc_id, line_no, key FROM norm1")
def canonical_text(spark, sf_dir):
    """B2."""
    blocks = ev.blocks_as_they_lie(spark, sf_dir)
    return blocks.select("doc_id", F.col("line_no").cast("long"), text.canonical(text.normalize(F.col("text"))).alias("key"))


@register("collapse_whitespace", "WITH " + ev.LINES + " SELECT doc_id, line_no, " + ev.norm_sql("replace(text, 'the ', chr(8195) || 'the  ')") + " AS text FROM lines")
def collapse_whitespace(spark, sf_dir):
    """Structured white space, without composition."""
    spaced = F.replace("text", F.lit("the "), F.lit("\u2003the  "))
    return ev.plaintext.lines(ev.documents(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long"), text.collapse(spaced).alias("text"))


@register("recurring_margins", "WITH " + ev.NORM_BLOCKS + " SELECT doc_id, zone, key, pages FROM margins")
def recurring_margins(spark, sf_dir):
    """B3 and B4."""
    blocks = ev.blocks(spark, sf_dir).withColumn("norm_text", text.normalize(F.coalesce("composed", "text"), compose=False))
    return text.recurring_margins(blocks)


@register("normalized_blocks", "WITH " + ev.NORM_BLOCKS + " SELECT doc_id, page_no, block_seq, norm_text, exclusion FROM norm")
def normalized_blocks(spark, sf_dir):
    """B5 and B6."""
    out = ev.norm_blocks(spark, sf_dir)
    return out.select("doc_id", F.col("page_no").cast("long"), F.col("block_seq").cast("long"), "norm_text", "exclusion")


@register("body_font_size", "WITH " + ev.HEADINGS + " SELECT doc_id, body_pt FROM body")
def body_font_size(spark, sf_dir):
    """I1."""
    return segment.body_font_size(ev.norm_blocks(spark, sf_dir).filter("exclusion is null and norm_text <> ''"))


@register("native_headings", "WITH " + ev.HEADINGS + " SELECT doc_id, page_no, block_seq, norm_text, ratio, typographic FROM gated WHERE typographic")
def native_headings(spark, sf_dir):
    """I2-I4."""
    out = segment.with_headings(ev.norm_blocks(spark, sf_dir))
    return out.filter("is_heading").select("doc_id", F.col("page_no").cast("long"), F.col("block_seq").cast("long"), "norm_text", "ratio", F.col("is_heading").alias("typographic"))


@register("heading_hints", "WITH " + ev.HEADINGS + " SELECT doc_id, page_no, block_seq, is_heading, typographic FROM headed")
def heading_hints(spark, sf_dir):
    """I5 and I6."""
    out = ev.heading_blocks(spark, sf_dir)
    alone = segment.native_heading(F.col("norm_text"), F.col("word_count"), F.col("ratio"))
    return out.select("doc_id", F.col("page_no").cast("long"), F.col("block_seq").cast("long"), "is_heading", alone.alias("typographic"))


_SEGMENT = "printf('p%06d-s%06d', first_page, ordinal)"


@register("segments_native", "WITH " + ev.SEGMENTS + f" SELECT doc_id, ordinal, {_SEGMENT} AS segment_id, first_page, last_page, block_count, heading_text, text, sha256(text) AS text_sha256 FROM segments")
def segments_native(spark, sf_dir):
    """The flagship - text to normalised, margin-free, hashed segments."""
    return segment.segments(ev.norm_blocks(spark, sf_dir), ev.HINTS)


# --- assessment -------------------------------------------------------------------------------

_PREFLIGHT = """,
pf0 AS (
  SELECT doc_id, count(*) AS page_count, count(*) FILTER (WHERE word_count > 0) AS text_pages, count(*) FILTER (WHERE raster_image_count > 0 AND largest_raster_ratio >= 6e-1) AS raster_pages,
         count(*) FILTER (WHERE word_count = 0 AND raster_image_count > 0 AND largest_raster_ratio >= 6e-1) AS bare_raster_pages, sum(word_count)::BIGINT AS words,
         coalesce(string_agg(page_no::VARCHAR, ',' ORDER BY page_no) FILTER (WHERE word_count = 0), '') AS textless_pages FROM routed GROUP BY doc_id),
preflight AS (
  SELECT d.doc_id, coalesce(page_count, 0) AS page_count, coalesce(text_pages, 0) AS text_pages, coalesce(raster_pages, 0) AS raster_pages, coalesce(words, 0) AS words,
         CASE WHEN coalesce(page_count, 0) = 0 THEN 0e0 ELSE round_even(100e0 * text_pages / page_count, 1) END AS coverage, coalesce(textless_pages, '') AS textless_pages,
         CASE WHEN coalesce(page_count, 0) = 0 THEN 'Problematic' WHEN text_pages = page_count THEN 'HealthyBornDigital' WHEN text_pages > 0 THEN 'Hybrid'
              WHEN bare_raster_pages = page_count THEN 'RasterOrScanned' ELSE 'Problematic' END AS classification
  FROM documents d LEFT JOIN pf0 ON pf0.doc_id = d.doc_id)"""


@register("document_preflight", "WITH " + ev.PAGES + _PREFLIGHT + " SELECT * FROM preflight")
def document_preflight(spark, sf_dir):
    """E1."""
    return assess.preflight(ev.documents(spark, sf_dir), ev.pages(spark, sf_dir))


@register("page_assessment", "WITH " + ev.PAGES + " SELECT doc_id, page_no, status, route, authority FROM routed")
def page_assessment(spark, sf_dir):
    """E2-E5."""
    return assess.assess_pages(ev.pages(spark, sf_dir)).select("doc_id", F.col("page_no").cast("long"), "status", "route", "authority")


_KINDS = ["CaptionedMeaningfulVisual", "Unknown", "BlankCanvas", "LargeIndependentVisual", "SourceBackedUnqualifiedVisual"]


def _visuals(pages):
    kinds = F.array(*map(F.lit, _KINDS))
    n = F.when(F.col("raster_image_count") > 0, (F.col("doc_id") % 3).cast("int")).otherwise(F.lit(0))
    out = pages.select("doc_id", "page_no", F.explode(F.expr("sequence(0, 2)")).alias("visual_idx"), n.alias("n")).filter("visual_idx < n")
    return out.select("doc_id", "page_no", "visual_idx", F.element_at(kinds, ((F.col("doc_id") + F.col("page_no") + F.col("visual_idx")) % 5 + 1).cast("int")).alias("kind"))


_PLANS = (
    ev.PAGES
    + """,
visuals AS (
  SELECT doc_id, page_no, i AS visual_idx, ['CaptionedMeaningfulVisual', 'Unknown', 'BlankCanvas', 'LargeIndependentVisual', 'SourceBackedUnqualifiedVisual'][(doc_id + page_no + i) % 5 + 1] AS kind
  FROM routed, range(0, 3) AS x(i) WHERE raster_image_count > 0 AND i < doc_id % 3),
folded AS (
  SELECT doc_id, page_no, count(*) AS visuals, bool_or(kind = 'Unknown') AS unexplained, bool_or(kind IN ('CaptionedMeaningfulVisual', 'LargeIndependentVisual', 'SourceBackedUnqualifiedVisual')) AS preserve
  FROM visuals GROUP BY doc_id, page_no),
needs AS (
  SELECT r.doc_id, r.page_no, status, coalesce(visuals, 0) AS visuals, coalesce(unexplained, false) AS analysis, coalesce(preserve, false) AS requires_preservation,
         CASE authority WHEN 'Trusted' THEN 'UseNativeText' WHEN 'Missing' THEN 'RecoverMissingNativeText' WHEN 'Corrupted' THEN 'ReconcileCorruptedNativeText'
              ELSE CASE WHEN coalesce(visuals, 0) > 0 AND NOT coalesce(unexplained, false) THEN 'UseNativeText' ELSE 'VerifyNativeText' END END AS requirement
  FROM routed r LEFT JOIN folded f ON f.doc_id = r.doc_id AND f.page_no = r.page_no),
plans AS (
  SELECT *, CASE requirement WHEN 'UseNativeText' THEN 'NativeText' WHEN 'RecoverMissingNativeText' THEN 'TargetedOcrRecovery' WHEN 'VerifyNativeText' THEN 'TargetedOcrVerification'
            ELSE 'TargetedOcrReconciliation' END AS mode FROM needs)"""
)


@register("text_requirements", "WITH " + _PLANS + " SELECT doc_id, page_no, requirement, visuals FROM plans")
def text_requirements(spark, sf_dir):
    """E6 and E7."""
    pages = assess.assess_pages(ev.pages(spark, sf_dir))
    return assess.text_requirements(pages, _visuals(pages)).select("doc_id", F.col("page_no").cast("long"), "requirement", "visuals")


@register(
    "execution_plans",
    "WITH " + _PLANS + """ SELECT doc_id, page_no, mode, mode <> 'NativeText' AS requires_ocr, mode <> 'NativeText' OR analysis AS requires_layout,
    mode <> 'NativeText' OR analysis OR requires_preservation AS requires_raster, mode IN ('TargetedOcrVerification', 'TargetedOcrReconciliation') AS requires_reconciliation, requires_preservation,
    CASE status WHEN 'Missing' THEN mode = 'TargetedOcrRecovery' WHEN 'Suspicious' THEN mode = 'TargetedOcrReconciliation' WHEN 'Unverified' THEN mode IN ('NativeText', 'TargetedOcrVerification')
    ELSE mode = 'NativeText' END AS allowed FROM plans""",
)
def execution_plans(spark, sf_dir):
    """E8 and the guard of E9."""
    pages = assess.assess_pages(ev.pages(spark, sf_dir))
    out = assess.guard_plans(assess.compile_plans(pages, _visuals(pages)))
    flags = ["requires_ocr", "requires_layout", "requires_raster", "requires_reconciliation", "requires_preservation", "allowed"]
    return out.select("doc_id", F.col("page_no").cast("long"), "mode", *flags)


@register(
    "visual_coverage",
    "WITH " + _PLANS + """ SELECT r.doc_id, r.page_no, (r.doc_id % 4)::BIGINT AS expected, coalesce(f.visuals, 0) AS found FROM routed r LEFT JOIN folded f ON f.doc_id = r.doc_id AND f.page_no = r.page_no
    WHERE coalesce(f.visuals, 0) <> r.doc_id % 4""",
)
def visual_coverage(spark, sf_dir):
    """Pages whose visuals aren't the declared ones."""
    pages = assess.assess_pages(ev.pages(spark, sf_dir))
    declared = pages.select("doc_id", "page_no", (F.col("doc_id") % 4).alias("expected"))
    return assess.visual_coverage(_visuals(pages), declared).select("doc_id", F.col("page_no").cast("long"), "expected", "found")


@register("pages_for_layout", "WITH " + ev.PAGES + " SELECT doc_id, page_no, status FROM routed WHERE route <> 'NativeOnly' OR (status = 'Healthy' AND raster_image_count > 0)")
def pages_for_layout(spark, sf_dir):
    """E10."""
    return assess.needs_layout(assess.assess_pages(ev.pages(spark, sf_dir))).select("doc_id", F.col("page_no").cast("long"), "status")


@register(
    "unsafe_documents",
    "WITH " + ev.PAGES + _PREFLIGHT + """ SELECT p.doc_id, p.classification FROM preflight p JOIN (SELECT doc_id FROM routed GROUP BY doc_id HAVING bool_and(doc_id % 4 = 0 OR route = 'NativeOnly')) r
    ON r.doc_id = p.doc_id WHERE p.classification <> 'HealthyBornDigital'""",
)
def unsafe_documents(spark, sf_dir):
    """Every fourth document is planned as if its native text were safe."""
    pages = assess.assess_pages(ev.pages(spark, sf_dir))
    planned = pages.withColumn("route", F.when(F.col("doc_id") % 4 == 0, "NativeOnly").otherwise(F.col("route")))
    return assess.unsafe_documents(assess.preflight(ev.documents(spark, sf_dir), pages), planned)


# --- diagnostics ------------------------------------------------------------------------------


@register("page_range", "WITH " + ev.PAGES + " SELECT doc_id, page_no, word_count FROM pages1 WHERE page_no BETWEEN 2 AND 3")
def page_range(spark, sf_dir):
    """O1."""
    return metrics.page_range(ev.pages(spark, sf_dir), 2, 3).select("doc_id", F.col("page_no").cast("long"), "word_count")


@register(
    "extraction_metrics",
    "WITH " + ev.PAGES + """ SELECT doc_id, count(*) AS pages, sum(word_count)::BIGINT AS words, sum(block_count)::BIGINT AS blocks, count(*) FILTER (WHERE word_count > 0) AS pages_with_words,
    count(*) FILTER (WHERE word_count = 0) AS pages_without_words, round_even(100e0 * count(*) FILTER (WHERE word_count > 0) / count(*), 1) AS coverage FROM pages1 GROUP BY doc_id""",
)
def extraction_metrics(spark, sf_dir):
    """O2."""
    return metrics.extraction_metrics(ev.pages(spark, sf_dir))


@register(
    "normalization_metrics",
    "WITH " + ev.NORM_BLOCKS + """ SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE exclusion IS NULL) AS included, count(*) FILTER (WHERE exclusion = 'RepeatedHeader') AS headers,
    count(*) FILTER (WHERE exclusion = 'RepeatedFooter') AS footers FROM norm GROUP BY doc_id""",
)
def normalization_metrics(spark, sf_dir):
    """O3."""
    return metrics.normalization_metrics(ev.norm_blocks(spark, sf_dir))


@register(
    "column_flow",
    "WITH " + ev.BLOCKS + """,
placed AS (SELECT *, CASE WHEN r - l >= 55e-2 THEN 'W' WHEN (l + r) / 2 < 5e-1 THEN 'L' ELSE 'R' END AS col FROM blocks),
marked AS (SELECT *, lag(col) OVER (PARTITION BY doc_id, page_no ORDER BY block_seq) <> col AS switch,
  t < lag(t) OVER (PARTITION BY doc_id, page_no, col ORDER BY block_seq) - 3e-2 AS reversal FROM (SELECT doc_id, page_no, (block_seq * 5) % 8 AS block_seq, t, col FROM placed WHERE col <> 'W'))
SELECT doc_id, page_no, count(*) FILTER (WHERE col = 'L') AS left_blocks, count(*) FILTER (WHERE col = 'R') AS right_blocks, count(*) FILTER (WHERE switch) AS switches,
  count(*) FILTER (WHERE reversal) AS reversals, count(*) FILTER (WHERE col = 'L') >= 2 AND count(*) FILTER (WHERE col = 'R') >= 2 AS candidate,
  count(*) FILTER (WHERE switch) > 1 AS interleaved, count(*) FILTER (WHERE reversal) > 0 AS reversed FROM marked GROUP BY doc_id, page_no""",
)
def column_flow(spark, sf_dir):
    """Over blocks read in a shuffled order."""
    blocks = ev.blocks(spark, sf_dir).withColumn("block_seq", (F.col("block_seq") * 5) % 8)
    return metrics.column_flow(blocks, 1000.0).withColumn("page_no", F.col("page_no").cast("long"))


@register(
    "probe_search",
    "WITH " + ev.BLOCKS + """ SELECT doc_id, page_no, count(*) FILTER (WHERE contains(lower(text), 'of the')) AS blocks_found FROM blocks GROUP BY doc_id, page_no
    HAVING contains(lower(string_agg(text, ' ' ORDER BY block_seq)), 'of the')""",
)
def probe_search(spark, sf_dir):
    """O8."""
    return metrics.probe(ev.blocks(spark, sf_dir), "Of The").withColumn("page_no", F.col("page_no").cast("long"))


@register(
    "segment_metrics",
    "WITH " + ev.SEGMENTS + """ SELECT doc_id, count(*) AS segments, count(*) FILTER (WHERE last_page > first_page) AS cross_page, min(length(text)) AS min_chars, median(length(text))::DOUBLE AS median_chars,
    round_even(sum(length(text))::DOUBLE / count(*), 3) AS avg_chars, max(length(text)) AS max_chars, max(block_count) AS max_blocks, count(*) FILTER (WHERE length(text) <= 120) AS small,
    count(*) FILTER (WHERE length(text) >= 4000) AS large, count(*) FILTER (WHERE length(text) >= 12000) AS very_large FROM segments GROUP BY doc_id""",
)
def segment_metrics(spark, sf_dir):
    """O9."""
    return metrics.segment_metrics(segments_native(spark, sf_dir))


@register(
    "segment_outliers",
    "WITH " + ev.SEGMENTS + """ (SELECT doc_id, ordinal, length(text) AS chars, 'smallest' AS side FROM segments ORDER BY chars, doc_id, ordinal LIMIT 10)
    UNION ALL (SELECT doc_id, ordinal, length(text) AS chars, 'largest' AS side FROM segments ORDER BY chars DESC, doc_id, ordinal LIMIT 10)""",
)
def segment_outliers(spark, sf_dir):
    """A top-k report."""
    return metrics.outliers(segments_native(spark, sf_dir))


_BAND = "CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio < 118e-2 THEN 'body' WHEN ratio < 13e-1 THEN '1.18-1.30' WHEN ratio < 155e-2 THEN '1.30-1.55' ELSE '1.55+' END"
_KIND = "CASE WHEN ratio >= 155e-2 THEN 'Chapter' WHEN ratio >= 13e-1 THEN 'Section' WHEN ratio >= 118e-2 THEN 'Subsection' END"


@register("typography_bands", "WITH " + ev.HEADINGS + f" SELECT {_BAND} AS band, {_KIND} AS kind, count(*) AS blocks, sum(word_count)::BIGINT AS words FROM headed GROUP BY 1, 2")
def typography_bands(spark, sf_dir):
    """O11 and O12."""
    out = ev.heading_blocks(spark, sf_dir)
    return out.groupBy(metrics.ratio_band(F.col("ratio")).alias("band"), metrics.candidate_kind(F.col("ratio")).alias("kind")).agg(F.count("*").alias("blocks"), F.sum("word_count").alias("words"))


@register("size_distribution", "WITH " + ev.BLOCKS + " SELECT round(median_pt, 3) AS size, count(*) AS blocks, sum(word_count)::BIGINT AS words FROM blocks GROUP BY 1")
def size_distribution(spark, sf_dir):
    """O13."""
    return metrics.size_distribution(ev.blocks_as_they_lie(spark, sf_dir))


@register("top_fonts", "WITH " + ev.BLOCKS + " SELECT font, sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g')))::BIGINT AS letters FROM blocks GROUP BY font ORDER BY letters DESC, font LIMIT 3")
def top_fonts(spark, sf_dir):
    """A top-k report."""
    return metrics.top_fonts(ev.blocks_as_they_lie(spark, sf_dir), 3)


@register(
    "heading_context",
    "WITH " + ev.HEADINGS + """ SELECT doc_id, page_no, block_seq, norm_text, previous_words, next_words, previous_heading FROM (
    SELECT *, lag(word_count) OVER f AS previous_words, lead(word_count) OVER f AS next_words, coalesce(lag(is_heading) OVER f, false) AS previous_heading FROM headed
    WINDOW f AS (PARTITION BY doc_id ORDER BY page_no, block_seq)) WHERE is_heading""",
)
def heading_context(spark, sf_dir):
    """O14."""
    out = metrics.heading_context(ev.heading_blocks(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_no", "block_seq", "previous_words", "next_words")})


@register(
    "repeated_headings",
    "WITH " + ev.HEADINGS + " SELECT doc_id, " + ev.upper_sql("norm_text") + " AS key, count(*) AS times, min(page_no) AS first_page FROM headed WHERE is_heading GROUP BY 1, 2 HAVING count(*) > 1",
)
def repeated_headings(spark, sf_dir):
    """O14."""
    return metrics.repeated_headings(metrics.heading_context(ev.heading_blocks(spark, sf_dir)))


@register(
    "heading_difference",
    "WITH " + ev.HEADINGS + """, a AS (SELECT doc_id, page_no, block_seq FROM headed WHERE is_heading), z AS (SELECT doc_id, page_no, block_seq FROM headed WHERE ratio >= 13e-1)
    SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM z) UNION ALL SELECT *, 'second' AS side FROM (SELECT * FROM z EXCEPT SELECT * FROM a)""",
)
def heading_difference(spark, sf_dir):
    """The engine's headings against those by size alone."""
    out = ev.heading_blocks(spark, sf_dir)
    found = metrics.heading_difference(out.filter("is_heading"), out.filter(F.col("ratio") >= 1.3))
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_no", "block_seq")})


_LETTERS = r"length(regexp_replace(norm_text, '[^\p{L}]', '', 'g'))"
_ALNUM = r"length(regexp_replace(norm_text, '[^\p{L}\p{Nd}]', '', 'g'))"
_SOLID = r"length(regexp_replace(norm_text, '[\t\n\x0B\f\r\x85\p{Z}]', '', 'g'))"
_LOOSE = f"(length(norm_text) BETWEEN 1 AND 180 AND NOT regexp_matches(norm_text, '[�\\p{{Cc}}]') AND {_LETTERS} >= 3 AND 2 * {_ALNUM} >= {_SOLID} AND word_count <= 24)"
_POLICIES = ev.HEADINGS + f""",
facts AS (
  SELECT *, coalesce({_LOOSE} AND ratio >= 118e-2 AND NOT (ratio < 13e-1 AND regexp_matches(norm_text, '[.;,]$')), false) AS ty, typographic AS st,
    {_LOOSE} AND regexp_matches(norm_text, '(?i)^(?:CHAPTER|PART|SECTION|BOOK)\\b') AND (ratio IS NULL OR ratio >= 95e-2) AS ex FROM headed),
policies AS (SELECT unnest(['A-ProductionStrictTypographyV4', 'B-TypographyOnly', 'C-TypographyPlusStrongExplicit', 'D-TypographyPlusHints', 'E-StrictTypographyOnly', 'F-StrictTypographyPlusHints',
  'G-ProductionStrictTypographyPlusHintsV4']) AS policy),
spread AS (
  SELECT policy, doc_id, page_no, block_seq, length(norm_text) AS chars, st AS engine,
    CASE left(policy, 1) WHEN 'A' THEN st WHEN 'B' THEN ty WHEN 'C' THEN ty OR ex WHEN 'D' THEN ty OR hint WHEN 'E' THEN st ELSE st OR hint END AS chosen
  FROM (SELECT *, {" OR ".join(ev._hint_sql(h) for h in ("Chapter 2", "the end"))} AS hint FROM facts), policies)"""


@register(
    "counterfactual_policies",
    "WITH " + _POLICIES + """,
islands AS (SELECT *, sum(chosen::INT) OVER (PARTITION BY policy, doc_id ORDER BY page_no, block_seq ROWS UNBOUNDED PRECEDING) AS seg_no FROM spread),
cut AS (
  SELECT doc_id, policy, seg_no, CASE WHEN seg_no = 0 THEN page_no ELSE 0 END AS fallback_page, sum(chars) + 2 * (count(*) - 1) AS chars, min(page_no) AS first_page, max(page_no) AS last_page, bool_or(chosen) AS headed,
    count(*) FILTER (WHERE chosen AND NOT engine) AS added, count(*) FILTER (WHERE NOT chosen AND engine) AS removed FROM islands GROUP BY ALL)
SELECT doc_id, policy, count(*) AS segments, count(*) FILTER (WHERE headed) AS headed, count(*) FILTER (WHERE NOT headed) AS fallback, count(*) FILTER (WHERE first_page <> last_page) AS cross_page,
  count(*) FILTER (WHERE chars <= 120) AS small, count(*) FILTER (WHERE chars >= 4000) AS large, min(chars)::BIGINT AS min_chars, median(chars)::DOUBLE AS median_chars,
  sum(chars)::DOUBLE / count(*) AS avg_chars, max(chars)::BIGINT AS max_chars, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM cut GROUP BY doc_id, policy""",
)
def counterfactual_policies(spark, sf_dir):
    """O16-O18."""
    return metrics.counterfactual(ev.heading_blocks(spark, sf_dir), ev.HINTS)


@register(
    "gate_comparisons",
    "WITH " + _POLICIES + """,
compared AS (SELECT a.doc_id, a.policy AS from_policy, z.policy AS to_policy, a.chosen AS x, z.chosen AS y FROM spread a JOIN spread z ON z.doc_id = a.doc_id AND z.page_no = a.page_no AND z.block_seq = a.block_seq
  AND (left(a.policy, 1) || left(z.policy, 1)) IN ('BE', 'DF'))
SELECT doc_id, from_policy, to_policy, count(*) FILTER (WHERE x AND NOT y) AS removed, count(*) FILTER (WHERE y AND NOT x) AS added FROM compared GROUP BY doc_id, from_policy, to_policy""",
)
def gate_comparisons(spark, sf_dir):
    """What the stricter text gate changes."""
    return metrics.gate_comparisons(ev.heading_blocks(spark, sf_dir), ev.HINTS)
