"""Queries over assembly, hybrid segments, provenance, quality and result integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.operators import assemble, assess, provenance, segment, text, visual
from quirework.plans import evidence as ev
from quirework.plans import page_queries as pq
from quirework.sources import plaintext

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


_long = pq._long


@ev.shared
def _raw_elements(spark, sf_dir):
    """Elements as assembled; margins, typography and segments each look at them, so they are made once."""
    key = ["doc_id", "page_no"]
    blocks, layout = ev.blocks(spark, sf_dir), pq.layout(spark, sf_dir)
    healthy = assess.assess_pages(ev.pages(spark, sf_dir)).filter("status = 'Healthy'").select(*key)
    facts = ["t", "b", "median_pt", "word_count"]
    native = assemble.native_elements(blocks.join(healthy, key, "left_semi"), facts)
    # pages go before the parts are put together: a union is dealt out by nothing
    failed = pq.page_outcomes(spark, sf_dir).filter("outcome = 'Failed'").select(*key)
    layout = layout.join(healthy, key, "left_anti").join(failed, key, "left_anti")
    place = layout.select(*key, "obs_seq", "t", "b")
    beside = place.select(*key, "obs_seq", F.col("t").alias("box_t"), F.col("b").alias("box_b"))
    read = pq.reconciled(spark, sf_dir, beside).withColumns({"t": F.col("box_t"), "b": F.col("box_b")})
    read = assemble.reconciled_elements(read, ["t", "b"])
    figures = visual.layout_figures(layout).withColumn("disposition", assess.mapped(F.col("kind"), assess.DISPOSITION))
    figures = visual.execute_visuals(figures).withColumn("reading_order", F.col("obs_seq"))
    shown = assemble.visual_elements(figures.join(place, [*key, "obs_seq"]), ["t", "b"])
    boxes = read.unionByName(shown).unionByName(assemble.deferred_elements(layout.filter("kind = 'Unknown'"), ["t", "b"]))
    boxes = boxes.withColumns({"median_pt": F.lit(None).cast("double"), "word_count": F.lit(None).cast("int")})
    return native.unionByName(boxes).withColumn("composed", text.recomposed("text"))


@ev.shared
def _normalized_elements(spark, sf_dir):
    return assemble.normalize_elements(_raw_elements(spark, sf_dir))


def elements(spark, sf_dir):
    """Elements of every page: native blocks where the page is healthy, boxes with reconciled text and visuals elsewhere."""
    out = _normalized_elements(spark, sf_dir)
    live = out.filter("exclusion is null and norm_text <> '' and median_pt is not null")
    out = out.join(segment.body_font_size(live), "doc_id", "left")
    return out.withColumn("ratio", segment.font_ratio(F.col("median_pt"), F.col("body_pt"))).drop("body_pt")


ELEMENTS = (
    pq.RECONCILED
    + pq._FIGURES
    + """,
elements0 AS (
  SELECT b.doc_id, b.page_no, b.block_seq AS ord, 'Text' AS kind, b.text, 'Native' AS origin, NULL::BIGINT AS obs_seq, b.block_seq, NULL AS decision, b.t, b.b, b.median_pt, b.word_count
  FROM blocks b JOIN routed p ON p.doc_id = b.doc_id AND p.page_no = b.page_no AND p.status = 'Healthy'
  UNION ALL SELECT x.doc_id, x.page_no, x.ord, x.kind, x.text, x.origin, x.obs_seq, NULL, x.decision, o.t, o.b, NULL, NULL FROM (
    SELECT doc_id, page_no, reading_order AS ord, CASE WHEN selected_text IS NULL THEN 'UnresolvedText' WHEN kind = 'Heading' THEN 'Heading' WHEN kind = 'Caption' THEN 'Caption' ELSE 'Text' END AS kind,
      selected_text AS text, origin, obs_seq, decision FROM rec
    UNION ALL SELECT doc_id, page_no, obs_seq, CASE WHEN figure_kind = 'Unknown' THEN 'Deferred' ELSE 'Visual' END, NULL, 'None', obs_seq, NULL FROM figures
    UNION ALL SELECT doc_id, page_no, reading_order, 'Deferred', NULL, 'None', obs_seq, NULL FROM layout WHERE kind = 'Unknown') x
  JOIN layout o ON o.doc_id = x.doc_id AND o.page_no = x.page_no AND o.obs_seq = x.obs_seq JOIN routed p ON p.doc_id = x.doc_id AND p.page_no = x.page_no AND p.status <> 'Healthy' WHERE (x.doc_id, x.page_no) NOT IN (SELECT doc_id, page_no FROM failed))"""
    + ev.norm_ctes("elements0", "e_")
    + """,
ew AS (SELECT doc_id, median_pt, sum(word_count) AS weight FROM e_norm WHERE exclusion IS NULL AND norm_text <> '' AND median_pt > 0 AND word_count > 0 GROUP BY ALL),
er AS (SELECT *, sum(weight) OVER (PARTITION BY doc_id ORDER BY median_pt ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY doc_id) AS total FROM ew),
eb AS (SELECT doc_id, min(median_pt) AS body_pt FROM er WHERE upto >= (total + 1) // 2 GROUP BY doc_id),
elements AS (SELECT n.*, median_pt / body_pt AS ratio FROM e_norm n LEFT JOIN eb ON eb.doc_id = n.doc_id)"""
)

_KEY = ev.key_sql("norm_text")
HYBRID = (
    ELEMENTS
    + f""",
h0 AS (SELECT *, {_KEY} AS hkey, {ev.upper_sql("regexp_replace(regexp_extract(text, '^\\s*([^\\n]*)', 1), '[^\\p{L}\\p{Nd}]', '', 'g')")} AS hfirst FROM elements WHERE exclusion IS NULL),
h1 AS (SELECT *, coalesce(kind = 'Heading' OR (kind = 'Text' AND norm_text IS NOT NULL AND ({" OR ".join(ev._hint_sql(h) for h in ("Chapter 2", "the end"))} OR (obs_seq IS NULL AND coalesce(
  length(norm_text) BETWEEN 1 AND 180 AND NOT regexp_matches(norm_text, '[�\\p{{Cc}}]') AND length(regexp_replace(norm_text, '[^\\p{{L}}]', '', 'g')) >= 4
  AND length(regexp_replace(norm_text, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) >= 55e-2 * length(regexp_replace(norm_text, '[\\t\\n\\x0B\\f\\r\\x85\\p{{Z}}]', '', 'g')) AND word_count <= 24
  AND ratio >= 118e-2 AND NOT (ratio < 13e-1 AND regexp_matches(norm_text, '[.;,]$')), false)))), false) AS is_heading FROM h0),
h2 AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY page_no, ord ROWS UNBOUNDED PRECEDING) AS seg_no FROM h1),
members AS (SELECT *, CASE WHEN seg_no = 0 THEN page_no ELSE 0 END AS fallback_page, printf('p%06d-e%06d', page_no, ord) AS element_id FROM h2),
h3 AS (SELECT doc_id, seg_no, fallback_page, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS members, bool_or(coalesce(norm_text <> '', false)) AS any_text,
  coalesce(string_agg(norm_text, chr(10) || chr(10) ORDER BY page_no, ord) FILTER (WHERE norm_text <> ''), '') AS text, max(CASE WHEN is_heading THEN norm_text END) AS heading_text,
  coalesce(string_agg(DISTINCT origin, ',' ORDER BY origin) FILTER (WHERE origin <> 'None'), '') AS origins, count(*) FILTER (WHERE kind = 'Visual') AS visual_members,
  bool_or(kind IN ('UnresolvedText', 'Deferred')) AS has_unresolved FROM members GROUP BY ALL),
hseg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, fallback_page) - 1 AS ordinal, contains(origins, ',') AS mixed FROM h3 WHERE any_text OR seg_no > 0),
hsegments AS (SELECT *, printf('p%06d-s%06d', first_page, ordinal) AS segment_id FROM hseg),
assigned AS (SELECT m.doc_id, m.element_id, s.segment_id, m.kind, m.origin, m.norm_text, m.page_no, m.ord FROM members m LEFT JOIN hsegments s ON s.doc_id = m.doc_id AND s.seg_no = m.seg_no AND s.fallback_page = m.fallback_page)"""
)

_COUNTS = """count(*) AS elements, count(*) FILTER (WHERE origin = 'Native') AS native, count(*) FILTER (WHERE origin = 'Ocr') AS ocr, count(*) FILTER (WHERE origin IN ('Native', 'Ocr')) AS authoritative,
  count(*) FILTER (WHERE kind = 'Heading') AS headings, count(*) FILTER (WHERE kind = 'Caption') AS captions, count(*) FILTER (WHERE kind = 'Visual') AS visuals, count(*) FILTER (WHERE kind = 'UnresolvedText') AS unresolved,
  count(*) FILTER (WHERE kind = 'Deferred') AS deferred, coalesce(sum(length(norm_text)), 0)::BIGINT AS chars, count(*) FILTER (WHERE origin = 'Native') > 0 AND count(*) FILTER (WHERE origin = 'Ocr') > 0 AS mixed"""
QUALITY = HYBRID + f""",
squality AS (SELECT doc_id, segment_id, {_COUNTS} FROM assigned WHERE segment_id IS NOT NULL GROUP BY doc_id, segment_id)"""


@register("assembled_elements", "WITH " + ELEMENTS + " SELECT doc_id, page_no, ord, kind, text, origin, obs_seq, decision, exclusion FROM elements")
def assembled_elements(spark, sf_dir):
    """H1, H2, H5-H7, B7."""
    out = elements(spark, sf_dir).withColumnRenamed("order", "ord")
    return _long(out, "page_no", "ord", "obs_seq").select("doc_id", "page_no", "ord", "kind", "text", "origin", "obs_seq", "decision", "exclusion")


@register(
    "assembly_violations",
    "WITH " + ev.BLOCKS + pq.PAIRS + """,
els AS (SELECT doc_id, page_no, (obs_seq * 3) % 7 AS ord, obs_seq // 2 AS obs_seq FROM layout),
ranges AS (SELECT doc_id, page_no, block_seq, obs_seq AS element, first_word, last_word, max(last_word) OVER (PARTITION BY doc_id, page_no, block_seq ORDER BY first_word, last_word, obs_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sofar FROM hits)
SELECT doc_id, page_no, 'duplicate-order' AS rule, ord AS detail FROM els GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT doc_id, page_no, 'duplicate-layout', obs_seq FROM els GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT DISTINCT doc_id, page_no, 'overlapping-words', block_seq FROM ranges WHERE first_word <= sofar""",
)
def assembly_violations(spark, sf_dir):
    """H3: on elements numbered so that some clash."""
    layout = pq.layout(spark, sf_dir)
    found = layout.select("doc_id", "page_no", ((F.col("obs_seq") * 3) % 7).alias("order"), F.floor(F.col("obs_seq") / 2).alias("obs_seq"))
    ranges = pq.native_extents(spark, sf_dir).withColumnRenamed("obs_seq", "element")
    return _long(assemble.assembly_violations(found, ranges), "page_no")


@register("repeated_pages", "WITH " + ev.BLOCKS + " SELECT doc_id, page_no, count(*) AS times FROM (SELECT DISTINCT doc_id, (page_no + 1) // 2 AS page_no, page_no AS p FROM blocks) GROUP BY doc_id, page_no HAVING count(*) > 1")
def repeated_pages(spark, sf_dir):
    """H4: with every two pages given one number."""
    pages = ev.blocks(spark, sf_dir).select("doc_id", F.expr("cast((page_no + 1) div 2 as bigint)").alias("page_no"), F.col("page_no").alias("p")).distinct()
    return assemble.repeated_pages(pages)


@register(
    "blocks_beside_visuals",
    "WITH " + ev.BLOCKS + pq.VISUALS.split(",\nstructural")[0] + """,
ranked AS (SELECT *, 3 * visual_idx + 1 AS ro, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY 3 * visual_idx + 1, visual_idx) - 1 AS vr FROM visuals),
bands AS (SELECT n.doc_id, n.page_no, n.block_seq, count(*) FILTER (WHERE CASE WHEN n.block_seq % 2 = 0 THEN n.block_seq > v.ro ELSE (n.t + n.b) / 2 >= v.b END) AS band
  FROM blocks n LEFT JOIN ranked v ON v.doc_id = n.doc_id AND v.page_no = n.page_no GROUP BY ALL),
rows_ AS (SELECT doc_id, page_no, band, 0 AS v, block_seq AS seq, 'Text' AS kind FROM bands UNION ALL SELECT doc_id, page_no, vr, 1, visual_idx, 'Visual' FROM ranked)
SELECT doc_id, page_no, band, seq, kind, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY band, v, seq) - 1 AS ord FROM rows_""",
)
def blocks_beside_visuals(spark, sf_dir):
    """H8: even blocks are paired with a box of their own number, odd ones aren't."""
    blocks = ev.blocks(spark, sf_dir)
    visuals = plaintext.visuals(blocks).withColumn("reading_order", F.col("visual_idx") * 3 + 1)
    targets = blocks.filter("block_seq % 2 = 0").select("doc_id", "page_no", "block_seq", F.col("block_seq").alias("reading_order"))
    out = assemble.place_beside_visuals(blocks, visuals, targets).withColumnRenamed("order", "ord")
    return _long(out, "page_no", "band", "seq", "ord").select("doc_id", "page_no", "band", "seq", "kind", "ord")


@ev.shared
def members(spark, sf_dir):
    """Numbered elements, from which segments and their assignment both follow."""
    found = assemble.segment_members(elements(spark, sf_dir), ev.HINTS)
    return found.select("doc_id", "page_no", "order", "kind", "origin", "norm_text", "is_heading", "seg_no", "fallback_page")


def hybrid(spark, sf_dir):
    found = members(spark, sf_dir)
    return assemble.segments_of_members(found), found


def assigned(spark, sf_dir):
    segments, members = hybrid(spark, sf_dir)
    return segments, provenance.assign_segments(members, segments)


@register("hybrid_segments", "WITH " + HYBRID + " SELECT doc_id, ordinal, segment_id, first_page, last_page, members, text, heading_text, origins, mixed, visual_members, has_unresolved FROM hsegments")
def hybrid_segments(spark, sf_dir):
    """I9 and I10."""
    out = _long(hybrid(spark, sf_dir)[0], "ordinal", "first_page", "last_page")
    return out.select("doc_id", "ordinal", "segment_id", "first_page", "last_page", "members", "text", "heading_text", "origins", "mixed", "visual_members", "has_unresolved")


@register(
    "element_provenance",
    "WITH " + ELEMENTS + """ SELECT doc_id, printf('p%06d-e%06d', page_no, ord) AS element_id, kind, origin, sha256(text) AS source_sha256, sha256(norm_text) AS norm_sha256, decision,
    coalesce(decision IN ('HealthyNativePreferred', 'Conflict'), false) AS divergence, coalesce(text <> norm_text, false) AS changed, exclusion FROM elements""",
)
def element_provenance(spark, sf_dir):
    """K1 and K6."""
    return provenance.element_provenance(elements(spark, sf_dir))


@register("segment_provenance", "WITH " + HYBRID + " SELECT doc_id, segment_id, ordinal, first_page, last_page, sha256(text) AS text_sha256, origins, mixed, has_unresolved FROM hsegments")
def segment_provenance(spark, sf_dir):
    """K2."""
    return _long(provenance.segment_provenance(hybrid(spark, sf_dir)[0]), "ordinal", "first_page", "last_page")


@register("segment_assignment", "WITH " + HYBRID + " SELECT doc_id, element_id, segment_id FROM assigned")
def segment_assignment(spark, sf_dir):
    """K3."""
    return assigned(spark, sf_dir)[1].select("doc_id", "element_id", "segment_id")


@register(
    "processing_manifest",
    "WITH " + ev.BLOCKS + " SELECT doc_id, string_agg(DISTINCT font, ',' ORDER BY font) AS backends, coalesce(string_agg(DISTINCT 'profile-' || (line_no % 3)::VARCHAR, ',' ORDER BY 'profile-' || (line_no % 3)::VARCHAR) FILTER (WHERE line_no % 2 = 1), '') AS profiles FROM blocks GROUP BY doc_id",
)
def processing_manifest(spark, sf_dir):
    """K4: fonts stand for backends."""
    used = ev.blocks(spark, sf_dir).select("doc_id", F.col("font").alias("backend"), F.when(F.col("line_no") % 2 == 1, F.concat(F.lit("profile-"), (F.col("line_no") % 3).cast("string"))).alias("profile"))
    return provenance.manifest(used)


@register(
    "evidence_gaps",
    "WITH " + ev.BLOCKS + """, e AS (SELECT doc_id, printf('p%06d-e%06d', page_no, block_seq) AS element_id, line_no FROM blocks),
    x AS (SELECT doc_id, element_id FROM e WHERE line_no % 5 <> 2), y AS (SELECT doc_id, element_id FROM e WHERE line_no % 7 <> 3)
    SELECT *, 'element-without-evidence' AS rule FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 'evidence-without-element' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""",
)
def evidence_gaps(spark, sf_dir):
    """K5."""
    named = ev.blocks(spark, sf_dir).select("doc_id", provenance.element_id(F.col("page_no"), F.col("block_seq")).alias("element_id"), F.lit("Text").alias("kind"), "line_no")
    return provenance.evidence_gaps(named.filter("line_no % 5 <> 2"), named.filter("line_no % 7 <> 3"))


@register(
    "element_quality",
    "WITH " + ELEMENTS + """,
    conf AS (SELECT doc_id, page_no, obs_seq, count(*) AS readings, min(confidence) AS least, round_even(sum(confidence) / count(*), 6) AS mean, max(confidence) AS most FROM ocr GROUP BY ALL)
    SELECT e.doc_id, printf('p%06d-e%06d', e.page_no, ord) AS element_id, kind, origin, length(norm_text) AS chars, exclusion IS NOT NULL AS excluded, CASE WHEN origin = 'Ocr' THEN readings END AS readings,
    CASE WHEN origin = 'Ocr' THEN least END AS least, CASE WHEN origin = 'Ocr' THEN mean END AS mean, CASE WHEN origin = 'Ocr' THEN most END AS most
    FROM elements e LEFT JOIN conf c ON c.doc_id = e.doc_id AND c.page_no = e.page_no AND c.obs_seq = e.obs_seq""",
)
def element_quality(spark, sf_dir):
    """L1 and L2."""
    return provenance.element_quality(elements(spark, sf_dir), plaintext.recognised(ev.blocks(spark, sf_dir)))


@register("segment_quality", "WITH " + QUALITY + " SELECT * FROM squality")
def segment_quality(spark, sf_dir):
    """L3."""
    return provenance.segment_quality(assigned(spark, sf_dir)[1])


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("elements", "native", "ocr", "authoritative", "headings", "captions", "visuals", "unresolved", "deferred", "chars"))


@register("document_quality", "WITH " + QUALITY + f" SELECT doc_id, count(*) AS segments, count(*) FILTER (WHERE mixed) AS mixed_segments, count(*) FILTER (WHERE unresolved + deferred > 0) AS unresolved_segments, {_SUMS} FROM squality GROUP BY doc_id")
def document_quality(spark, sf_dir):
    """L4."""
    return provenance.document_quality(segment_quality(spark, sf_dir))


@register(
    "quality_mismatches",
    "WITH " + ev.PAGES + """, a AS (SELECT doc_id, page_no, word_count FROM assessed WHERE page_no % 5 <> 4), z AS (SELECT doc_id, page_no, words AS word_count FROM assessed WHERE doc_id % 6 <> 5)
    SELECT coalesce(a.doc_id, z.doc_id) AS doc_id, coalesce(a.page_no, z.page_no) AS page_no, CASE WHEN a.doc_id IS NULL THEN 'second-only' WHEN z.doc_id IS NULL THEN 'first-only' ELSE 'differs' END AS rule
    FROM a FULL JOIN z ON a.doc_id = z.doc_id AND a.page_no = z.page_no WHERE a.doc_id IS NULL OR z.doc_id IS NULL OR a.word_count <> z.word_count""",
)
def quality_mismatches(spark, sf_dir):
    """Declared against counted words of pages."""
    pages = _long(ev.pages(spark, sf_dir), "page_no")
    a, b = pages.filter("page_no % 5 <> 4").select("doc_id", "page_no", "word_count"), pages.filter("doc_id % 6 <> 5").select("doc_id", "page_no", F.col("words").alias("word_count"))
    return provenance.quality_mismatches(a, b, ["doc_id", "page_no"], ["word_count"])


@register("page_results", "WITH " + ELEMENTS + " SELECT doc_id, page_no, string_agg(printf('p%06d-e%06d', page_no, ord), ',' ORDER BY ord) AS element_ids, count(*) AS elements FROM elements GROUP BY doc_id, page_no")
def page_results(spark, sf_dir):
    """M1."""
    return _long(provenance.page_results(elements(spark, sf_dir)), "page_no")


@register(
    "portable_elements",
    "WITH " + ELEMENTS + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, ord) - 1 AS ordinal, printf('p%06d-e%06d', page_no, ord) AS element_id, kind, norm_text AS text,
    CASE WHEN kind = 'Visual' THEN printf('p%06d-e%06d', page_no, ord) || ':preserved-visual' END AS asset_id FROM elements""",
)
def portable_elements(spark, sf_dir):
    """M2."""
    return provenance.portable_elements(elements(spark, sf_dir))


_NAMED = ", e AS (SELECT doc_id, line_no, printf('p%06d-e%06d', page_no, block_seq // (1 + doc_id % 2)) AS element_id, line_no + CASE WHEN line_no >= 5 AND doc_id % 4 = 1 THEN 1 ELSE 0 END AS ordinal FROM blocks)"


@register(
    "identity_violations",
    "WITH " + ev.BLOCKS + _NAMED + """ SELECT doc_id, 'repeated-id' AS rule, element_id AS detail FROM e GROUP BY doc_id, element_id HAVING count(*) > 1 UNION ALL
    SELECT doc_id, 'gap-in-ordinals', element_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, element_id) - 1 AS expected FROM e) WHERE ordinal <> expected""",
)
def identity_violations(spark, sf_dir):
    """M3: on elements with some ids repeated and some ordinals left out."""
    order = F.expr("block_seq div (1 + doc_id % 2)")
    named = ev.blocks(spark, sf_dir).select("doc_id", provenance.element_id(F.col("page_no"), order).alias("element_id"), (F.col("line_no") + ((F.col("line_no") >= 5) & (F.col("doc_id") % 4 == 1)).cast("int")).cast("long").alias("ordinal"))
    return provenance.identity_violations(named)


@register(
    "membership_violations",
    "WITH " + ev.BLOCKS + """, e AS (SELECT doc_id, 's' || page_no::VARCHAR AS segment_id, 'e' || line_no::VARCHAR AS element_id, line_no FROM blocks),
    h AS (SELECT doc_id, segment_id, element_id FROM e WHERE line_no % 6 <> 4), s AS (SELECT doc_id, segment_id, element_id FROM e WHERE line_no % 4 <> 1)
    SELECT *, 'not-listed' AS rule FROM (SELECT * FROM h EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'not-held' FROM (SELECT * FROM s EXCEPT SELECT * FROM h)""",
)
def membership_violations(spark, sf_dir):
    """M4."""
    named = ev.blocks(spark, sf_dir).select("doc_id", F.concat(F.lit("s"), F.col("page_no").cast("string")).alias("segment_id"), F.concat(F.lit("e"), F.col("line_no").cast("string")).alias("element_id"), "line_no")
    listed = named.filter("line_no % 4 <> 1").groupBy("doc_id", "segment_id").agg(F.collect_list("element_id").alias("member_ids"))
    return provenance.membership_violations(named.filter("line_no % 6 <> 4"), listed)


@register(
    "evidence_violations",
    "WITH " + ev.BLOCKS + """, e AS (SELECT doc_id, 'e' || line_no::VARCHAR AS element_id, line_no AS n FROM blocks)
    SELECT doc_id, element_id, 'layout-without-raster' AS rule FROM e WHERE n % 2 = 0 AND n % 3 = 0 UNION ALL SELECT doc_id, element_id, 'ocr-not-in-manifest' FROM e WHERE n % 4 = 1 AND n % 5 = 0 UNION ALL
    SELECT doc_id, element_id, 'reconciled-without-identity' FROM e WHERE n % 3 = 2 AND n % 7 = 0 UNION ALL SELECT doc_id, element_id, 'changed-flag' FROM e WHERE (n % 5 = 1) <> (n % 4 = 0)""",
)
def evidence_violations(spark, sf_dir):
    """M5."""
    n = F.col("line_no")
    rows = ev.blocks_as_they_lie(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("e"), n.cast("string")).alias("element_id"), (n % 2 == 0).alias("has_layout"), (n % 3 != 0).alias("has_raster"), F.when(n % 4 == 1, "Ocr").otherwise("Native").alias("origin"), (n % 5 != 0).alias("ocr_in_manifest"),
        F.when(n % 3 == 2, "Agreement").alias("decision"), (n % 7 != 0).alias("has_reconciler"), (n % 5 == 1).alias("changed"), F.lit("a").alias("source_sha256"), F.when(n % 4 == 0, "b").otherwise("a").alias("norm_sha256"),
    )
    return provenance.evidence_violations(rows)


@register(
    "segment_evidence_violations",
    "WITH " + HYBRID + """, claimed AS (SELECT doc_id, segment_id, CASE WHEN ordinal % 3 = 1 THEN 'Native' ELSE origins END AS origins, CASE WHEN ordinal % 4 = 2 THEN false ELSE has_unresolved END AS has_unresolved, origins AS o, has_unresolved AS u FROM hsegments)
    SELECT doc_id, segment_id, 'origins' AS rule FROM claimed WHERE origins <> o UNION ALL SELECT doc_id, segment_id, 'unresolved' FROM claimed WHERE has_unresolved <> u""",
)
def segment_evidence_violations(spark, sf_dir):
    """M6: on segments with some claims changed."""
    segments, rows = assigned(spark, sf_dir)
    claimed = segments.withColumns({"origins": F.when(F.col("ordinal") % 3 == 1, "Native").otherwise(F.col("origins")), "has_unresolved": F.when(F.col("ordinal") % 4 == 2, False).otherwise(F.col("has_unresolved"))})
    return provenance.segment_evidence_violations(claimed, rows)


@register(
    "asset_violations",
    "WITH " + ev.BLOCKS + """, e AS (SELECT doc_id, 'e' || line_no::VARCHAR || ':preserved-visual' AS asset_id, line_no AS n FROM blocks WHERE line_no % 3 = 0), a AS (SELECT * FROM e WHERE n % 2 = 0),
    v AS (SELECT * FROM e WHERE n % 4 <> 2)
    SELECT doc_id, asset_id, 'visual-without-asset' AS rule FROM v WHERE n % 2 <> 0 UNION ALL SELECT doc_id, asset_id, 'asset-without-visual' FROM a WHERE n % 4 = 2 UNION ALL
    SELECT doc_id, asset_id, 'empty' FROM a WHERE n % 5 = 0 UNION ALL SELECT doc_id, asset_id, 'digest' FROM a WHERE n % 8 = 0""",
)
def asset_violations(spark, sf_dir):
    """M7."""
    n = F.col("line_no")
    base = ev.blocks(spark, sf_dir).filter("line_no % 3 = 0").select("doc_id", provenance.asset_id(F.concat(F.lit("e"), n.cast("string"))).alias("asset_id"), "line_no", F.lit("Visual").alias("kind"))
    assets = base.filter("line_no % 2 = 0").select("doc_id", "asset_id", (n % 5).alias("byte_length"), F.when(n % 8 == 0, "ABC").otherwise(F.sha2(n.cast("string"), 256)).alias("sha256"))
    return provenance.asset_violations(base.filter("line_no % 4 <> 2"), assets)


@register(
    "outcomes",
    "WITH " + ev.BLOCKS + _NAMED + """, v AS (SELECT doc_id, 'repeated-id' AS rule FROM e GROUP BY doc_id, element_id HAVING count(*) > 1 UNION ALL
    SELECT doc_id, 'gap-in-ordinals' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, element_id) - 1 AS expected FROM e) WHERE ordinal <> expected), f AS (SELECT doc_id, min(rule) AS error, count(*) AS violations FROM v GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN error IS NULL THEN 'Succeeded' ELSE 'Failed' END AS status, error, coalesce(violations, 0) AS violations FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
)
def outcomes(spark, sf_dir):
    """M8."""
    return provenance.outcomes(ev.documents(spark, sf_dir), identity_violations(spark, sf_dir))


@register("result_json_round_trip", "WITH " + ELEMENTS + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, ord) - 1 AS ordinal, printf('p%06d-e%06d', page_no, ord) AS element_id, kind, norm_text AS text FROM elements")
def result_json_round_trip(spark, sf_dir):
    """Written as JSON and read again."""
    return provenance.from_result_json(provenance.to_result_json(portable_elements(spark, sf_dir)))
