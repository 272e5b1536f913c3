"""Queries over dual runs, evaluation and benchmark measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.functions import measures
from quirework.operators import assess, dualrun, evaluate
from quirework.plans import evidence as ev
from quirework.plans import page_queries as pq
from quirework.plans import result_queries as rq
from quirework.plans import text_queries as tq
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


# --- dual run -----------------------------------------------------------------------------------


@register(
    "sampled_documents",
    "SELECT doc_id, (('0x' || substr(sha256(text), 1, 16))::UBIGINT % 10000)::BIGINT AS bucket, (('0x' || substr(sha256(text), 1, 16))::UBIGINT % 10000) < 2500 AS selected FROM documents",
)
def sampled_documents(spark, sf_dir):
    """The feature is a stable sample."""
    docs = ev.documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"))
    return dualrun.select_profile(docs, "Sampled", 2500).select("doc_id", "bucket", "selected")


_COMPARED = tq._PLANS + """,
cand AS (SELECT *, CASE WHEN (doc_id + page_no) % 3 = 0 THEN 'NativeText' ELSE mode END AS cmode, analysis OR page_no % 4 = 1 AS cvisual FROM plans),
compared AS (SELECT doc_id, page_no, mode = cmode AS agrees, mode <> 'NativeText' AND NOT (cmode <> 'NativeText') AS removes_text_work, cvisual AND NOT analysis AS adds_visual_work FROM cand)"""


def _compared(spark, sf_dir):
    pages = assess.assess_pages(ev.pages(spark, sf_dir))
    plans = assess.compile_plans(pages, tq._visuals(pages)).select("doc_id", "page_no", "mode", "requires_ocr", F.col("analyze").alias("visual_work"))
    mode = F.when((F.col("doc_id") + F.col("page_no")) % 3 == 0, "NativeText").otherwise(F.col("mode"))
    candidate = plans.select("doc_id", "page_no", mode.alias("mode"), (mode != "NativeText").alias("requires_ocr"), (F.col("visual_work") | (F.col("page_no") % 4 == 1)).alias("visual_work"))
    return dualrun.compare_plans(plans, candidate)


@register("plan_comparison", "WITH " + _COMPARED + " SELECT * FROM compared")
def plan_comparison(spark, sf_dir):
    """N2."""
    return _long(_compared(spark, sf_dir), "page_no")


@register(
    "planning_report",
    "WITH " + _COMPARED + """ SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE agrees) AS agreeing, count(*) FILTER (WHERE removes_text_work) AS removing, count(*) FILTER (WHERE adds_visual_work) AS adding,
    bool_and(agrees) AS all_agree FROM compared GROUP BY doc_id""",
)
def planning_report(spark, sf_dir):
    """N3."""
    return dualrun.planning_report(_compared(spark, sf_dir))


@register(
    "candidate_report",
    "WITH " + ev.BLOCKS + """, c AS (SELECT doc_id, page_no, block_seq, CASE WHEN line_no % 5 = 1 THEN text || '.' ELSE text END AS text, CASE WHEN line_no % 7 = 2 THEN 'Ocr' ELSE 'Native' END AS origin FROM blocks WHERE line_no % 11 <> 4),
    j AS (SELECT b.doc_id, c.doc_id IS NOT NULL AND b.text = c.text AS st, c.doc_id IS NOT NULL AND b.text = c.text AND c.origin = 'Native' AS sp FROM blocks b LEFT JOIN c ON c.doc_id = b.doc_id AND c.page_no = b.page_no AND c.block_seq = b.block_seq)
    SELECT doc_id, count(*) AS elements, count(*) FILTER (WHERE st) AS same_text, count(*) FILTER (WHERE sp) AS same_projection, bool_and(st) AS text_exact, bool_and(sp) AS projection_exact FROM j GROUP BY doc_id""",
)
def candidate_report(spark, sf_dir):
    """A candidate with changed, missing and differently sourced texts."""
    a = ev.blocks(spark, sf_dir).select("doc_id", "page_no", F.col("block_seq").alias("order"), "text", F.lit("Native").alias("origin"), "line_no")
    c = a.filter("line_no % 11 <> 4").withColumns({"text": F.when(F.col("line_no") % 5 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")), "origin": F.when(F.col("line_no") % 7 == 2, "Ocr").otherwise("Native")})
    return dualrun.candidate_report(dualrun.compare_texts(a.drop("line_no"), c.drop("line_no"), ["text", "origin"]))


def _le(x: str) -> str:
    """Four little-endian bytes of a number, in hexadecimal."""
    h = f"printf('%08x', {x})"
    return f"substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2)"


_SEQUENCE = measures.TEXT_SEQUENCE.encode().hex()


@register(
    "text_sequence_fingerprints",
    "WITH " + rq.ELEMENTS + f""", own AS (SELECT doc_id, page_no, ord, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM elements WHERE text IS NOT NULL AND origin IN ('Native', 'Ocr'))
    SELECT doc_id, sha256(unhex({_le(str(len(measures.TEXT_SEQUENCE)))} || '{_SEQUENCE}' || {_le("count(*)")} || string_agg({_le("n")} || h, '' ORDER BY page_no, ord))) AS text_fingerprint FROM own GROUP BY doc_id""",
)
def text_sequence_fingerprints(spark, sf_dir):
    """The selected texts in order."""
    return element_fingerprints(spark, sf_dir).select("doc_id", "text_fingerprint")


@register("element_fingerprints")
def element_fingerprints(spark, sf_dir):
    """The bits of numbers have no SQL form; tests hold them against struct.pack."""
    boxes = rq.elements(spark, sf_dir).withColumns({"l": F.lit(0.0), "r": F.lit(1.0)})
    return dualrun.fingerprints(boxes)


@register(
    "candidate_elements",
    "WITH " + pq.RECONCILED + tq._PLANS.removeprefix(ev.PAGES) + """,
    ran AS (SELECT doc_id, page_no FROM plans WHERE (mode, status) IN (('TargetedOcrRecovery', 'Missing'), ('TargetedOcrVerification', 'Unverified'), ('TargetedOcrReconciliation', 'Suspicious')))
    SELECT r.doc_id, r.page_no, reading_order AS ord, CASE WHEN selected_text IS NULL THEN 'UnresolvedText' WHEN kind = 'Heading' THEN 'Heading' WHEN kind = 'Caption' THEN 'Caption' ELSE 'Text' END AS kind, selected_text AS text, origin, obs_seq
      FROM rec r JOIN ran USING (doc_id, page_no)
    UNION ALL SELECT l.doc_id, l.page_no, reading_order, 'Deferred', NULL, 'None', obs_seq FROM layout l JOIN ran USING (doc_id, page_no) WHERE kind NOT IN ('Text', 'Heading', 'Caption', 'Table', 'Figure')""",
)
def candidate_elements(spark, sf_dir):
    """N9."""
    pages = assess.assess_pages(ev.pages(spark, sf_dir))
    plans = assess.compile_plans(pages, tq._visuals(pages)).select("doc_id", "page_no", "mode", "status")
    out = dualrun.candidate_elements(dualrun.candidate_pages(plans), pq.reconciled(spark, sf_dir), pq.layout(spark, sf_dir))
    return _long(out.withColumnRenamed("order", "ord"), "page_no", "ord", "obs_seq").select("doc_id", "page_no", "ord", "kind", "text", "origin", "obs_seq")


@register(
    "candidate_page_outcomes",
    "WITH " + tq._PLANS + """ SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 6 = 1 THEN 'TargetedOcrRecovery' ELSE mode END AS mode, status,
    CASE WHEN (CASE WHEN (doc_id + page_no) % 6 = 1 THEN 'TargetedOcrRecovery' ELSE mode END, status) IN (('TargetedOcrRecovery', 'Missing'), ('TargetedOcrVerification', 'Unverified'), ('TargetedOcrReconciliation', 'Suspicious'))
      THEN 'Completed' ELSE 'Failed' END AS outcome FROM plans WHERE (doc_id + page_no) % 6 = 1 OR mode <> 'NativeText'""",
)
def candidate_page_outcomes(spark, sf_dir):
    """Some pages are given a mode that isn't theirs."""
    pages = assess.assess_pages(ev.pages(spark, sf_dir))
    plans = assess.compile_plans(pages, tq._visuals(pages)).select("doc_id", "page_no", "mode", "status")
    wrong = F.when((F.col("doc_id") + F.col("page_no")) % 6 == 1, "TargetedOcrRecovery").otherwise(F.col("mode"))
    return _long(dualrun.candidate_pages(plans.withColumn("mode", wrong)), "page_no")


@register(
    "planning_outcomes",
    "WITH " + ev.BLOCKS + """, p AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM blocks GROUP BY doc_id), d AS (SELECT *, doc_id % 13 <> 5 AS supported, n + (doc_id % 10 = 3)::INT AS a, n + (doc_id % 9 = 2)::INT AS c,
      CASE WHEN doc_id % 7 = 1 THEN 'StructuralEnrichment' WHEN doc_id % 7 = 4 THEN 'NativeNormalization' END AS told FROM p),
    f AS (SELECT *, CASE WHEN a <> n THEN 'Capability' WHEN told IS NOT NULL THEN told WHEN c <> n THEN 'CandidatePlanning' END AS stage FROM d)
    SELECT doc_id, CASE WHEN NOT supported THEN 'UnsupportedFormat' WHEN stage IS NOT NULL THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN supported THEN stage END AS stage,
      CASE WHEN supported THEN CASE WHEN a <> n THEN a::VARCHAR || ' of ' || n::VARCHAR || ' pages' WHEN told IS NOT NULL THEN 'raised' WHEN c <> n THEN c::VARCHAR || ' of ' || n::VARCHAR || ' pages' END END AS message FROM f""",
)
def planning_outcomes(spark, sf_dir):
    """Documents with stages that fail and plans that don't cover their pages."""
    d = F.col("doc_id")
    docs = ev.blocks(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    docs = docs.withColumns({"supported": d % 13 != 5, "authoritative": F.col("pages") + (d % 10 == 3).cast("int"), "candidate": F.col("pages") + (d % 9 == 2).cast("int")})
    stage = F.when(d % 7 == 1, "StructuralEnrichment").when(d % 7 == 4, "NativeNormalization")
    failures = docs.select("doc_id", stage.alias("stage"), F.lit("raised").alias("message")).filter("stage is not null")
    return dualrun.planning_outcomes(docs, failures)


# --- error rates ------------------------------------------------------------------------------

def _joined(x: str) -> str:
    return f"regexp_replace({x}, '(\\p{{L}})-[\\t\\n\\x0B\\f\\r\\x85\\p{{Z}}]*\\n[\\t\\n\\x0B\\f\\r\\x85\\p{{Z}}]*(\\p{{L}})', '\\1\\2', 'g')"


def _CER(x: str) -> str:
    """Two passes join what a lookaround joins in one."""
    signs = evaluate.APOSTROPHES + evaluate.QUOTES + evaluate.DASHES
    plain = "''" * 3 + '"' * 2 + "-" * 6
    folded = f"translate(replace({_joined(_joined(f'nfc_normalize({x})'))}, chr(173), ''), chr(160) || 'Σ{signs}', ' σ{plain}')"
    return f"trim(regexp_replace(lower({folded}), '[\\t\\n\\x0B\\f\\r\\x85\\p{{Z}}]+', ' ', 'g'))"


_RATES = "bench AS (SELECT item_id, text AS reference, replace(replace(replace(text, 'th', 'tb'), ', ', '-' || chr(10)), ' of ', ' Of — ') AS recognised FROM benchmark UNION ALL SELECT -1 - item_id, '', text FROM benchmark)"


def _bench_pairs(spark, sf_dir):
    ev.ship(spark)
    bad = F.replace(F.replace(F.replace("text", F.lit("th"), F.lit("tb")), F.lit(", "), F.lit("-\n")), F.lit(" of "), F.lit(" Of — "))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # and each text read where there is none
    empty = items.select((-1 - F.col("item_id")).alias("item_id"), F.lit("").alias("reference"), F.col("text").alias("recognised"))
    return items.select("item_id", F.col("text").alias("reference"), bad.alias("recognised")).unionByName(empty)


@register(
    "character_error_rate",
    "WITH " + _RATES + ", c AS (SELECT item_id, " + _CER("reference") + " AS a, " + _CER("recognised") + " AS b FROM bench) SELECT item_id, CASE WHEN a = '' THEN length(b) ELSE levenshtein(a, b) END::BIGINT AS char_edits, length(a) AS chars, CASE WHEN length(a) > 0 THEN round_even(levenshtein(a, b)::DOUBLE / length(a), 6) ELSE 0e0 END AS cer FROM c",
)
def character_error_rate(spark, sf_dir):
    """O27 and O29."""
    return evaluate.error_rates(_bench_pairs(spark, sf_dir)).select("item_id", "char_edits", "chars", "cer")


@register("word_error_rate")
def word_error_rate(spark, sf_dir):
    """Word edits have no SQL form; tests hold them against brute force."""
    return evaluate.error_rates(_bench_pairs(spark, sf_dir)).select("item_id", "word_edits", "words", "wer")


@register("strict_error_rates")
def strict_error_rates(spark, sf_dir):
    """As O29 and O30 with case and white-space words."""
    return evaluate.strict_error_rates(_bench_pairs(spark, sf_dir)).select("item_id", "char_edits", "chars", "word_edits", "words", "cer", "wer")


@register(
    "micro_averaged_cer",
    "WITH " + _RATES + ", c AS (SELECT item_id, " + _CER("reference") + " AS a, " + _CER("recognised") + " AS b FROM bench) SELECT abs(item_id) % 4 AS bucket, sum(e)::BIGINT AS char_edits, sum(length(a))::BIGINT AS chars, CASE WHEN sum(length(a)) > 0 THEN sum(e)::DOUBLE / sum(length(a)) ELSE 0e0 END AS cer FROM (SELECT *, CASE WHEN a = '' THEN length(b) ELSE levenshtein(a, b) END AS e FROM c) GROUP BY 1",
)
def micro_averaged_cer(spark, sf_dir):
    """P7."""
    rates = evaluate.error_rates(_bench_pairs(spark, sf_dir)).withColumn("bucket", F.abs("item_id") % 4)
    return evaluate.micro_average(rates, "bucket").select("bucket", "char_edits", "chars", "cer")


_ZONES = """, zones AS (SELECT DISTINCT doc_id, page_no, i AS zone_id, 0e0 AS l, i * 375e-3 AS t, 1e0 AS r, i * 375e-3 + 5e-1 AS b FROM blocks, range(0, 2) AS x(i)),
inz AS (SELECT g.doc_id, g.page_no, g.block_seq AS seq, g.text, z.zone_id FROM blocks g JOIN zones z ON g.doc_id = z.doc_id AND g.page_no = z.page_no AND (g.l + g.r) / 2 BETWEEN z.l AND z.r AND (g.t + g.b) / 2 BETWEEN z.t AND z.b)"""


def _zones(blocks):
    pages = blocks.select("doc_id", "page_no").distinct().withColumn("zone_id", F.explode(F.array(F.lit(0), F.lit(1))))
    top = F.col("zone_id") * F.lit(0.375)
    return pages.select("doc_id", "page_no", "zone_id", F.lit(0.0).alias("l"), top.alias("t"), F.lit(1.0).alias("r"), (top + 0.5).alias("b"))


@register(
    "zone_texts",
    "WITH " + ev.BLOCKS + _ZONES + " SELECT z.doc_id, z.page_no, z.zone_id, coalesce((SELECT string_agg(text, chr(10) ORDER BY seq) FROM inz i WHERE i.doc_id = z.doc_id AND i.page_no = z.page_no AND i.zone_id = z.zone_id), '') AS text FROM zones z",
)
def zone_texts(spark, sf_dir):
    """Two zones a page that overlap."""
    blocks = ev.blocks(spark, sf_dir)
    return _long(evaluate.zone_texts(_zones(blocks), blocks.withColumn("seq", F.col("block_seq"))), "page_no", "zone_id")


@register(
    "region_zones",
    "WITH " + ev.BLOCKS + _ZONES + """ SELECT b.doc_id, b.page_no, b.block_seq AS seq, count(zone_id) AS zones, min(zone_id) AS zone_id, CASE count(zone_id) WHEN 0 THEN 'outside' WHEN 1 THEN 'inside' ELSE 'ambiguous' END AS status
    FROM blocks b LEFT JOIN inz i ON i.doc_id = b.doc_id AND i.page_no = b.page_no AND i.seq = b.block_seq GROUP BY b.doc_id, b.page_no, b.block_seq""",
)
def region_zones(spark, sf_dir):
    """P6."""
    blocks = ev.blocks(spark, sf_dir)
    return _long(evaluate.region_zones(_zones(blocks), blocks.withColumn("seq", F.col("block_seq"))), "page_no", "seq", "zone_id")


# --- outlines ---------------------------------------------------------------------------------


def _outline(spark, sf_dir):
    """A title for every third line of a document, changed in some way; parents as in a binary heap."""
    rows = ev.heading_blocks(spark, sf_dir).filter("line_no % 3 = 0")
    ordinal = (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("long")
    rows = rows.withColumn("ordinal", ordinal)
    numbered = F.concat(F.lit("Section "), F.col("ordinal").cast("string"), F.lit(" "), F.col("norm_text"))
    title = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("* "), F.lower("norm_text"))).otherwise(numbered)
    parent = F.when(F.col("ordinal") > 0, F.floor((F.col("ordinal") - 1) / 2)).cast("long")
    return rows.select("doc_id", "ordinal", parent.alias("parent_ordinal"), title.alias("title"), F.col("page_no").alias("target_page"), F.col("l").alias("left"), F.col("t").alias("top"))


_OUTLINE = ev.HEADINGS + """,
outline0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ordinal FROM headed WHERE line_no % 3 = 0),
outline AS (SELECT doc_id, ordinal, CASE WHEN ordinal > 0 THEN (ordinal - 1) // 2 END AS parent_ordinal,
  CASE WHEN line_no % 2 = 0 THEN '* ' || lower(norm_text) ELSE 'Section ' || ordinal::VARCHAR || ' ' || norm_text END AS title, page_no AS target_page, l AS lft, t AS top FROM outline0)"""


@register(
    "outline_levels",
    "WITH RECURSIVE " + _OUTLINE.strip() + """, tree AS (SELECT doc_id, ordinal, 1 AS level FROM outline WHERE parent_ordinal IS NULL UNION ALL SELECT o.doc_id, o.ordinal, t.level + 1 FROM outline o JOIN tree t ON o.doc_id = t.doc_id AND o.parent_ordinal = t.ordinal)
    SELECT doc_id, ordinal, level::BIGINT AS level FROM tree""",
)
def outline_levels(spark, sf_dir):
    """O19."""
    return evaluate.outline_levels(_outline(spark, sf_dir))


_COMPACT = lambda x: ev.upper_sql(f"regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')")


@register(
    "outline_matches",
    "WITH " + _OUTLINE + f""",
    a AS (SELECT *, {ev.upper_sql("trim(title)")} AS k0, {ev.key_sql("title")} AS k1, {_COMPACT("title")} AS k2 FROM outline), z AS (SELECT doc_id, page_no, block_seq, {ev.upper_sql("norm_text")} AS k0, {ev.key_sql("norm_text")} AS k1, {_COMPACT("norm_text")} AS k2 FROM headed),
    h AS (SELECT a.doc_id, a.ordinal, z.block_seq, CASE WHEN a.k0 = z.k0 THEN 0 WHEN a.k1 = z.k1 AND a.k1 <> '' THEN 1 ELSE 2 END AS rank FROM a JOIN z ON a.doc_id = z.doc_id AND a.target_page = z.page_no AND (a.k0 = z.k0 OR (a.k1 = z.k1 AND a.k1 <> '') OR (a.k2 = z.k2 AND a.k2 <> ''))),
    f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY rank, block_seq) = 1)
    SELECT a.doc_id, a.ordinal, f.block_seq, CASE f.rank WHEN 0 THEN 'ExactText' WHEN 1 THEN 'NormalizedText' WHEN 2 THEN 'CompactText' ELSE 'None' END AS match FROM a LEFT JOIN f ON f.doc_id = a.doc_id AND f.ordinal = a.ordinal""",
)
def outline_matches(spark, sf_dir):
    """O20."""
    return _long(evaluate.match_outline(_outline(spark, sf_dir), ev.heading_blocks(spark, sf_dir)), "block_seq")


_TOKENS = lambda x: f"list_distinct(list_filter(regexp_extract_all({ev.upper_sql(x)}, '[\\p{{L}}\\p{{Nd}}]+'), lambda q: length(q) >= 2))"


@register(
    "lexical_candidates",
    "WITH " + _OUTLINE + f""", a AS (SELECT *, {_TOKENS("title")} AS tk FROM outline), z AS (SELECT doc_id, page_no, block_seq, is_heading, {_TOKENS("norm_text")} AS tk FROM headed),
    s AS (SELECT a.doc_id, a.ordinal, z.block_seq, z.is_heading, len(a.tk) AS n, len(list_intersect(a.tk, z.tk)) AS shared FROM a JOIN z ON a.doc_id = z.doc_id AND a.target_page = z.page_no),
    c AS (SELECT *, round_even(shared::DOUBLE / n, 3) AS coverage FROM s WHERE shared > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY coverage DESC, shared DESC, is_heading DESC, block_seq) AS rank FROM c)
    SELECT doc_id, ordinal, block_seq, shared, coverage, rank FROM r WHERE rank <= 3""",
)
def lexical_candidates(spark, sf_dir):
    """The three best blocks are the feature."""
    return _long(evaluate.lexical_candidates(_outline(spark, sf_dir), ev.heading_blocks(spark, sf_dir)), "block_seq", "rank")


_BLANK = "[\\t\\n\\x0B\\f\\r\\x85\\p{Z}]"


def _number(x: str) -> str:
    """A boundary behind the digits: anything but a word sign, or the end."""
    return f"try_cast(nullif(regexp_extract({x}, '(?i)^{_BLANK}*(?:(?:chapter|part|section|book|excursus){_BLANK}+)?([0-9]{{1,4}})(?:[^\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]|$)', 1), '') AS INTEGER)"


def _labels(x: str, y: str) -> str:
    return f"CASE WHEN {x} IS NULL AND {y} IS NULL THEN 'BothMissing' WHEN {y} IS NULL THEN 'OutlineOnly' WHEN {x} IS NULL THEN 'CandidateOnly' WHEN {x} = {y} THEN 'Same' ELSE 'Different' END"


#: Of keys ka (title) and kz (candidate), token counts na and nz, and their shared tokens.
_MEASURED = """
me AS (SELECT *, CASE WHEN least(length(ka), length(kz)) = 0 THEN 'None' WHEN ka = kz THEN 'Equal'
    WHEN least(length(ka), length(kz)) < 8 OR least(length(ka), length(kz))::DOUBLE / greatest(length(ka), length(kz)) < 2e-1 THEN 'None'
    WHEN contains(kz, ka) THEN 'OutlineWithinCandidate' WHEN contains(ka, kz) THEN 'CandidateWithinOutline' ELSE 'None' END AS containment,
  CASE WHEN na > 0 THEN round_even(shared::DOUBLE / na, 3) ELSE 0e0 END AS of_title, CASE WHEN nz > 0 THEN round_even(shared::DOUBLE / nz, 3) ELSE 0e0 END AS of_text FROM nr),
bd AS (SELECT *, CASE WHEN containment = 'Equal' THEN 'ExactEquivalent' WHEN containment <> 'None' THEN 'Containment' WHEN shared >= 3 AND of_title >= 7e-1 AND of_text >= 5e-1 THEN 'HighOverlap'
  WHEN shared >= 2 AND of_title >= 5e-1 THEN 'ModerateOverlap' ELSE 'WeakOverlap' END AS band FROM me WHERE shared > 0 OR containment <> 'None')"""
_BAND_ORDER = "list_position(['ExactEquivalent', 'Containment', 'HighOverlap', 'ModerateOverlap', 'WeakOverlap'], band)"

_ALIGN = _OUTLINE + f""",
hd AS (SELECT doc_id, page_no, block_seq, list({{'n': norm_text, 'l': l, 't': t, 'r': r, 'b': b}}) OVER (PARTITION BY doc_id, page_no ORDER BY block_seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h FROM headed),
cl0 AS (SELECT doc_id, page_no, block_seq, i AS size, h[1:i] AS h FROM hd, range(1, 4) AS q(i) WHERE i <= len(h)),
cl1 AS (SELECT doc_id, page_no, block_seq, size, array_to_string(list_transform(h, lambda x: x.n), ' ') AS cluster_text, list_min(list_transform(h, lambda x: x.l)) AS cl, list_min(list_transform(h, lambda x: x.t)) AS ct,
  list_max(list_transform(h, lambda x: x.r)) AS cr, list_max(list_transform(h, lambda x: x.b)) AS cb FROM cl0),
cl AS (SELECT *, {_TOKENS("cluster_text")} AS z, {_COMPACT("cluster_text")} AS kz, {_number("cluster_text")} AS nz_label FROM cl1),
ti AS (SELECT *, {_TOKENS("title")} AS a, {_COMPACT("title")} AS ka, {_number("title")} AS na_label FROM outline),
nr AS (SELECT ti.doc_id, ordinal, target_page, lft, top, ka, kz, na_label, nz_label, page_no, block_seq, size, cl.cl, ct, cr, cb, len(a) AS na, len(z) AS nz, len(list_intersect(a, z)) AS shared
  FROM ti JOIN cl ON ti.doc_id = cl.doc_id AND cl.page_no BETWEEN ti.target_page - 2 AND ti.target_page + 2),""" + _MEASURED + f""",
ds AS (SELECT *, {_labels("na_label", "nz_label")} AS labels,
  CASE WHEN page_no = target_page THEN round_even(CASE WHEN top < ct THEN ct - top WHEN top > cb THEN top - cb ELSE 0e0 END, 4) END AS distance,
  CASE WHEN page_no = target_page THEN round_even(sqrt(greatest(cl - lft, 0e0, lft - cr) * greatest(cl - lft, 0e0, lft - cr) + greatest(ct - top, 0e0, top - cb) * greatest(ct - top, 0e0, top - cb)), 4) END AS point FROM bd),
al AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY {_BAND_ORDER}, of_title DESC, of_text DESC, shared DESC, abs(page_no - target_page), page_no - target_page, distance NULLS LAST, size, block_seq) AS rank FROM ds)"""


@register("outline_alignment", "WITH " + _ALIGN + " SELECT doc_id, ordinal, rank, page_no, block_seq, size, band, containment, labels, shared, of_title, of_text, distance, point FROM al WHERE rank <= 5")
def outline_alignment(spark, sf_dir):
    """The five best clusters are the feature."""
    out = evaluate.align_outline(_outline(spark, sf_dir), ev.heading_blocks(spark, sf_dir))
    return _long(out, "rank", "page_no", "block_seq", "size", "shared")


@register(
    "title_matches",
    "WITH " + ev.BLOCKS + pq.OCR + f""",
rg AS (SELECT doc_id, page_no, 2 * obs_seq + text_seq AS seq, text FROM ocr),
hd AS (SELECT doc_id, page_no, row_number() OVER p - 1 AS first_region, list(text) OVER (PARTITION BY doc_id, page_no ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h FROM rg WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY seq)),
cl AS (SELECT doc_id, page_no, first_region, i AS size, array_to_string(h[1:i], ' ') AS candidate FROM hd, range(1, 4) AS q(i) WHERE i <= len(h)),
ti AS (SELECT doc_id, page_no, 'The ' || lower(text) AS title FROM blocks WHERE block_seq = 0),
nr AS (SELECT ti.doc_id, ti.page_no, first_region, size, {_COMPACT("title")} AS ka, {_COMPACT("candidate")} AS kz, len({_TOKENS("title")}) AS na, len({_TOKENS("candidate")}) AS nz, len(list_intersect({_TOKENS("title")}, {_TOKENS("candidate")})) AS shared
  FROM ti JOIN cl ON cl.doc_id = ti.doc_id AND cl.page_no = ti.page_no),""" + _MEASURED + f""",
al AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {_BAND_ORDER}, of_title DESC, of_text DESC, shared DESC, size, first_region) AS rank FROM bd)
SELECT doc_id, page_no, band, containment, first_region, size, shared, of_title, of_text FROM al WHERE rank = 1""",
)
def title_matches(spark, sf_dir):
    """A page's first line, changed, among its recognised regions."""
    blocks = ev.blocks(spark, sf_dir)
    titles = blocks.filter("block_seq = 0").select("doc_id", "page_no", F.concat(F.lit("The "), F.lower("text")).alias("title"))
    regions = plaintext.recognised(blocks).select("doc_id", "page_no", (F.col("obs_seq") * 2 + F.col("text_seq")).alias("seq"), "text")
    return _long(evaluate.match_titles(titles, regions), "page_no", "size", "shared")


@register("band_summary", "WITH " + _ALIGN + ", d AS (SELECT unnest(['ExactEquivalent', 'Containment', 'HighOverlap', 'ModerateOverlap', 'WeakOverlap', 'None']) AS band) SELECT d.band, count(al.band) AS titles FROM d LEFT JOIN al ON al.band = d.band AND al.rank = 1 GROUP BY d.band")
def band_summary(spark, sf_dir):
    """O33."""
    return evaluate.band_summary(outline_alignment(spark, sf_dir).filter("rank = 1"))


_BEFORE = """SELECT *, CASE line_no % 5 WHEN 0 THEN ' Chapter ' || (line_no // 2)::VARCHAR || ' ' WHEN 1 THEN (line_no // 2)::VARCHAR || '. ' WHEN 2 THEN '12345 ' ELSE '' END AS n,
  CASE line_no % 4 WHEN 0 THEN (line_no // 2)::VARCHAR || ' ' WHEN 1 THEN 'EXCURSUS 3: ' WHEN 2 THEN '7th ' ELSE '' END AS m FROM blocks"""


@register(
    "label_relations",
    "WITH " + ev.BLOCKS + f""", p AS (SELECT doc_id, line_no, {_number("n || text")} AS x, {_number("m || text")} AS y FROM ({_BEFORE}))
    SELECT doc_id, line_no, {_labels("x", "y")} AS relation FROM p""",
)
def label_relations(spark, sf_dir):
    """Lines with numbers of several forms put before some."""
    n, half = F.col("line_no"), F.expr("line_no div 2").cast("string")
    a = F.when(n % 5 == 0, F.concat(F.lit(" Chapter "), half, F.lit(" "))).when(n % 5 == 1, F.concat(half, F.lit(". "))).when(n % 5 == 2, F.lit("12345 ")).otherwise(F.lit(""))
    b = F.when(n % 4 == 0, F.concat(half, F.lit(" "))).when(n % 4 == 1, F.lit("EXCURSUS 3: ")).when(n % 4 == 2, F.lit("7th ")).otherwise(F.lit(""))
    return ev.blocks_as_they_lie(spark, sf_dir).select("doc_id", n.cast("long"), evaluate.label_relation(F.concat(a, "text"), F.concat(b, "text")).alias("relation"))


@register(
    "native_states",
    "WITH " + ev.PAGES + """ SELECT CASE WHEN word_count = 0 AND raster_image_count > 0 AND largest_raster_ratio >= 6e-1 THEN 'TextlessDominantRaster' WHEN word_count > 0 THEN 'NativeText' ELSE 'Other' END AS state, count(*) AS pages, sum(word_count)::BIGINT AS words FROM pages1 GROUP BY 1""",
)
def native_states(spark, sf_dir):
    """O32 and O33."""
    return evaluate.page_group_summary(ev.pages(spark, sf_dir))


@register(
    "page_set_differences",
    "WITH " + ev.PAGES + """, a AS (SELECT doc_id, page_no FROM pages1 WHERE page_no % 3 <> 2), z AS (SELECT doc_id, page_no FROM pages1 WHERE doc_id % 4 <> 1) SELECT *, 'missing' AS rule FROM (SELECT * FROM a EXCEPT SELECT * FROM z)
    UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM z EXCEPT SELECT * FROM a)""",
)
def page_set_differences(spark, sf_dir):
    """O34."""
    pages = _long(ev.pages(spark, sf_dir), "page_no")
    return evaluate.page_set_differences(pages.filter("page_no % 3 <> 2"), pages.filter("doc_id % 4 <> 1"))


@register(
    "sentinel_order",
    "WITH " + ev.BLOCKS + """, s AS (SELECT DISTINCT doc_id, page_no, i AS position, ['the', 'tion', 'of the', 'zzz'][(doc_id + i) % 4 + 1] AS sentinel FROM blocks, range(0, 2) AS x(i)),
    f AS (SELECT s.doc_id, s.page_no, position, min(block_seq) AS seq FROM s LEFT JOIN blocks g ON g.doc_id = s.doc_id AND g.page_no = s.page_no AND contains(trim(regexp_replace(lower(g.text), '[\\t\\n\\x0B\\f\\r\\x85\\p{Z}]+', ' ', 'g')), sentinel) GROUP BY ALL),
    r AS (SELECT a.doc_id, a.page_no, CASE WHEN a.seq IS NULL THEN 'first not found' WHEN z.seq IS NULL THEN 'second not found' WHEN a.seq >= z.seq THEN 'not in order' END AS reason
      FROM f a JOIN f z ON z.doc_id = a.doc_id AND z.page_no = a.page_no AND a.position = 0 AND z.position = 1)
    SELECT doc_id, page_no, reason IS NULL AS passed, reason FROM r""",
)
def sentinel_order(spark, sf_dir):
    """O35."""
    blocks = ev.blocks(spark, sf_dir)
    marks = F.array(*map(F.lit, ("the", "tion", "of the", "zzz")))
    sentinels = blocks.select("doc_id", "page_no").distinct().withColumn("position", F.explode(F.array(F.lit(0), F.lit(1))))
    sentinels = sentinels.withColumn("sentinel", F.element_at(marks, ((F.col("doc_id") + F.col("position")) % 4 + 1).cast("int")))
    return _long(evaluate.sentinel_order(blocks.withColumn("seq", F.col("block_seq")), sentinels), "page_no")


@register(
    "control_checks",
    "WITH " + ev.PAGES + """, f AS (SELECT doc_id, page_no, status, route FROM routed WHERE page_no % 7 <> 3), e AS (SELECT doc_id, page_no, CASE WHEN doc_id % 5 = 0 THEN 'Healthy' ELSE status END AS status, route FROM routed WHERE doc_id % 6 <> 2)
    SELECT coalesce(f.doc_id, e.doc_id) AS doc_id, coalesce(f.page_no, e.page_no) AS page_no, coalesce(f.status = e.status, false) AND coalesce(f.route = e.route, false) AS passed FROM f FULL JOIN e ON f.doc_id = e.doc_id AND f.page_no = e.page_no""",
)
def control_checks(spark, sf_dir):
    """Found statuses and routes against expected ones."""
    pages = _long(assess.assess_pages(ev.pages(spark, sf_dir)), "page_no").select("doc_id", "page_no", "status", "route")
    expected = pages.filter("doc_id % 6 <> 2").withColumn("status", F.when(F.col("doc_id") % 5 == 0, "Healthy").otherwise(F.col("status")))
    return evaluate.compare_expectations(pages.filter("page_no % 7 <> 3"), expected, ["doc_id", "page_no"], ["status", "route"])


@register("document_fingerprints", "WITH " + ev.BLOCKS + ", f AS (SELECT doc_id, count(*) AS blocks, string_agg(text, chr(10) || chr(10) ORDER BY page_no, block_seq) AS text FROM blocks GROUP BY doc_id) SELECT doc_id, blocks, length(text) AS chars, sha256(text) AS fingerprint FROM f")
def document_fingerprints(spark, sf_dir):
    """O38."""
    return evaluate.document_fingerprint(ev.blocks(spark, sf_dir), ["page_no", "block_seq"])


# --- boxes and specimens ----------------------------------------------------------------------

_AREA = lambda s: f"greatest(0e0, {s}.r - {s}.l) * greatest(0e0, {s}.b - {s}.t)"
_SHARED = "greatest(0e0, least(e.r, p.r) - greatest(e.l, p.l)) * greatest(0e0, least(e.b, p.b) - greatest(e.t, p.t))"


@register(
    "box_matches",
    "WITH " + ev.BLOCKS + pq.VISUALS.split(",\nstructural")[0] + f""", m AS (SELECT e.doc_id, e.page_no, e.visual_idx AS seq, p.block_seq AS predicted,
    CASE WHEN p.doc_id IS NULL THEN NULL WHEN {_AREA("p")} + {_AREA("e")} - {_SHARED} > 0 THEN {_SHARED} / ({_AREA("p")} + {_AREA("e")} - {_SHARED}) ELSE 0e0 END AS iou,
    CASE WHEN p.doc_id IS NULL THEN NULL WHEN {_AREA("e")} > 0 THEN {_SHARED} / ({_AREA("e")}) ELSE 0e0 END AS expected_coverage, CASE WHEN p.doc_id IS NULL THEN NULL WHEN {_AREA("p")} > 0 THEN {_SHARED} / ({_AREA("p")}) ELSE 0e0 END AS predicted_coverage
    FROM visuals e LEFT JOIN blocks p ON p.doc_id = e.doc_id AND p.page_no = e.page_no)
    SELECT *, greatest(iou, expected_coverage) AS score FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, seq ORDER BY score DESC, expected_coverage DESC, iou DESC, predicted NULLS LAST) = 1""",
)
def box_matches(spark, sf_dir):
    """P4."""
    blocks = ev.blocks(spark, sf_dir)
    expected = plaintext.visuals(blocks).withColumn("seq", F.col("visual_idx"))
    return _long(evaluate.box_matches(expected, blocks.withColumn("seq", F.col("block_seq"))), "page_no", "seq", "predicted")


@register(
    "box_gaps",
    "WITH " + ev.BLOCKS + """ SELECT a.doc_id, a.page_no, a.block_seq AS seq, CASE WHEN least(a.r - a.l, z.r - z.l) <= 0 THEN 0e0 ELSE greatest(0e0, least(a.r, z.r) - greatest(a.l, z.l)) / least(a.r - a.l, z.r - z.l) END AS x_overlap, greatest(0e0, z.t - a.b) AS gap
    FROM blocks a JOIN blocks z ON z.doc_id = a.doc_id AND z.page_no = a.page_no AND z.block_seq = a.block_seq + 2""",
)
def box_gaps(spark, sf_dir):
    """P5: each block and the second after it."""
    blocks = ev.blocks(spark, sf_dir)
    same = (F.col("a.doc_id") == F.col("z.doc_id")) & (F.col("a.page_no") == F.col("z.page_no")) & (F.col("z.block_seq") == F.col("a.block_seq") + 2)
    c = lambda s, *k: [F.col(f"{s}.{x}") for x in k]
    out = blocks.alias("a").join(blocks.alias("z"), same).select("a.doc_id", "a.page_no", F.col("a.block_seq").alias("seq"), evaluate.x_overlap(*c("a", "l", "r"), *c("z", "l", "r")).alias("x_overlap"), evaluate.vertical_gap(F.col("a.b"), F.col("z.t")).alias("gap"))
    return _long(out, "page_no", "seq")


_BESIDE = "CASE WHEN least(a.b - a.t, z.b - z.t) <= 0 THEN 0e0 ELSE greatest(0e0, least(a.b, z.b) - greatest(a.t, z.t)) / least(a.b - a.t, z.b - z.t) END"


@register(
    "multi_column_scores",
    "WITH " + ev.BLOCKS + f""", tall AS (SELECT doc_id, page_no, block_seq AS seq, l, t, r, b + 125e-3 AS b FROM blocks), cols AS (SELECT * FROM tall WHERE r - l BETWEEN 18e-2 AND 7e-1 AND b - t >= 8e-2),
    best AS (SELECT a.doc_id, a.page_no, count(*) AS pairs, max(abs((a.l + a.r) / 2 - (z.l + z.r) / 2) + {_BESIDE}) AS score FROM cols a JOIN cols z ON z.doc_id = a.doc_id AND z.page_no = a.page_no AND a.seq < z.seq
      AND abs((a.l + a.r) / 2 - (z.l + z.r) / 2) >= 22e-2 AND {_BESIDE} >= 3e-1 AND greatest(0e0, least(a.r, z.r) - greatest(a.l, z.l)) <= 5e-2 GROUP BY a.doc_id, a.page_no)
    SELECT p.doc_id, p.page_no, coalesce(pairs, 0) AS pairs, coalesce(score, 0e0) AS score FROM (SELECT DISTINCT doc_id, page_no FROM tall) p LEFT JOIN best ON best.doc_id = p.doc_id AND best.page_no = p.page_no""",
)
def multi_column_scores(spark, sf_dir):
    """Blocks made one line taller."""
    tall = ev.blocks(spark, sf_dir).select("doc_id", "page_no", F.col("block_seq").alias("seq"), "l", "t", "r", (F.col("b") + 0.125).alias("b"))
    return _long(evaluate.multi_column_score(tall), "page_no")


@register(
    "selected_specimens",
    """WITH s AS (SELECT 'd' || (doc_id // 3)::VARCHAR AS document_id, CASE WHEN doc_id = 2 THEN 'hilbert_zahlkoerper_1897_0379.xml' ELSE 'p' || doc_id::VARCHAR || '.xml' END AS name,
      CASE WHEN doc_id % 9 <> 4 THEN 1480 + doc_id * 37 % 470 END AS year, n_chars AS chars, len(string_split(coalesce(text, ''), chr(10))) AS regions, (doc_id * 7 % 50) / 50e0 AS score FROM documents),
    a AS (SELECT * FROM s WHERE year <= 1550 AND chars >= 1000 ORDER BY document_id, name LIMIT 1),
    b AS (SELECT * FROM s WHERE year BETWEEN 1700 AND 1799 AND chars >= 1000 AND name NOT IN (SELECT name FROM a) ORDER BY document_id, name LIMIT 1),
    c AS (SELECT * FROM s WHERE (name = 'hilbert_zahlkoerper_1897_0379.xml' OR (year BETWEEN 1800 AND 1900 AND chars >= 1000)) AND name NOT IN (SELECT name FROM a UNION ALL SELECT name FROM b)
      ORDER BY name <> 'hilbert_zahlkoerper_1897_0379.xml', document_id, name LIMIT 1),
    d AS (SELECT * FROM s WHERE score > 0 AND chars >= 1000 AND name NOT IN (SELECT name FROM a UNION ALL SELECT name FROM b UNION ALL SELECT name FROM c) ORDER BY score DESC, document_id, name LIMIT 1)
    SELECT 1::BIGINT AS place, 'early-print' AS category, document_id, name FROM a UNION ALL SELECT 2, 'eighteenth-century', document_id, name FROM b
    UNION ALL SELECT 3, 'nineteenth-century', document_id, name FROM c UNION ALL SELECT 4, 'multi-column', document_id, name FROM d""",
)
def selected_specimens(spark, sf_dir):
    """A selection of four is the feature."""
    d = F.col("doc_id")
    name = F.when(d == 2, evaluate.PREFERRED["nineteenth-century"]).otherwise(F.concat(F.lit("p"), d.cast("string"), F.lit(".xml")))
    docs = ev.documents(spark, sf_dir).select(
        F.concat(F.lit("d"), F.expr("doc_id div 3").cast("string")).alias("document_id"), name.alias("name"), F.when(d % 9 != 4, 1480 + d * 37 % 470).alias("year"), F.col("n_chars").alias("chars"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("regions"), (d * 7 % 50 / 50.0).alias("score"),
    )
    return _long(evaluate.select_specimens(docs), "place")


_WORDS = lambda x: f"list_filter(string_split(lower({x}), ' '), lambda q: q <> '')"


@register(
    "multiset_overlap",
    f"""WITH a AS (SELECT doc_id, unnest({_WORDS("text")}) AS w FROM documents), z AS (SELECT doc_id, unnest({_WORDS("replace(text, 'the', 'tbe')")}) AS w FROM documents),
    c AS (SELECT doc_id, w, count(*) AS n FROM a GROUP BY ALL), d AS (SELECT doc_id, w, count(*) AS n FROM z GROUP BY ALL) SELECT c.doc_id, sum(least(c.n, d.n))::BIGINT AS common FROM c JOIN d ON c.doc_id = d.doc_id AND c.w = d.w GROUP BY c.doc_id""",
)
def multiset_overlap(spark, sf_dir):
    """Each text against a misread one."""
    docs = ev.documents(spark, sf_dir).select("doc_id", "text")
    return evaluate.multiset_overlap(docs, docs.withColumn("text", F.replace("text", F.lit("the"), F.lit("tbe"))))


@register("ordered_overlap")
def ordered_overlap(spark, sf_dir):
    """A longest common subsequence has no SQL form; tests hold it against brute force."""
    docs = ev.documents(spark, sf_dir).select("doc_id", "text")
    return evaluate.ordered_common(docs, docs.withColumn("text", F.replace("text", F.lit("the"), F.lit("tbe"))))


@register("raster_measurements")
def raster_measurements(spark, sf_dir):
    """On drawn images, a dark bar of a document's length on white; pixels have no SQL form."""
    ev.ship(spark)
    white, dark = F.lit("FFFFFFFF"), F.lit("000000FF")
    bar = F.least(F.col("n_chars") % 40 + 1, F.lit(30)).cast("int")
    row = F.concat(F.expr("repeat('FFFFFFFF', 4)"), F.repeat(dark, bar), F.repeat(white, F.lit(60) - bar))
    image = F.unhex(F.concat(F.expr(f"repeat('{'FFFFFFFF' * 64}', 10)"), F.repeat(row, F.lit(8)), F.expr(f"repeat('{'FFFFFFFF' * 64}', 14)")))
    words = F.array(plaintext.rect(F.lit(0.0), F.lit(0.3), F.lit(0.25), F.lit(0.5)))
    docs = ev.documents(spark, sf_dir).withColumn("m", measures.measure_raster(image, F.lit(64), F.lit(32), words))
    return docs.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in ("fg_state", "uniformity", "fg_ratio", "interaction", "words_touched", "components")))
