"""Queries over layout, reconciliation and visual evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.operators import assess, reconcile, visual
from quirework.plans import evidence as ev
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


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


WORDS = """,
split AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS tokens FROM blocks),
words0 AS (SELECT doc_id, page_no, block_seq, l, t, r, b, len(tokens) AS n, unnest(tokens) AS word, unnest(range(len(tokens))) AS word_idx FROM split),
words AS (SELECT *, l + (r - l) / n * word_idx AS wl, l + (r - l) / n * (word_idx + 1) AS wr FROM words0)"""

LAYOUT = """,
layout0 AS (
  SELECT doc_id, page_no, block_seq AS obs_seq, block_seq AS reading_order, ['text', 'paragraph_title', 'figure_title', 'image', 'table', 'text', 'formula', ' Text ', 'seal'][line_no % 9 + 1] AS raw_label,
         l, t + CASE WHEN (doc_id + block_seq) % 3 = 0 THEN 15625e-6 ELSE 0e0 END AS t, r, b + CASE WHEN (doc_id + block_seq) % 3 = 0 AND (doc_id + page_no) % 9 = 4 THEN 15625e-6 ELSE 0e0 END AS b FROM blocks),
layout AS (
  SELECT *, CASE lower(trim(raw_label)) WHEN 'text' THEN 'Text' WHEN 'paragraph_title' THEN 'Heading' WHEN 'figure_title' THEN 'Caption' WHEN 'image' THEN 'Figure' WHEN 'formula' THEN 'Figure'
            WHEN 'table' THEN 'Table' ELSE 'Unknown' END AS kind FROM layout0)"""

PAIRS = (
    WORDS
    + LAYOUT
    + """,
hits AS (SELECT w.doc_id, w.page_no, o.obs_seq, w.block_seq, min(word_idx) AS first_word, max(word_idx) AS last_word, count(*) AS intersecting FROM words w JOIN layout o
  ON w.doc_id = o.doc_id AND w.page_no = o.page_no AND w.wl < o.r AND o.l < w.wr AND w.t < o.b AND o.t < w.b GROUP BY ALL),
wanted AS (SELECT doc_id, page_no, obs_seq, kind, reading_order FROM layout WHERE kind IN ('Text', 'Heading', 'Caption', 'Table')),
owned AS (SELECT h.doc_id, h.page_no, h.obs_seq, w.block_seq, w.word_idx, w.word, w.wl, w.wr, w.t, w.b, count(*) OVER (PARTITION BY w.doc_id, w.page_no, w.block_seq, w.word_idx) AS owners
  FROM hits h JOIN wanted x ON x.doc_id = h.doc_id AND x.page_no = h.page_no AND x.obs_seq = h.obs_seq
  JOIN words w ON w.doc_id = h.doc_id AND w.page_no = h.page_no AND w.block_seq = h.block_seq AND w.word_idx BETWEEN h.first_word AND h.last_word),
native AS (SELECT doc_id, page_no, obs_seq, max(owners) AS owners, string_agg(word, ' ' ORDER BY block_seq, word_idx) AS native_text, count(*) FILTER (WHERE owners > 1) AS ambiguous_words,
  min(wl) AS l, min(t) AS t, max(wr) AS r, max(b) AS b FROM owned GROUP BY ALL),
pairs AS (SELECT x.doc_id, x.page_no, x.obs_seq, x.kind, x.reading_order, CASE WHEN owners IS NULL THEN 'NoNativeEvidence' WHEN owners > 1 THEN 'AmbiguousWordOwnership' ELSE 'Comparable' END AS status, native_text,
  coalesce(ambiguous_words, 0) AS ambiguous_words, n.l, n.t, n.r, n.b FROM wanted x LEFT JOIN native n ON n.doc_id = x.doc_id AND n.page_no = x.page_no AND n.obs_seq = x.obs_seq)"""
)

OCR = """,
ocr0 AS (
  SELECT doc_id, page_no, block_seq AS obs_seq, line_no, 0 AS text_seq, substr(text, 1, length(text) // 2) || CASE WHEN line_no % 2 = 0 THEN '-' ELSE '' END AS text FROM blocks
  UNION ALL SELECT doc_id, page_no, block_seq, line_no, 1, substr(text, length(text) // 2 + 1) FROM blocks),
ocr AS (SELECT doc_id, page_no, obs_seq, text_seq, CASE WHEN line_no % 4 = 3 THEN replace(text, 'th', 'tb') ELSE text END AS text, 1e0 - (line_no % 8) / 16e0 AS confidence FROM ocr0),
frag AS (SELECT *, trim(text) AS now, lead(trim(text)) OVER (PARTITION BY doc_id, page_no, obs_seq ORDER BY text_seq) AS next FROM ocr WHERE trim(text) <> ''),
frag1 AS (SELECT *, replace(now, chr(173), '') AS clean, coalesce(ends_with(replace(now, chr(173), ''), '-') AND regexp_matches(next, '^\\p{Ll}'), false) AS joins FROM frag),
joined AS (SELECT doc_id, page_no, obs_seq, string_agg(CASE WHEN joins THEN left(clean, length(clean) - 1) ELSE clean END || CASE WHEN next IS NULL OR joins THEN '' ELSE ' ' END, '' ORDER BY text_seq) AS text,
  sum(length(now) - length(clean))::BIGINT AS removals, count(*) FILTER (WHERE joins) AS joins FROM frag1 GROUP BY ALL)"""


def layout(spark, sf_dir):
    return plaintext.layout(ev.blocks(spark, sf_dir)).withColumn("kind", reconcile.layout_kind(F.col("raw_label")))


@register("layout_kinds", "WITH " + ev.BLOCKS + LAYOUT + " SELECT raw_label, kind, count(*) AS boxes FROM layout GROUP BY 1, 2")
def layout_kinds(spark, sf_dir):
    """C2."""
    return layout(spark, sf_dir).groupBy("raw_label", "kind").agg(F.count("*").alias("boxes"))


@register(
    "parse_layout",
    """SELECT doc_id, 1::BIGINT AS page_no, i::BIGINT AS obs_seq, ['Text', 'Heading', 'Unknown'][i + 1] AS kind, (100 * i + doc_id % 50) / 1000e0 AS l, (10 * i) / 500e0 AS t, (100 * i + doc_id % 50 + 80) / 1000e0 AS r,
    (10 * i + 7) / 500e0 AS b FROM documents, range(0, 3) AS x(i)""",
)
def parse_layout(spark, sf_dir):
    """On layout answers of three boxes a document, half of them wrapped in ``res``."""
    box = [F.concat(F.lit('{"block_label":"' + label + f'","block_bbox":['), (F.lit(100 * i) + F.col("doc_id") % 50).cast("string"), F.lit(f",{10 * i},"), (F.lit(100 * i + 80) + F.col("doc_id") % 50).cast("string"), F.lit(f",{10 * i + 7}]}}")) for i, label in enumerate(("text", "doc_title", "stamp"))]
    body = F.concat(F.lit('{"parsing_res_list":['), F.concat_ws(",", *box), F.lit("]}"))
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"res":'), body, F.lit("}"))).otherwise(body)
    pages = ev.documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), answer.alias("layout_json"), F.lit(1000).alias("px_width"), F.lit(500).alias("px_height"))
    return _long(reconcile.parse_layout(pages), "page_no", "obs_seq").select("doc_id", "page_no", "obs_seq", "kind", "l", "t", "r", "b")


@register(
    "parse_recognition",
    """SELECT doc_id, i::BIGINT AS text_seq, ['alpha', 'beta'][i + 1] AS text, 5e-1 + i * 25e-2 AS confidence, (10 + i) / 100e0 AS l, 20 / 200e0 AS t, (30 + i) / 100e0 AS r, 40 / 200e0 AS b FROM documents, range(0, 2) AS x(i)""",
)
def parse_recognition(spark, sf_dir):
    """Recognition answers with a blank text among them."""
    answer = '{"rec_texts":["alpha","beta"," "],"rec_scores":[0.5,0.75,0.9],"rec_boxes":[[5,10,25,30],[6,10,26,30],[0,0,1,1]]}'
    regions = ev.documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), F.lit(0).alias("obs_seq"), F.lit(answer).alias("ocr_json"), F.lit(5).alias("crop_l"), F.lit(10).alias("crop_t"), F.lit(100).alias("px_width"), F.lit(200).alias("px_height"))
    return _long(reconcile.parse_recognition(regions), "text_seq").select("doc_id", "text_seq", "text", "confidence", "l", "t", "r", "b")


@register(
    "reading_plan",
    "WITH " + ev.BLOCKS + LAYOUT + """ SELECT doc_id, page_no, obs_seq, kind, floor(l * 1000)::BIGINT AS px_l, floor(least(t, 1e0) * 700)::BIGINT AS px_t, ceil(r * 1000)::BIGINT AS px_r, ceil(least(b, 1e0) * 700)::BIGINT AS px_b
    FROM layout WHERE kind IN ('Text', 'Heading', 'Caption', 'Table')""",
)
def reading_plan(spark, sf_dir):
    """Boxes to be read and their crops in pixels."""
    return _long(reconcile.reading_plan(layout(spark, sf_dir), 1000, 700), "page_no", "obs_seq", "px_l", "px_t", "px_r", "px_b")


@register("native_extents", "WITH " + ev.BLOCKS + PAIRS + " SELECT doc_id, page_no, obs_seq, block_seq, first_word, last_word, intersecting FROM hits")
def native_extents(spark, sf_dir):
    """D1."""
    out = reconcile.native_extents(plaintext.with_words(ev.blocks(spark, sf_dir)), layout(spark, sf_dir))
    out = out.select("doc_id", "page_no", "obs_seq", "block_seq", "first_word", "last_word", "intersecting")
    return _long(out, "page_no", "obs_seq", "block_seq", "first_word", "last_word")


@ev.shared
def _pairings(spark, sf_dir):
    boxes = layout(spark, sf_dir)
    return reconcile.pairings(boxes, reconcile.native_extents(plaintext.with_words(ev.blocks(spark, sf_dir)), boxes))


def pairings_of(spark, sf_dir):
    return layout(spark, sf_dir), _pairings(spark, sf_dir)


@register("native_pairings", "WITH " + ev.BLOCKS + PAIRS + " SELECT doc_id, page_no, obs_seq, status, native_text, ambiguous_words, l, t, r, b FROM pairs")
def native_pairings(spark, sf_dir):
    """D2 and D3."""
    return _long(pairings_of(spark, sf_dir)[1], "page_no", "obs_seq").drop("kind", "reading_order")


@register("ocr_dehyphenation", "WITH " + ev.BLOCKS + OCR + " SELECT * FROM joined")
def ocr_dehyphenation(spark, sf_dir):
    """D4 and D7."""
    out = reconcile.ocr_fragments(plaintext.recognised(ev.blocks(spark, sf_dir)))
    out = out.withColumn("d", reconcile.dehyphenate_fragments(F.col("fragments"), native=False))
    return _long(out.select("doc_id", "page_no", "obs_seq", F.col("d.text").alias("text"), F.col("d.removals").alias("removals"), F.col("d.joins").alias("joins")), "page_no", "obs_seq", "removals", "joins")


@register(
    "native_dehyphenation",
    "WITH " + ev.LINES + """,
soft AS (SELECT doc_id, line_no, list_filter(string_split(replace(replace(text, 'ti', 'ti' || chr(173)), 'ing', chr(173) || ' ing'), ' '), lambda x: x <> '') AS f FROM lines),
each AS (SELECT doc_id, line_no, unnest(f) AS now, unnest(range(len(f))) AS i FROM soft),
led AS (SELECT *, lead(now) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS next FROM each),
j AS (SELECT *, replace(now, chr(173), '') AS clean, coalesce(ends_with(now, chr(173)) AND regexp_matches(next, '^\\p{Ll}'), false) AS joins FROM led),
done AS (SELECT doc_id, line_no, string_agg(clean || CASE WHEN next IS NULL OR joins THEN '' ELSE ' ' END, '' ORDER BY i) AS text, sum(length(now) - length(clean))::BIGINT AS removals, count(*) FILTER (WHERE joins) AS joins FROM j GROUP BY ALL)
SELECT l.doc_id, l.line_no, coalesce(d.text, '') AS text, coalesce(removals, 0) AS removals, coalesce(joins, 0) AS joins FROM lines l LEFT JOIN done d ON d.doc_id = l.doc_id AND d.line_no = l.line_no""",
)
def native_dehyphenation(spark, sf_dir):
    """On words with soft hyphens put in."""
    soft = F.replace(F.replace("text", F.lit("ti"), F.lit("ti­")), F.lit("ing"), F.lit("­ ing"))
    out = plaintext.lines(ev.documents(spark, sf_dir)).withColumn("f", F.filter(F.split(soft, " "), lambda x: x != ""))
    out = out.withColumn("d", reconcile.dehyphenate_fragments(F.col("f"), native=True))
    return _long(out.select("doc_id", "line_no", F.col("d.text").alias("text"), F.col("d.removals").alias("removals"), F.col("d.joins").alias("joins")), "line_no", "removals", "joins")


_SQUEEZE = lambda x: f"trim(regexp_replace(replace({x}, chr(173), ''), '[\\t\\n\\x0B\\f\\r\\x85\\p{{Z}}]+', ' ', 'g'))"

RECONCILED = (
    ev.PAGES
    + PAIRS
    + OCR
    + """,
failed AS (SELECT DISTINCT p.doc_id, p.page_no FROM pairs p JOIN routed r ON r.doc_id = p.doc_id AND r.page_no = p.page_no WHERE p.status = 'AmbiguousWordOwnership' AND r.status <> 'Missing'),
recin AS (SELECT p.doc_id, p.page_no, p.obs_seq, p.kind, p.reading_order, CASE WHEN p.status = 'Comparable' AND r.status <> 'Missing' THEN r.status ELSE 'Missing' END AS status,
  CASE WHEN p.status = 'Comparable' AND r.status <> 'Missing' THEN native_text END AS native_text, j.text AS ocr_text
  FROM pairs p JOIN routed r ON r.doc_id = p.doc_id AND r.page_no = p.page_no LEFT JOIN joined j ON j.doc_id = p.doc_id AND j.page_no = p.page_no AND j.obs_seq = p.obs_seq
  WHERE (p.doc_id, p.page_no) NOT IN (SELECT doc_id, page_no FROM failed)),
rec0 AS (SELECT *, coalesce(trim(ocr_text) <> '', false) AS has_text, status = 'Missing' OR native_text IS NULL AS missing FROM recin),
rec1 AS (SELECT *, CASE WHEN NOT missing AND has_text THEN """
    + _SQUEEZE("native_text")
    + " = "
    + _SQUEEZE("ocr_text")
    + """ END AS equivalent FROM rec0),
rec2 AS (SELECT *, CASE WHEN missing AND has_text THEN 'OcrOnly' WHEN missing THEN 'NoTextRecovered' WHEN NOT has_text AND status = 'Healthy' THEN 'NativeOnly' WHEN NOT has_text THEN 'SuspiciousNativeUnverified'
  WHEN equivalent THEN 'Agreement' WHEN status = 'Healthy' THEN 'HealthyNativePreferred' ELSE 'Conflict' END AS decision FROM rec1),
rec AS (SELECT *, CASE WHEN decision = 'OcrOnly' THEN 'Ocr' WHEN decision IN ('NativeOnly', 'Agreement', 'HealthyNativePreferred') THEN 'Native' ELSE 'None' END AS origin,
  CASE WHEN decision = 'OcrOnly' THEN ocr_text WHEN decision IN ('NativeOnly', 'Agreement', 'HealthyNativePreferred') THEN native_text END AS selected_text,
  decision IN ('HealthyNativePreferred', 'Conflict') AS divergence FROM rec2)"""
)


def reconciled(spark, sf_dir, boxes=None):
    """Every readable box of pages that don't fail, with its page's status, native and recognised text.

    boxes (doc_id, page_no, obs_seq and facts of them) narrow it down; they are joined before the
    texts are compared, as behind the Python worker that does so nothing is dealt out by document.
    """
    blocks = ev.blocks(spark, sf_dir)
    pairs = pairings_of(spark, sf_dir)[1]
    statuses = assess.assess_pages(ev.pages(spark, sf_dir)).select("doc_id", "page_no", F.col("status").alias("page_status"))
    read = reconcile.ocr_fragments(plaintext.recognised(blocks)).withColumn("ocr_text", reconcile.dehyphenate_fragments(F.col("fragments"), native=False)["text"])
    # a page fails if one of its boxes is ambiguous (reconcile.page_outcomes), unless it has no native text to pair
    crossed = F.max(F.col("status") == "AmbiguousWordOwnership").over(Window.partitionBy("doc_id", "page_no"))
    pairs = pairs.withColumn("crossed", crossed).join(statuses, ["doc_id", "page_no"]).filter("page_status = 'Missing' or not crossed").drop("crossed")
    pairs = pairs.join(read.select("doc_id", "page_no", "obs_seq", "ocr_text"), ["doc_id", "page_no", "obs_seq"], "left")
    if boxes is not None:
        pairs = pairs.join(boxes, ["doc_id", "page_no", "obs_seq"])
    native = (F.col("status") == "Comparable") & (F.col("page_status") != "Missing")
    pairs = pairs.withColumns({"native_text": F.when(native, F.col("native_text")), "status": F.when(native, F.col("page_status")).otherwise("Missing")})
    return reconcile.reconcile(pairs)


@register(
    "page_outcomes",
    "WITH " + RECONCILED + """ SELECT r.doc_id, r.page_no, CASE WHEN f.doc_id IS NULL THEN 'Completed' ELSE 'Failed' END AS outcome,
    CASE WHEN r.status = 'Missing' THEN 0 ELSE (SELECT count(*) FROM pairs p WHERE p.doc_id = r.doc_id AND p.page_no = r.page_no AND p.status = 'AmbiguousWordOwnership') END AS ambiguous_boxes
    FROM routed r LEFT JOIN failed f ON f.doc_id = r.doc_id AND f.page_no = r.page_no""",
)
def page_outcomes(spark, sf_dir):
    """H7: pages that fail as two boxes own a word."""
    statuses = assess.assess_pages(ev.pages(spark, sf_dir)).select("doc_id", "page_no", F.col("status").alias("page_status"))
    return _long(reconcile.page_outcomes(pairings_of(spark, sf_dir)[1], statuses), "page_no")


@register("reconciled_text", "WITH " + RECONCILED + " SELECT doc_id, page_no, obs_seq, status, decision, origin, selected_text, equivalent, selected_text IS NOT NULL AS resolved, divergence FROM rec")
def reconciled_text(spark, sf_dir):
    """D6, D8, D9."""
    out = _long(reconciled(spark, sf_dir), "page_no", "obs_seq")
    return out.select("doc_id", "page_no", "obs_seq", "status", "decision", "origin", "selected_text", "equivalent", "resolved", "divergence")


@register(
    "reconciliation_violations",
    "WITH " + ev.BLOCKS + LAYOUT + """,
x AS (SELECT b.doc_id, b.page_no, b.block_seq, CASE WHEN (b.doc_id + b.block_seq) % 4 = 0 THEN 'Missing' ELSE 'Healthy' END AS status, b.block_seq % 3 <> 1 AS has_native,
  b.page_no + CASE WHEN b.block_seq = 5 THEN 1 ELSE 0 END AS ocr_page_no, b.l < o.r AND o.l < b.r AND b.t < o.b AND o.t < b.b AS meets
  FROM blocks b JOIN layout o ON o.doc_id = b.doc_id AND o.page_no = b.page_no AND o.obs_seq = (b.block_seq + 1) % 8)
SELECT doc_id, page_no, block_seq, 'missing-with-native' AS rule FROM x WHERE status = 'Missing' AND has_native UNION ALL
SELECT doc_id, page_no, block_seq, 'present-without-native' FROM x WHERE status <> 'Missing' AND NOT has_native UNION ALL
SELECT doc_id, page_no, block_seq, 'other-page' FROM x WHERE ocr_page_no <> page_no UNION ALL SELECT doc_id, page_no, block_seq, 'no-overlap' FROM x WHERE has_native AND NOT meets""",
)
def reconciliation_violations(spark, sf_dir):
    """On pairs of a block and the box after it."""
    blocks, boxes = ev.blocks(spark, sf_dir), layout(spark, sf_dir)
    box = lambda s: plaintext.rect(*(F.col(f"{s}.{k}") for k in "ltrb"))
    key = (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.page_no") == F.col("y.page_no")) & (F.col("y.obs_seq") == (F.col("x.block_seq") + 1) % 8)
    rows = blocks.alias("x").join(boxes.alias("y"), key).select(
        "x.doc_id", "x.page_no", "x.block_seq", F.when((F.col("x.doc_id") + F.col("x.block_seq")) % 4 == 0, "Missing").otherwise("Healthy").alias("status"), (F.col("x.block_seq") % 3 != 1).alias("has_native"),
        (F.col("x.page_no") + (F.col("x.block_seq") == 5).cast("int")).alias("ocr_page_no"), box("x").alias("n"), box("y").alias("o"),
    )
    return _long(reconcile.reconciliation_violations(rows).select("doc_id", "page_no", "block_seq", "rule"), "page_no", "block_seq")


# --- visual evidence ----------------------------------------------------------------------------

VISUALS = """,
visuals0 AS (SELECT DISTINCT doc_id, page_no, i AS visual_idx FROM blocks, range(0, 2) AS x(i)),
visuals1 AS (SELECT *, (doc_id + visual_idx) % 3 * 125e-3 AS l, (doc_id + page_no * 2 + visual_idx) % 6 * 125e-3 AS t FROM visuals0),
visuals2 AS (SELECT *, l + 25e-2 + (doc_id + page_no + visual_idx) % 3 * 25e-2 AS r, t + 125e-3 * (1 + (doc_id + visual_idx) % 3) AS b, (doc_id + page_no + visual_idx) % 7 AS k FROM visuals1),
visuals AS (SELECT *, CASE k WHEN 0 THEN 'BlankCanvas' WHEN 1 THEN 'Unavailable' ELSE 'Measured' END AS fg_state, (doc_id * 7 + page_no * 3 + visual_idx) % 20 / 200e0 AS fg_ratio, (doc_id + page_no) % 4 / 100e0 AS words_touched,
  (doc_id + visual_idx) % 4 AS components, (r - l) * (b - t) AS area,
  ['NoForegroundWordIntersection', 'LowForegroundWordInteraction', 'ForegroundWordInteraction', 'NoNativeWords'][(doc_id + page_no * 3 + visual_idx) % 4 + 1] AS interaction FROM visuals2),
structural AS (SELECT *, len(list_filter(string_split(norm_text, ' '), lambda x: x <> '')) AS words, length(norm_text) AS chars FROM headed)"""

HEADING_NEAR = """,
hnear AS (SELECT v.*, h.block_seq AS heading_seq, h.t AS ht, h.b AS hb,
  sqrt((CASE WHEN v.r < h.l THEN h.l - v.r WHEN h.r < v.l THEN v.l - h.r ELSE 0e0 END) * (CASE WHEN v.r < h.l THEN h.l - v.r WHEN h.r < v.l THEN v.l - h.r ELSE 0e0 END)
     + (CASE WHEN v.b < h.t THEN h.t - v.b WHEN h.b < v.t THEN v.t - h.b ELSE 0e0 END) * (CASE WHEN v.b < h.t THEN h.t - v.b WHEN h.b < v.t THEN v.t - h.b ELSE 0e0 END)) AS distance
  FROM visuals v LEFT JOIN structural h ON h.doc_id = v.doc_id AND h.page_no = v.page_no AND h.is_heading WHERE v.fg_state = 'Measured'),
hfirst AS (SELECT * FROM hnear QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, visual_idx ORDER BY distance NULLS LAST, heading_seq) = 1),
hev AS (SELECT doc_id, page_no, visual_idx, CASE WHEN heading_seq IS NULL THEN 'NoStrongAssociation' WHEN coalesce(distance <= 25e-3 AND (CASE WHEN least(b - t, hb - ht) <= 0 THEN 0e0 ELSE greatest(0e0, least(b, hb) - greatest(t, ht)) / least(b - t, hb - ht) END) >= 45e-2
  AND CASE WHEN hb - ht > 0 THEN (b - t) / (hb - ht) END BETWEEN 35e-2 AND 35e-1 AND interaction IN ('NoForegroundWordIntersection', 'LowForegroundWordInteraction', 'BlankCanvas'), false) THEN 'StrongAdjacentVisual'
  WHEN distance <= 6e-2 THEN 'PossibleAdjacentVisual' ELSE 'NoStrongAssociation' END AS heading_evidence FROM hfirst)"""

CONTAINED = """,
pagew AS (SELECT doc_id, page_no, sum(words) AS page_words FROM structural GROUP BY ALL),
inside AS (SELECT v.doc_id, v.page_no, v.visual_idx, count(*) FILTER (WHERE is_heading) AS headings, count(*) FILTER (WHERE NOT is_heading) AS bodies, sum(words) AS inside_words,
  coalesce(sum(words) FILTER (WHERE is_heading), 0) AS heading_words, coalesce(sum(words) FILTER (WHERE NOT is_heading), 0) AS body_words, count(*) FILTER (WHERE NOT is_heading AND (words >= 12 OR chars >= 80)) AS paragraphs
  FROM visuals v JOIN structural x ON x.doc_id = v.doc_id AND x.page_no = v.page_no AND (((x.l + x.r) / 2 BETWEEN v.l AND v.r AND (x.t + x.b) / 2 BETWEEN v.t AND v.b)
    OR (x.l >= v.l - 3e-3 AND x.r <= v.r + 3e-3 AND x.t >= v.t - 3e-3 AND x.b <= v.b + 3e-3)
    OR coalesce(CASE WHEN (x.r - x.l) * (x.b - x.t) > 0 THEN greatest(0e0, least(v.r, x.r) - greatest(v.l, x.l)) * greatest(0e0, least(v.b, x.b) - greatest(v.t, x.t)) / ((x.r - x.l) * (x.b - x.t)) END >= 75e-2, false))
  WHERE v.fg_state = 'Measured' GROUP BY ALL),
cev AS (SELECT v.doc_id, v.page_no, v.visual_idx, CASE WHEN coalesce(inside_words, 0) = 0 THEN 'NoContainedNativeText' WHEN headings > 0 AND body_words <= greatest(3, heading_words // 2) THEN 'HeadingDominatedContainedText'
  WHEN bodies >= 2 OR paragraphs >= 1 OR (page_words > 0 AND inside_words::DOUBLE / page_words >= 8e-2) THEN 'TextRichContainer' ELSE 'SparseContainedText' END AS containment_evidence
  FROM visuals v LEFT JOIN inside i ON i.doc_id = v.doc_id AND i.page_no = v.page_no AND i.visual_idx = v.visual_idx LEFT JOIN pagew p ON p.doc_id = v.doc_id AND p.page_no = v.page_no WHERE v.fg_state = 'Measured')"""

_HINTS = " OR ".join(f"starts_with(lower(ltrim(x.norm_text)), '{h}')" for h in visual.HINTS)
_OVER = "(CASE WHEN least(v.r - v.l, x.r - x.l) <= 0 THEN 0e0 ELSE greatest(0e0, least(v.r, x.r) - greatest(v.l, x.l)) / least(v.r - v.l, x.r - x.l) END)"
CAPTIONS = (
    WORDS
    + f""",
leads AS (SELECT v.doc_id, v.page_no, v.visual_idx, min(CASE WHEN w.t >= v.b THEN w.t - v.b ELSE v.t - w.b END) AS lead_gap FROM visuals v JOIN words w ON w.doc_id = v.doc_id AND w.page_no = v.page_no
  AND regexp_replace(lower(trim(w.word)), '[:.]+$', '') IN ('figure', 'fig', 'table', 'plate', 'exhibit') AND (w.t >= v.b OR w.b <= v.t) AND (w.wl + w.wr) / 2 BETWEEN v.l - 3e-2 AND v.r + 3e-2
  AND CASE WHEN w.t >= v.b THEN w.t - v.b ELSE v.t - w.b END <= 8e-2 WHERE v.fg_state = 'Measured' GROUP BY ALL),
cand0 AS (SELECT v.doc_id, v.page_no, v.visual_idx, x.block_seq, x.words, x.chars, ({_HINTS}) AS hint, CASE WHEN x.t >= v.b THEN x.t - v.b ELSE v.t - x.b END AS gap, {_OVER} AS overlap,
  (x.l + x.r) / 2 BETWEEN v.l - 2e-2 AND v.r + 2e-2 AS aligned FROM visuals v JOIN structural x ON x.doc_id = v.doc_id AND x.page_no = v.page_no AND NOT x.is_heading AND (x.t >= v.b OR x.b <= v.t) WHERE v.fg_state = 'Measured'),
cand AS (SELECT * FROM cand0 WHERE gap <= 8e-2 AND (overlap >= 1e-1 OR aligned OR hint) QUALIFY row_number() OVER (PARTITION BY doc_id, page_no, visual_idx ORDER BY hint DESC, gap, overlap DESC, block_seq) = 1),
kev AS (SELECT v.doc_id, v.page_no, v.visual_idx, CASE WHEN lead_gap <= 6e-2 THEN 'StrongAssociation' WHEN lead_gap IS NOT NULL THEN 'PossibleAssociation' WHEN gap IS NULL THEN 'NoAssociation'
  WHEN hint AND words BETWEEN 2 AND 50 AND chars <= 320 AND gap <= 6e-2 AND (overlap >= 15e-2 OR aligned) THEN 'StrongAssociation'
  WHEN words BETWEEN 2 AND 50 AND chars <= 320 AND gap <= 25e-3 AND overlap >= 5e-1 THEN 'PossibleAssociation' ELSE 'NoStrongAssociation' END AS caption_evidence
  FROM visuals v LEFT JOIN leads l ON l.doc_id = v.doc_id AND l.page_no = v.page_no AND l.visual_idx = v.visual_idx LEFT JOIN cand c ON c.doc_id = v.doc_id AND c.page_no = v.page_no AND c.visual_idx = v.visual_idx
  WHERE v.fg_state = 'Measured')"""
)

CLASSIFIED = (
    VISUALS
    + HEADING_NEAR
    + CONTAINED
    + CAPTIONS
    + """,
enriched AS (SELECT v.*, coalesce(heading_evidence, 'NotMeasured') AS heading_evidence, coalesce(containment_evidence, 'NotMeasured') AS containment_evidence, coalesce(caption_evidence, 'NotMeasured') AS caption_evidence
  FROM visuals v LEFT JOIN hev h ON h.doc_id = v.doc_id AND h.page_no = v.page_no AND h.visual_idx = v.visual_idx LEFT JOIN cev c ON c.doc_id = v.doc_id AND c.page_no = v.page_no AND c.visual_idx = v.visual_idx
  LEFT JOIN kev k ON k.doc_id = v.doc_id AND k.page_no = v.page_no AND k.visual_idx = v.visual_idx),
classified AS (SELECT *, CASE WHEN fg_state = 'BlankCanvas' THEN 'BlankCanvas' WHEN fg_state <> 'Measured' THEN 'Unknown' WHEN caption_evidence = 'StrongAssociation' THEN 'CaptionedMeaningfulVisual'
  WHEN heading_evidence = 'StrongAdjacentVisual' AND fg_ratio <= 5e-3 AND words_touched <= 1e-2 AND area <= 2e-2 THEN 'SmallHeadingAssociatedVisual' WHEN fg_ratio <= 5e-3 AND components <= 2 AND words_touched <= 2e-2 THEN 'TinyOrNoise'
  WHEN containment_evidence = 'HeadingDominatedContainedText' THEN 'HeadingBackplateOrPresentation' WHEN containment_evidence = 'TextRichContainer' THEN 'NativeTextContainerOrFrame'
  WHEN fg_ratio >= 5e-2 AND interaction = 'NoForegroundWordIntersection' AND heading_evidence <> 'StrongAdjacentVisual' THEN 'LargeIndependentVisual' ELSE 'Unknown' END AS visual_kind FROM enriched)"""
)


@ev.shared
def enriched(spark, sf_dir):
    blocks = ev.blocks(spark, sf_dir)
    structural = visual.structural_blocks(ev.heading_blocks(spark, sf_dir))
    return visual.enrich(plaintext.visuals(blocks), structural, plaintext.with_words(blocks))


@register("visual_evidence", "WITH " + ev.HEADINGS + CLASSIFIED + " SELECT doc_id, page_no, visual_idx, heading_evidence, containment_evidence, caption_evidence FROM enriched")
def visual_evidence(spark, sf_dir):
    """G1-G5."""
    return _long(enriched(spark, sf_dir), "page_no", "visual_idx").select("doc_id", "page_no", "visual_idx", "heading_evidence", "containment_evidence", "caption_evidence")


@register("source_visual_kinds", "WITH " + ev.HEADINGS + CLASSIFIED + " SELECT doc_id, page_no, visual_idx, visual_kind FROM classified")
def source_visual_kinds(spark, sf_dir):
    """G6."""
    out = enriched(spark, sf_dir).withColumn("visual_kind", visual.classify_source_visual())
    return _long(out, "page_no", "visual_idx").select("doc_id", "page_no", "visual_idx", "visual_kind")


_FIGURES = """,
figs AS (SELECT * FROM layout WHERE kind = 'Figure'),
caps AS (SELECT f.doc_id, f.page_no, f.obs_seq, count(*) AS captions, count(*) FILTER (WHERE f.reading_order < c.reading_order
  AND (CASE WHEN least(f.r - f.l, c.r - c.l) <= 0 THEN 0e0 ELSE greatest(0e0, least(f.r, c.r) - greatest(f.l, c.l)) / least(f.r - f.l, c.r - c.l) END) >= 4e-1
  AND (CASE WHEN c.t >= f.b THEN c.t - f.b WHEN c.b <= f.t THEN f.t - c.b ELSE 0e0 END) <= 8e-2) AS strong FROM figs f JOIN layout c ON c.doc_id = f.doc_id AND c.page_no = f.page_no AND c.kind = 'Caption' GROUP BY ALL),
figures AS (SELECT f.doc_id, f.page_no, f.obs_seq, f.raw_label, coalesce(captions, 0) AS captions, coalesce(strong, 0) AS strong, CASE WHEN lower(raw_label) = 'formula' THEN 'Unknown' WHEN strong = 1 THEN 'CaptionedMeaningfulVisual'
  WHEN captions > 0 THEN 'Unknown' WHEN greatest(0e0, least(greatest(r, 0e0), 1e0) - least(greatest(l, 0e0), 1e0)) * greatest(0e0, least(greatest(b, 0e0), 1e0) - least(greatest(t, 0e0), 1e0)) >= 25e-2
  AND NOT EXISTS (SELECT 1 FROM layout x WHERE x.doc_id = f.doc_id AND x.page_no = f.page_no AND x.kind IN ('Text', 'Heading', 'Table') AND f.l < x.r AND x.l < f.r AND f.t < x.b AND x.t < f.b) THEN 'LargeIndependentVisual'
  ELSE 'Unknown' END AS figure_kind FROM figs f LEFT JOIN caps c ON c.doc_id = f.doc_id AND c.page_no = f.page_no AND c.obs_seq = f.obs_seq)"""


@register("layout_figures", "WITH " + ev.BLOCKS + LAYOUT.replace("FROM blocks)", "FROM blocks WHERE line_no % 9 <> 2 OR doc_id % 2 = 0)") + _FIGURES + " SELECT doc_id, page_no, obs_seq, raw_label, captions, strong, figure_kind FROM figures")
def layout_figures(spark, sf_dir):
    """Captions only in every second document."""
    boxes = layout(spark, sf_dir).filter("kind <> 'Caption' or doc_id % 2 = 0")
    return _long(visual.layout_figures(boxes).withColumnRenamed("kind", "figure_kind"), "page_no", "obs_seq")


_FACTS = ["is_cover", "is_nav", "is_presentation", "is_preliminary", "is_repeated", "is_terminal", "is_figure", "has_body_boundary"]


@register(
    "structured_visual_kinds",
    "SELECT doc_id, CASE WHEN " + " OR ".join(f"doc_id % {i + 7} = {i}" for i in range(6)) + " THEN 'PublicationPresentationVisual' WHEN doc_id % 13 = 6 OR doc_id % 14 = 7 THEN 'StructuredContentMeaningfulVisual' ELSE 'Unknown' END AS visual_kind FROM documents",
)
def structured_visual_kinds(spark, sf_dir):
    """G9."""
    facts = ev.documents(spark, sf_dir).select("doc_id", *((F.col("doc_id") % (i + 7) == i).alias(n) for i, n in enumerate(_FACTS)))
    return facts.select("doc_id", visual.classify_structured_visual().alias("visual_kind"))


@register(
    "qualified_visuals",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 < 3 AND doc_id % 3 = 0 THEN 'StructuredContentMeaningfulVisual' WHEN doc_id % 2 = 0 THEN 'Unknown' ELSE 'PublicationPresentationVisual' END AS kind FROM documents""",
)
def qualified_visuals(spark, sf_dir):
    """G10."""
    media = F.element_at(F.array(*map(F.lit, ("image/jpeg", "image/png", "image/gif", "image/svg+xml"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = ev.documents(spark, sf_dir)
    images = docs.select("doc_id", F.col("doc_id").alias("resource"), media.alias("media_type"), F.when(F.col("doc_id") % 2 == 0, "Unknown").otherwise("PublicationPresentationVisual").alias("kind"))
    boxes = docs.select(F.col("doc_id").alias("resource"), F.when(F.col("doc_id") % 3 == 0, "Table").otherwise("Text").alias("kind"))
    return visual.qualify_by_layout(images, boxes).select("doc_id", "kind")


_PLACED = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY reading_order, obs_seq) - 1 AS rank FROM layout),
around AS (SELECT v.doc_id, v.page_no, v.visual_idx, v.l, v.t, v.r, v.b, max(CASE WHEN o.b <= v.t THEN o.rank + 1 END) AS after, min(CASE WHEN o.t >= v.b THEN o.rank END) AS before
  FROM visuals v LEFT JOIN ranked o ON o.doc_id = v.doc_id AND o.page_no = v.page_no AND v.l < o.r AND o.l < v.r GROUP BY ALL),
placed AS (SELECT *, CASE WHEN visual_idx % 2 = 1 THEN 1073741824 WHEN after > before THEN NULL ELSE coalesce(after, before) END AS rank FROM around),
stuck AS (SELECT doc_id, page_no FROM placed GROUP BY ALL HAVING bool_or(rank IS NULL)),
allboxes AS (SELECT doc_id, page_no, rank, 1 AS side, obs_seq AS seq, kind FROM ranked UNION ALL
  SELECT p.doc_id, p.page_no, p.rank, 0, visual_idx, 'Figure' FROM placed p WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.doc_id = p.doc_id AND s.page_no = p.page_no))
SELECT doc_id, page_no, seq, kind, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY rank, side, seq) - 1 AS reading_order FROM allboxes"""


@register("inserted_source_figures", "WITH " + ev.BLOCKS + LAYOUT + VISUALS.split(",\nstructural")[0] + _PLACED)
def inserted_source_figures(spark, sf_dir):
    """The second visual of a page is unqualified."""
    visuals = plaintext.visuals(ev.blocks(spark, sf_dir)).withColumn("qualified", F.col("visual_idx") % 2 == 0)
    out = visual.insert_source_figures(layout(spark, sf_dir), visuals)
    return _long(out, "page_no", "seq", "reading_order").select("doc_id", "page_no", "seq", "kind", "reading_order")


@register(
    "resolved_source_kinds",
    "WITH " + ev.BLOCKS + LAYOUT + VISUALS.split(",\nstructural")[0] + """ SELECT doc_id, page_no, visual_idx, CASE visual_idx WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'SourceBackedMeaningfulVisual' ELSE 'SourceBackedUnqualifiedVisual' END
    ELSE CASE WHEN EXISTS (SELECT 1 FROM layout o WHERE o.doc_id = v.doc_id AND o.page_no = v.page_no AND (kind = 'Table' OR lower(raw_label) = 'formula')
      AND greatest(0e0, least(v.r, o.r) - greatest(v.l, o.l)) * greatest(0e0, least(v.b, o.b) - greatest(v.t, o.t)) / least((v.r - v.l) * (v.b - v.t), (o.r - o.l) * (o.b - o.t)) >= 5e-1) THEN 'SourceBackedMeaningfulVisual'
      ELSE 'SourceBackedUnqualifiedVisual' END END AS resolved_kind FROM visuals v""",
)
def resolved_source_kinds(spark, sf_dir):
    """G12."""
    preserve = F.when(F.col("doc_id") % 2 == 0, "PreserveMeaningfulVisual").otherwise("PreserveUnqualifiedVisual")
    visuals = plaintext.visuals(ev.blocks(spark, sf_dir)).withColumn("action", F.when(F.col("visual_idx") == 0, preserve).otherwise("AnalyzeVisual"))
    return _long(visual.resolve_source_kind(visuals, layout(spark, sf_dir)), "page_no", "visual_idx").select("doc_id", "page_no", "visual_idx", "resolved_kind")


@register(
    "uncovered_figures",
    "WITH " + ev.BLOCKS + LAYOUT + VISUALS.split(",\nstructural")[0] + """ SELECT o.doc_id, o.page_no, o.obs_seq FROM layout o WHERE kind = 'Figure' AND NOT EXISTS (SELECT 1 FROM visuals v WHERE v.doc_id = o.doc_id AND v.page_no = o.page_no
    AND greatest(0e0, least(v.r, o.r) - greatest(v.l, o.l)) * greatest(0e0, least(v.b, o.b) - greatest(v.t, o.t)) > 5e-1 * ((o.r - o.l) * (o.b - o.t)))""",
)
def uncovered_figures(spark, sf_dir):
    """G13."""
    out = visual.uncovered_figures(layout(spark, sf_dir), plaintext.visuals(ev.blocks(spark, sf_dir)))
    return _long(out, "page_no", "obs_seq").select("doc_id", "page_no", "obs_seq")


@register(
    "singleton_figures",
    "WITH " + ev.BLOCKS + LAYOUT + VISUALS.split(",\nstructural")[0] + """ SELECT f.doc_id, f.page_no, f.obs_seq, v.visual_idx FROM (SELECT doc_id, page_no, min(obs_seq) AS obs_seq FROM layout WHERE kind = 'Figure' GROUP BY ALL HAVING count(*) = 1) f
    JOIN (SELECT doc_id, page_no, min(visual_idx) AS visual_idx FROM visuals WHERE fg_state = 'BlankCanvas' GROUP BY ALL HAVING count(*) = 1) v ON v.doc_id = f.doc_id AND v.page_no = f.page_no""",
)
def singleton_figures(spark, sf_dir):
    """Blank canvases stand for the planned visuals."""
    visuals = plaintext.visuals(ev.blocks(spark, sf_dir)).filter("fg_state = 'BlankCanvas'")
    return _long(visual.singleton_figures(layout(spark, sf_dir).filter("kind = 'Figure'"), visuals), "page_no", "obs_seq", "visual_idx")


@register(
    "executed_visuals",
    "WITH " + ev.HEADINGS + CLASSIFIED + """ SELECT doc_id, page_no, visual_idx, CASE visual_kind WHEN 'Unknown' THEN 'Deferred' ELSE 'Visual' END AS element_kind FROM classified
    WHERE visual_kind IN ('Unknown', 'CaptionedMeaningfulVisual', 'LargeIndependentVisual')""",
)
def executed_visuals(spark, sf_dir):
    """H9 after E6."""
    kinds = source_visual_kinds(spark, sf_dir)
    out = visual.execute_visuals(kinds.withColumn("disposition", assess.mapped(F.col("visual_kind"), assess.DISPOSITION)))
    return out.select("doc_id", "page_no", "visual_idx", "element_kind")
