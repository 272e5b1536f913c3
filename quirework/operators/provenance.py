"""Provenance (K1-K6), quality (L1-L5) and result integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT_SCHEMA_ID = "document-result-v1"


def element_id(page: Column, order: Column) -> Column:
    return F.format_string("p%06d-e%06d", page.cast("long"), order.cast("long"))


def asset_id(element: Column) -> Column:
    return F.concat(element, F.lit(":preserved-visual"))


def text_hash(text: Column) -> Column:
    """K6: SHA-256 of the UTF-8 bytes, lower-case hexadecimal."""
    return F.sha2(text, 256)


def element_provenance(elements: DataFrame) -> DataFrame:
    """K1: who said what, with hashes of the selected and the normalised text."""
    return elements.select(
        "doc_id", element_id(F.col("page_no"), F.col("order")).alias("element_id"), "kind", "origin", text_hash(F.col("text")).alias("source_sha256"), text_hash(F.col("norm_text")).alias("norm_sha256"),
        "decision", F.coalesce(F.col("decision").isin("HealthyNativePreferred", "Conflict"), F.lit(False)).alias("divergence"), F.coalesce(F.col("text") != F.col("norm_text"), F.lit(False)).alias("changed"), "exclusion",
    )


def segment_provenance(segments: DataFrame) -> DataFrame:
    """K2."""
    return segments.select("doc_id", "segment_id", "ordinal", "first_page", "last_page", text_hash(F.col("text")).alias("text_sha256"), "origins", "mixed", "has_unresolved")


def assign_segments(members: DataFrame, segments: DataFrame) -> DataFrame:
    """K3: the segment of each element; elements of a dropped page have none."""
    key = ["doc_id", "seg_no", "fallback_page"]
    out = members.join(segments.select(*key, "segment_id"), key, "left")
    return out.select("doc_id", element_id(F.col("page_no"), F.col("order")).alias("element_id"), "segment_id", "kind", "origin", F.col("norm_text"))


def manifest(evidence: DataFrame) -> DataFrame:
    """K4: the distinct components a document's evidence names, in order. backend and profile may be null."""
    return evidence.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"), F.array_join(F.array_sort(F.collect_set("profile")), ",").alias("profiles"))


def evidence_gaps(elements: DataFrame, evidence: DataFrame) -> DataFrame:
    """K5: elements without evidence and evidence without an element."""
    key = ["doc_id", "element_id"]
    missing = elements.filter("kind <> 'Visual'").join(evidence, key, "left_anti").select(*key, F.lit("element-without-evidence").alias("rule"))
    return missing.unionByName(evidence.join(elements, key, "left_anti").select(*key, F.lit("evidence-without-element").alias("rule")))


def element_quality(elements: DataFrame, confidences: DataFrame) -> DataFrame:
    """L1 and L2: facts of each element with its recognition confidences (null where nothing was recognised)."""
    found = confidences.groupBy("doc_id", "page_no", "obs_seq").agg(F.count("*").alias("readings"), F.min("confidence").alias("least"), F.bround(F.avg("confidence"), 6).alias("mean"), F.max("confidence").alias("most"))
    out = elements.join(found, ["doc_id", "page_no", "obs_seq"], "left")
    used = F.col("origin") == "Ocr"
    return out.select(
        "doc_id", element_id(F.col("page_no"), F.col("order")).alias("element_id"), "kind", "origin", F.length("norm_text").cast("long").alias("chars"), F.col("exclusion").isNotNull().alias("excluded"),
        *(F.when(used, F.col(c)).alias(c) for c in ("readings", "least", "mean", "most")),
    )


def _quality_counts() -> list[Column]:
    kind, origin = F.col("kind"), F.col("origin")
    return [
        F.count("*").alias("elements"), F.count_if(origin == "Native").alias("native"), F.count_if(origin == "Ocr").alias("ocr"), F.count_if(origin.isin("Native", "Ocr")).alias("authoritative"),
        F.count_if(kind == "Heading").alias("headings"), F.count_if(kind == "Caption").alias("captions"), F.count_if(kind == "Visual").alias("visuals"), F.count_if(kind == "UnresolvedText").alias("unresolved"),
        F.count_if(kind == "Deferred").alias("deferred"), F.coalesce(F.sum(F.length("norm_text")), F.lit(0)).cast("long").alias("chars"),
        ((F.count_if(origin == "Native") > 0) & (F.count_if(origin == "Ocr") > 0)).alias("mixed"),
    ]


def segment_quality(assigned: DataFrame) -> DataFrame:
    """L3."""
    return assigned.filter("segment_id is not null").groupBy("doc_id", "segment_id").agg(*_quality_counts())


def document_quality(segments: DataFrame) -> DataFrame:
    """L4: rolled up from the segments."""
    sums = ["elements", "native", "ocr", "authoritative", "headings", "captions", "visuals", "unresolved", "deferred", "chars"]
    return segments.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count_if("mixed").alias("mixed_segments"), F.count_if(F.col("unresolved") + F.col("deferred") > 0).alias("unresolved_segments"), *(F.sum(c).cast("long").alias(c) for c in sums))


def quality_mismatches(a: DataFrame, b: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """Keys on one side alone, or with facts that differ."""
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    out = a.withColumn("__a", F.lit(1)).alias("a").join(b.withColumn("__b", F.lit(1)).alias("b"), on, "full_outer").filter(F.col("__a").isNull() | F.col("__b").isNull() | ~same)
    return out.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key), F.when(F.col("__a").isNull(), "second-only").when(F.col("__b").isNull(), "first-only").otherwise("differs").alias("rule"))


def page_results(elements: DataFrame) -> DataFrame:
    """M1: each page with its element ids in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col("order").cast("long").alias("order"), element_id(F.col("page_no"), F.col("order")).alias("id"))))
    return elements.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(held, lambda x: x["id"]), ",").alias("element_ids"), F.count("*").alias("elements"))


def portable_elements(elements: DataFrame) -> DataFrame:
    """M2: dense ordinals over (page, order); visuals get an asset id."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "order")
    name = element_id(F.col("page_no"), F.col("order"))
    return elements.select(
        "doc_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), name.alias("element_id"), "kind", F.col("norm_text").alias("text"), F.when(F.col("kind") == "Visual", asset_id(name)).alias("asset_id")
    )


def identity_violations(elements: DataFrame) -> DataFrame:
    """M3: repeated ids and ordinals that aren't 0 .. n-1."""
    repeated = elements.groupBy("doc_id", "element_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit("repeated-id").alias("rule"), F.col("element_id").alias("detail"))
    order = Window.partitionBy("doc_id").orderBy("ordinal", "element_id")
    gaps = elements.withColumn("expected", F.row_number().over(order) - 1).filter(F.col("ordinal") != F.col("expected")).select("doc_id", F.lit("gap-in-ordinals").alias("rule"), F.col("element_id").alias("detail"))
    return repeated.unionByName(gaps)


def membership_violations(elements: DataFrame, segments: DataFrame) -> DataFrame:
    """M4: elements whose segment doesn't list them, and listed elements that name another segment.

    segments: doc_id, segment_id, member_ids.
    """
    listed = segments.select("doc_id", "segment_id", F.explode("member_ids").alias("element_id"))
    key = ["doc_id", "segment_id", "element_id"]
    held = elements.filter("segment_id is not null").select(*key)
    return held.join(listed, key, "left_anti").withColumn("rule", F.lit("not-listed")).unionByName(listed.join(held, key, "left_anti").withColumn("rule", F.lit("not-held")))


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """M5: contradictions inside an element's evidence, one row a rule."""
    rules = [
        ("layout-without-raster", F.col("has_layout") & ~F.col("has_raster")),
        ("ocr-not-in-manifest", (F.col("origin") == "Ocr") & ~F.col("ocr_in_manifest")),
        ("reconciled-without-identity", F.col("decision").isNotNull() & ~F.col("has_reconciler")),
        ("changed-flag", F.col("changed") != F.coalesce(F.col("source_sha256") != F.col("norm_sha256"), F.lit(False))),
    ]
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())
    return evidence.withColumn("rule", F.explode(found)).select("doc_id", "element_id", "rule")


def segment_evidence_violations(segments: DataFrame, assigned: DataFrame) -> DataFrame:
    """M6: a segment's origins and unresolved flag against its members."""
    real = assigned.filter("segment_id is not null").groupBy("doc_id", "segment_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("origin") != "None", F.col("origin")))), ",").alias("real_origins"), F.bool_or(F.col("kind").isin("UnresolvedText", "Deferred")).alias("real_unresolved")
    )
    out = segments.join(real, ["doc_id", "segment_id"], "left")
    rules = F.filter(F.array(F.when(~F.col("origins").eqNullSafe(F.col("real_origins")), F.lit("origins")), F.when(~F.col("has_unresolved").eqNullSafe(F.col("real_unresolved")), F.lit("unresolved"))), lambda x: x.isNotNull())
    return out.withColumn("rule", F.explode(rules)).select("doc_id", "segment_id", "rule")


def asset_violations(elements: DataFrame, assets: DataFrame) -> DataFrame:
    """M7: visuals without an asset, assets without a visual, empty assets and bad digests."""
    key = ["doc_id", "asset_id"]
    named = elements.filter("kind = 'Visual'").select(*key)
    out = named.join(assets, key, "left_anti").select(*key, F.lit("visual-without-asset").alias("rule"))
    out = out.unionByName(assets.join(named, key, "left_anti").select(*key, F.lit("asset-without-visual").alias("rule")))
    out = out.unionByName(assets.filter("byte_length <= 0").select(*key, F.lit("empty").alias("rule")))
    return out.unionByName(assets.filter(~F.col("sha256").rlike("^[0-9a-f]{64}$")).select(*key, F.lit("digest").alias("rule")))


def outcomes(documents: DataFrame, violations: DataFrame) -> DataFrame:
    """M8: a document with a violation fails alone, with its first rule as message."""
    found = violations.groupBy("doc_id").agg(F.min("rule").alias("error"), F.count("*").alias("violations"))
    out = documents.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("error").isNull(), "Succeeded").otherwise("Failed").alias("status"), "error", F.coalesce("violations", F.lit(0)).alias("violations"))


RESULT_JSON = "struct<schema:string,doc_id:bigint,elements:array<struct<ordinal:bigint,element_id:string,kind:string,text:string>>>"


def to_result_json(portable: DataFrame) -> DataFrame:
    """A document's portable elements as one JSON text with a schema id."""
    held = F.array_sort(F.collect_list(F.struct("ordinal", "element_id", "kind", "text")))
    out = portable.groupBy("doc_id").agg(held.alias("elements"))
    return out.select("doc_id", F.to_json(F.struct(F.lit(RESULT_SCHEMA_ID).alias("schema"), "doc_id", "elements")).alias("json"))


def from_result_json(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Reads the JSON again; another schema id is an error, or with strict=False a left-out row."""
    parsed = rows.withColumn("r", F.from_json("json", RESULT_JSON))
    known = F.col("r.schema") == RESULT_SCHEMA_ID
    if strict:
        parsed = parsed.filter(F.when(F.coalesce(known, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported schema: "), F.coalesce("r.schema", F.lit("none"))))))
    else:
        parsed = parsed.filter(F.coalesce(known, F.lit(False)))
    return parsed.select("r.doc_id", F.explode("r.elements").alias("e")).select("doc_id", "e.*")
