"""The ten operator queries and their DuckDB SQL."""

from __future__ import annotations

from quirework.llm import curve_packing, html_text, license_scan, near_dedup, oracles, quality_rules, source_mixing, suffix_dedup, tiff, training_order, url_rules

QUERIES = {
    "op1_tiff": tiff.query,
    "op2_curve_packing": curve_packing.query,
    "op3_html_text": html_text.query,
    "op4_quality_rules": quality_rules.query,
    "op5_near_dedup": near_dedup.query,
    "op6_url_rules": url_rules.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_training_order": training_order.query,
    "op9_license_scan": license_scan.query,
    "op10_source_mixing": source_mixing.query,
}
ORACLES: dict[str, str] = {
    "op4_quality_rules": oracles.quality(),
    "op5_near_dedup": oracles.near(),
    "op6_url_rules": url_rules.oracle(),
    "op7_suffix_dedup": oracles.repeats(),
}
