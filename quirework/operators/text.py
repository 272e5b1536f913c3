"""Text normalisation (ids B1, B2, B8) and recurring page margins."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the margin rules.
HEADER_TOP, FOOTER_BOTTOM, MOST_HEIGHT = 0.12, 0.88, 0.20
MOST_MARGIN_CHARS, LEAST_PAGES, MOST_PAGES, PAGE_SHARE = 160, 3, 10, 0.02

#: All white space of Unicode; Java's \s is ASCII alone.
SPACE = r"[\t\n\x0B\f\r\x85\p{Z}]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no builtin."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def recomposed(text: pd.Series) -> pd.Series:
    """The canonical composition of texts that aren't composed; null for all others."""

    def form(x):
        out = x if x is None or x.isascii() else unicodedata.normalize("NFC", x)
        return None if out == x else out

    return pd.Series([form(x) for x in text], dtype=object)


def line_ends(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def dehyphenate(text: Column) -> Column:
    """Joins a word split by a hyphen at a line end when it goes on in lower case."""
    return F.regexp_replace(text, r"(?<=\p{L})-[\t ]*\n[\t ]*(?=\p{Ll})", "")


def collapse(text: Column) -> Column:
    """Runs of white space to one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def collapse_ends(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def normalize(text: Column, compose: bool = True) -> Column:
    """B1: composition, line ends, dehyphenation, white space."""
    return collapse(dehyphenate(line_ends(nfc(text) if compose else text)))


def upper_invariant(text: Column) -> Column:
    """Upper case letter by letter: the sharp s has none."""
    keep = F.lit("\ue000")
    return F.replace(F.upper(F.replace(text, F.lit("ß"), keep)), keep, F.lit("ß"))


def canonical(normalized: Column) -> Column:
    """B2: upper case, runs of digits to #."""
    return F.regexp_replace(upper_invariant(normalized), r"\p{Nd}+", "#")


def margin_zone(top: Column, bottom: Column) -> Column:
    """Header, Footer or null of a box relative to the page's content."""
    height = bottom - top
    fits = (height > 0) & (height <= MOST_HEIGHT)
    return F.when(fits & (top <= HEADER_TOP), "Header").when(fits & (bottom >= FOOTER_BOTTOM), "Footer")


def recurring_margins(blocks: DataFrame) -> DataFrame:
    """(doc_id, zone, key, pages) of margin texts on enough pages of their document.

    blocks: doc_id, page_no, t, b, norm_text.
    """
    zoned = blocks.withColumn("zone", margin_zone(F.col("t"), F.col("b")))
    named = zoned.filter("zone is not null").filter((F.length("norm_text") > 0) & (F.length("norm_text") <= MOST_MARGIN_CHARS))
    keys = named.groupBy("doc_id", "zone", canonical(F.col("norm_text")).alias("key")).agg(F.countDistinct("page_no").alias("pages"))
    sizes = blocks.groupBy("doc_id").agg(F.countDistinct("page_no").alias("page_count"))
    least = F.greatest(F.lit(LEAST_PAGES), F.least(F.lit(MOST_PAGES), F.ceil(F.lit(PAGE_SHARE) * F.col("page_count"))))
    return keys.join(sizes, "doc_id").filter(F.col("pages") >= least).select("doc_id", "zone", "key", "pages")


def normalize_blocks(blocks: DataFrame, compose: bool = True) -> DataFrame:
    """Adds norm_text and exclusion (RepeatedHeader, RepeatedFooter or null), B5's text kept.

    A column composed has the composition of texts that need one (``recomposed``); with it no
    Python worker stands between the blocks and their margins, and they stay where they lie.
    """
    known = "composed" in blocks.columns
    source = F.coalesce("composed", "text") if known else F.col("text")
    cleaned = blocks.withColumn("norm_text", normalize(source, compose and not known)).drop("composed")
    keyed = cleaned.withColumns({"zone": margin_zone(F.col("t"), F.col("b")), "key": canonical(F.col("norm_text"))})
    found = recurring_margins(cleaned).select("doc_id", "zone", "key", F.lit(True).alias("recurs"))
    out = keyed.join(found, ["doc_id", "zone", "key"], "left")
    return out.withColumn("exclusion", F.when(F.col("recurs"), F.concat(F.lit("Repeated"), F.col("zone")))).drop("zone", "key", "recurs")
