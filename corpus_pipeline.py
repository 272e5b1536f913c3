"""The corpus pipeline: five operators in a row, each over all that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of documents (the last one:
packed pieces). ``run`` writes each stage's rows as Parquet and reads them again, as a
scheduler would; a lost executor costs the running stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import Scratch, documents, maybe_broadcast
from quirework.llm.curve_packing import pack_along_curve
from quirework.llm.near_dedup import near_duplicates, text_key
from quirework.llm.quality_rules import quality_rules
from quirework.llm.source_mixing import mix_sources
from quirework.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity, in percent, from which the near-dedup stage links two texts; op5's 85 is that query's own.
PERCENT = 80
#: Bytes from which the suffix-dedup stage cuts repeats: 50 words of plain prose have more. op7's 400 is that query's own.
REPEAT_BYTES = 224


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the least id, a null id last.

    Of several rows of a group with this id one stays. Rows are told apart by id and text: an id
    that is null or repeated decides nothing about other groups. Texts without a word all stay.
    """
    scratch = Scratch(spark, "near-dedup-stage")
    kept = near_duplicates(docs, percent=PERCENT).filter("kept and group_id is not null")
    groups = kept.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.count("*").alias("rows"))
    groups = scratch.save(groups.select(F.col("one.doc_id").alias("__kept_id"), F.col("one.text_key").alias("__kept_key"), "rows"), "kept")
    key = text_key(F.col("text"))

    def chosen(side: DataFrame, how: str) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(side["__kept_id"]) & (key == side["__kept_key"])
        return docs.join(maybe_broadcast(side, 32), same, how)

    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    alone = chosen(groups.filter("rows = 1"), "left").filter(F.col("__kept_key").isNotNull() | blank).select(*COLUMNS)
    # ids are rarely null or repeated: only then rows with equal text are dealt out
    several = groups.filter("rows > 1")
    if several.isEmpty():
        return alone
    equal = chosen(several, "left_semi").groupBy("doc_id", key.alias("__key")).agg(F.min(F.struct(*COLUMNS)).alias("one"))
    return alone.unionByName(equal.select("one.*"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes of strings that repeat; n_chars follows the text. Documents left without a word go."""
    left = remove_repeats(docs, length=REPEAT_BYTES).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return left.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources up to twice; every document stays."""
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences along the curve."""
    return pack_along_curve(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("source_mixing", mixing), ("curve_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs


#: Sketches, ranks, keyed permutations and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None
