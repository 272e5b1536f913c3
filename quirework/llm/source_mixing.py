"""Mixing sources to target weights by temperature (operator 10).

A source's weight is its share of the words raised to an exponent and normalised. The
exponent is bisected between 1 (shares as they are) and 0 (all sources alike) for the
flattest mixture that keeps a repetition limit, or for the mixture of a target entropy.
The mixture's budget is, unless given, the least at which every source is used in full, so
that no document is lost.

Budgets are realised as block permutations. A source's documents fall into blocks of about
a million words by a keyed hash; each epoch permutes the blocks by another key and takes
them in this order until the source's budget is spent. Whole blocks need no further look;
the block at the end of the budget is cut at one document by its own keyed order. Only
totals of blocks are ever sorted - a row for a million words - and the documents take
their epochs from them in a join, so the size of a source doesn't matter.

``mix_key`` orders the copies of all sources: it is the copy's place in its source's budget
(0 to 2**62), so every stretch of the order holds the sources in their weights.

Behaviour on odd input: null or blank texts weigh nothing and go with their block; a null
source is a source of its own; repeated rows fall into one block and are mixed together;
one source, or one that holds nearly all rows, is fine; an empty table gives an empty
result; other columns are carried along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import Scratch, maybe_broadcast

BLOCK_WORDS = 1 << 20
MAX_REPEATS = 2.0
SEED = "mix-1"
STEPS = 60
TOP = 1 << 60


def shares(words: dict, exponent: float) -> dict:
    """Normalised weights: shares of words to the power of the exponent (0 for a source without words)."""
    total = math.fsum(words.values())
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in words.items()}
    norm = math.fsum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w)


def repeats(words: dict, weights: dict, budget: float | None) -> dict:
    """Epochs of each source. Without a budget: those at which the least used source is used once."""
    rates = {s: weights[s] / n for s, n in words.items() if n}
    scale = budget if budget is not None else 1 / min(rates.values())
    return {s: scale * r for s, r in rates.items()}


def solve_exponent(words: dict, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> float:
    """Bisects the exponent: entropy falls and the repetition of small sources shrinks as it grows."""
    if sum(1 for n in words.values() if n) < 2:
        return 1.0

    def too_flat(x: float) -> bool:
        weights = shares(words, x)
        if target_entropy is not None:
            return entropy(weights) > target_entropy
        return max(repeats(words, weights, budget).values()) > max_repeats

    if not too_flat(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def _key(*parts: Column | str) -> Column:
    """A 60-bit number from a keyed digest."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(
    df: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    target_entropy: float | None = None,
    max_repeats: float | None = MAX_REPEATS,
    budget_words: int | None = None,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """df's columns for each copy of each document, and __n_words, __epoch, __block, __mix_key.

    The words of each source are collected to the driver: one row for each source, as many
    as a mixture has entries.
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "source-mixing")
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    label = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))
    counted = df.withColumns({"__source": name, "__n_words": word_count(F.col(f"`{text}`").cast("string")), "__doc": _key(seed, "doc", label)})
    sizes = scratch.save(counted.select("__source", "__n_words", "__doc"), "sizes")
    words = {r["__source"]: r["n"] for r in sizes.groupBy("__source").agg(F.sum("__n_words").alias("n")).collect()}
    if not any(words.values()):
        scratch.drop()
        return counted.withColumns({"__epoch": F.lit(0), "__block": F.lit(0), "__mix_key": F.col("__doc") * 4}).drop("__source", "__doc")
    exponent = solve_exponent(words, target_entropy, max_repeats, budget_words)
    used = repeats(words, shares(words, exponent), budget_words)
    plan = []
    for s, n in words.items():
        # without a given budget every source is used in full at least
        share = round(used.get(s, 1.0) * n)
        budget = max(n, share) if budget_words is None else share
        plan.append((s, n, max(1, -(-n // block_words)), budget, max(1, -(-budget // n) if n else 1)))
    table = spark.createDataFrame(plan, "__source string, total long, blocks long, budget long, epochs long")
    table = maybe_broadcast(table, 64)

    block = F.pmod(F.col("__doc"), F.col("blocks"))
    blocked = sizes.join(table, "__source").withColumn("__block", block)
    blocks = blocked.groupBy("__source", "__block").agg(F.sum("__n_words").alias("words")).join(table, "__source")
    blocks = blocks.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    blocks = blocks.withColumn("order", _key(seed, "block", F.col("__source"), F.col("__epoch"), F.col("__block")))
    before = Window.partitionBy("__source", "__epoch").orderBy("order", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.col("__epoch") * F.col("total") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    # a block takes part if it begins inside the budget; in the first epoch a block without words always does
    blocks = blocks.filter((F.col("start") < F.col("budget")) | ((F.col("__epoch") == 0) & (F.col("budget") >= F.col("total"))))
    blocks = scratch.save(blocks.select("__source", "__block", "__epoch", "start", "words", "budget"), "blocks")

    # documents of the blocks at the end of a budget, in their keyed order, up to the cut
    ends = blocks.filter(F.col("start") + F.col("words") > F.col("budget"))
    inside = blocked.join(maybe_broadcast(ends.drop("words", "budget"), 64), ["__source", "__block"])  # one block for each source
    inside = inside.withColumn("order", _key(seed, "doc", F.col("__epoch"), F.col("__doc")))
    taken = Window.partitionBy("__source", "__epoch", "__block").orderBy("order").rangeBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("start") + F.coalesce(F.sum("__n_words").over(taken), F.lit(0))).filter(F.col("at") < F.col("budget"))
    cut = inside.groupBy("__source", "__epoch", "__block").agg(F.max("order").alias("cut"))
    blocks = blocks.join(cut, ["__source", "__epoch", "__block"], "left")
    blocks = blocks.withColumn("cut", F.when(F.col("start") + F.col("words") > F.col("budget"), F.coalesce("cut", F.lit(-1))).otherwise(F.lit(TOP)))
    copies = blocks.groupBy("__source", "__block").agg(F.collect_list(F.struct("__epoch", "start", "words", "budget", "cut")).alias("copies"))
    copies = scratch.save(copies, "copies")
    scratch.drop("blocks", "sizes")

    rows = counted.join(table.select("__source", "blocks"), "__source").withColumn("__block", block)
    rows = rows.join(maybe_broadcast(copies, 256), ["__source", "__block"])
    rows = rows.withColumn("copy", F.explode("copies"))
    order = _key(seed, "doc", F.col("copy.__epoch"), F.col("__doc"))
    rows = rows.withColumn("order", order).filter(F.col("order") <= F.col("copy.cut"))
    room = F.least(F.col("copy.words"), F.col("copy.budget") - F.col("copy.start"))
    place = (F.col("copy.start") + F.col("order") / (F.col("copy.cut") + 1) * room) / F.greatest(F.col("copy.budget"), F.lit(1))
    rows = rows.withColumns({"__epoch": F.col("copy.__epoch").cast("int"), "__block": F.col("__block").cast("int"), "__mix_key": (place * F.lit(float(1 << 62))).cast("long")})
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), "__n_words", "__epoch", "__block", "__mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every copy of every document in the mixture, with its epoch, block and place."""
    from quirework.llm.common import documents

    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("__n_words").alias("n_words"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__mix_key").alias("mix_key"))
