"""Quality rules by repetition coverage (operator 4).

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``. For several
n-gram lengths, rolling 64-bit hashes of the words mark every n-gram that occurs again
in its text; the characters of marked words are counted once, whatever number of
n-grams covers them, and so are the characters of lines equal to an earlier line. A
text is rejected when a share of its word characters passes the limit of its length.

Behaviour on odd input: a null or empty text has no words, fails the word minimum and
is not kept; texts of any length are read whole; repeated rows and repeated ids give a
row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import documents, map_arrow
from quirework.llm.hashing import Batch, chunks, owners, windows

#: n-gram length -> largest share of word characters inside repeated n-grams.
NGRAM_LIMITS = {5: 0.30, 7: 0.25, 10: 0.20}
#: Largest share of word characters in lines equal to an earlier line.
LINE_LIMIT = 0.30
#: Largest share of symbols among word characters.
SYMBOL_LIMIT = 0.20
#: Fixed by the contract: fewest words, percent of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CHAR = np.ones(256, dtype=np.uint8)
_CHAR[128:192] = 0  # continuation bytes
_CHAR[[0x20, 9, 10, 11, 12, 13]] = 0

SCHEMA = (
    "row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
)
CHUNK_BYTES = 1 << 19


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which (group, key) pairs occur twice or more."""
    mixed = keys + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
    return twice[at] == mixed


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside any of the windows of n words that begin at starts."""
    step = np.zeros(total + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:total]) > 0


def coverage(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All counts of a list of texts."""
    b = Batch(texts)
    byte_bounds = b.starts
    char = _CHAR[b.data]
    out = {
        "n_words": b.n_words(),
        "word_chars": _per_text(char, byte_bounds),
        "n_symbols": _per_text(_SYMBOL[b.data], byte_bounds),
    }
    char_sum = np.concatenate([[0], np.cumsum(char, dtype=np.int64)])
    word_chars = char_sum[b.word_end] - char_sum[b.word_start]
    total, text_of = len(b.words), owners(b.word_of, len(b.words))

    # The shortest window goes first: a longer window repeats only where every shorter one in it does.
    alive = np.arange(total)
    for n in (BASE_WINDOW, *NGRAM_LIMITS):
        grams = windows(b.words, n)
        inside = alive[alive < len(grams)]
        inside = inside[text_of[inside] == text_of[inside + n - 1]]
        alive = inside[_repeated(grams[inside], text_of[inside])]
        held = _covered(alive, n, total)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = _per_text(held, b.word_of)
        else:
            out[f"dup_{n}gram_chars"] = _per_text(np.where(held, word_chars, 0), b.word_of)

    ends = np.flatnonzero(b.data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    chars = char_sum[ends] - char_sum[begins]
    full = chars > 0
    begins, ends, chars = begins[full], ends[full], chars[full]
    lines = b.hash.slices(begins, ends)
    whose = np.searchsorted(byte_bounds, begins, side="right") - 1
    order = np.lexsort((np.arange(len(lines)), lines, whose))
    again = np.zeros(len(lines), dtype=bool)
    again[order[1:]] = (lines[order[1:]] == lines[order[:-1]]) & (whose[order[1:]] == whose[order[:-1]])
    out["n_dup_lines"] = np.bincount(whose[again], minlength=b.n)
    out["dup_line_chars"] = np.bincount(whose[again], weights=chars[again], minlength=b.n).astype(np.int64)
    return out


def _measure(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("__text")).cast(pa.binary())
        rows = list(enumerate(x or b"" for x in text.to_pylist()))
        for part in chunks(rows, lambda r: len(r[1]) + 64, CHUNK_BYTES):
            counts = coverage([x for _, x in part])
            held = batch.slice(part[0][0], len(part))
            columns = [held.column(held.schema.get_field_index(k)) for k in keys]
            columns += [pa.array(counts[f.name].astype(np.int64)) for f in list(schema)[len(keys) :]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS)]


def quality_rules(
    df: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    ngram_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
    symbol_limit: float = SYMBOL_LIMIT,
) -> DataFrame:
    """Measures and verdict of every row; one narrow stage without a shuffle.

    keep: columns of the input to carry along. base_failed: fewer than 50 words, or more
    than half of them in repeated 3-word windows. kept: not base_failed and every share
    within its limit.
    """
    limits = ngram_limits or NGRAM_LIMITS
    if set(limits) - set(NGRAM_LIMITS):
        raise ValueError(f"n-gram lengths are {sorted(NGRAM_LIMITS)}")
    keep = ["doc_id"] if keep is None else keep
    # positional names inside, so that no column of the input can clash with a measure
    inner = {k: f"__keep_{i}" for i, k in enumerate(keep)}
    source = df.select(*(F.col(f"`{k}`").alias(a) for k, a in inner.items()), F.col(f"`{text}`").cast("string").alias("__text"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    out = StructType([source.schema[a] for a in inner.values()] + [StructField(m, LongType()) for m in MEASURES])
    arrow, names = to_arrow_schema(out), list(inner.values())
    measured = map_arrow(source, lambda batches: _measure(batches, names, arrow), out)
    share = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    good = (share("dup_line_chars") <= line_limit) & (share("n_symbols") <= symbol_limit)
    for n, most in limits.items():
        good &= share(f"dup_{n}gram_chars") <= most
    verdicts = measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & good)
    return verdicts.select(*(F.col(a).alias(k) for k, a in inner.items()), *MEASURES, "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: counts and verdict of every document."""
    return quality_rules(documents(spark, sf_dir))
