"""Packing along a space-filling curve (operator 2).

A document's hashed bag of tokens is projected to four dimensions; the cell it falls in
has a key on the Hilbert curve, and documents in the order of their keys - neighbours
hold similar documents - are laid end to end and cut every ``width`` tokens. The only
padding is at the end of the last sequence.

One pass tokenises the texts into a table of ids; quantiles of the keys give ranges of
about equal size (low bits of the key are a hash of the document, so that thousands of
copies, which share a cell, still spread over many ranges); one shuffle brings range k
to task k, which sorts it and cuts pieces from a running position. A range's first position
comes from the token totals of the ranges before it: one number for each range.

Behaviour on odd input: a null or empty text is one token, the end id; a text of any
length is cut over as many sequences as it needs; repeated rows are packed as often as
they occur; null ids are packed too; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import Scratch, map_arrow, shuffle_partitions
from quirework.llm.hashing import U64, chunks, mix, stream
from quirework.llm.token_ids import coder, tokenizer_path

WIDTH = 2048
END = 1
DIMENSIONS, BITS = 4, 10
TIE_BITS = 63 - DIMENSIONS * BITS
BUCKETS = 4096
#: Tokens in a range, and the most ranges: one boundary each goes to every task.
RANGE_TOKENS, MOST_RANGES = 16 << 20, 20_000


def projection(seed: int = 23) -> np.ndarray:
    """BUCKETS x DIMENSIONS standard normal numbers from a seed."""
    u = stream(seed, 2 * BUCKETS * DIMENSIONS).astype(np.float64) / 2.0**64
    a, b = u[::2], u[1::2]
    return (np.sqrt(-2 * np.log(a + 1e-18)) * np.cos(2 * np.pi * b)).reshape(BUCKETS, DIMENSIONS)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell coordinates (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


_tables: dict[str, np.ndarray] = {}


def cells(ids: list[np.ndarray]) -> np.ndarray:
    """Grid cells of token lists: hashed log counts, unit length, projected, through the normal CDF."""
    if not _tables:
        _tables["project"] = projection()
        _tables["bucket"] = (mix(np.arange(1 << 16, dtype=U64) + U64(41)) % U64(BUCKETS)).astype(np.int64)
    at = np.zeros((len(ids), DIMENSIONS))
    for i, x in enumerate(ids):
        counts = np.bincount(_tables["bucket"][x], minlength=BUCKETS)
        held = np.flatnonzero(counts)
        weight = 1 + np.log(counts[held])
        at[i] = weight @ _tables["project"][held] / math.sqrt(float(weight @ weight))
    # a logistic curve close to the normal CDF: about equal shares of documents for each cell
    share = 1 / (1 + np.exp(-1.702 * at))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def _tokenised(path: str, with_curve: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(path)
        end = np.array([END], dtype="<u2").tobytes()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in chunks(list(enumerate(texts)), lambda r: len(r[1]) + 64, 1 << 20):
                held = [x + end for x in encoder.encode([t for _, t in part])]
                ids = [np.frombuffer(x, dtype="<u2") for x in held]
                columns = [batch.column(0).slice(part[0][0], len(part))]
                if with_curve:
                    digest = np.array([zlib.crc32(x) for x in held], dtype=np.uint64)
                    number = np.array([x if x is not None else -1 for x in columns[0].to_pylist()], dtype=np.int64)
                    tie = mix(mix(number.view(U64)) + digest) >> U64(64 - TIE_BITS)
                    columns.append(pa.array((hilbert_keys(cells(ids), BITS) << TIE_BITS) | tie.astype(np.int64)))
                columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array(held, pa.binary())]
                names = ["doc_id", *(["curve"] if with_curve else []), "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def tokenised(df: DataFrame, doc_id: str, text: str, path: str, with_curve: bool = True) -> DataFrame:
    """(doc_id, [curve,] doc_tokens, ids): a document's ids and the end id as 16-bit bytes."""
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))
    return map_arrow(source, _tokenised(path, with_curve), "doc_id long, " + "curve long, " * with_curve + "doc_tokens long, ids binary")


def with_range(bounds: np.ndarray):
    """Adds the range (part) that each row's curve key falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("curve")
            part = np.searchsorted(bounds, batch.column(at).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    return run


def _cut(first: dict[int, int], width: int, with_ids: bool):
    """Pieces of documents that arrive in order of (part, curve, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = at = None
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: E731, B023
            for doc, curve, n, held, p in zip(*(get(c) for c in ("doc_id", "curve", "doc_tokens", "ids", "part")), strict=True):
                if p != part:
                    part, at = p, first[p]
                ids = np.frombuffer(held, dtype="<u2").astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % width
                    length = min(n - start, width - offset)
                    piece = ids[start : start + length].tobytes()
                    row = (doc, start, length, zlib.crc32(piece), n, (at + start) // width, offset, curve, piece if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += length
                at += n
            kinds = [pa.int64()] * 8 + [pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve", "piece"]
            keep = 9 if with_ids else 8
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    return run


def pack_along_curve(df: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in its document and in its sequence.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve (the document's
    key), and with_ids the piece's ids as little-endian 32-bit bytes. Sequences are numbered
    along the curve without gaps.
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "curve-packing")
    tokens = scratch.save(tokenised(df, doc_id, text, tokenizer or tokenizer_path()), "tokens")
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(3 * shuffle_partitions(spark), -(-total // RANGE_TOKENS))))
    marks = [i / ranges for i in range(1, ranges)]
    found = tokens.agg(F.percentile_approx("curve", marks, max(10_000, 20 * ranges))).first()[0] if marks else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    keyed = map_arrow(tokens.select("curve", "doc_tokens"), with_range(bounds), "curve long, doc_tokens long, part int")
    sums = {r["part"]: r["n"] for r in keyed.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()}  # one row for each range
    first, at = {}, 0
    for p in range(len(bounds) + 1):
        first[p] = at
        at += sums.get(p, 0)

    dealt = map_arrow(tokens, with_range(bounds), "doc_id long, curve long, doc_tokens long, ids binary, part int")
    dealt = dealt.withColumn("crc", F.crc32("ids")).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "curve", "doc_id", "crc")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"
    return map_arrow(dealt, _cut(first, width, with_ids), schema + (", piece binary" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every piece of every document in sequences of at most 2048 tokens."""
    from quirework.llm.common import documents

    return pack_along_curve(documents(spark, sf_dir))
