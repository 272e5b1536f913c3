"""Training-order materialisation (operator 8).

Documents are tokenised and laid end to end in the order of their ids; every ``stride``
tokens are one sequence. A keyed Feistel permutation of the sequence numbers - a balanced
network over the next even number of bits, walked along its cycle until it lands inside
the range - gives each sequence a slot, the same on every machine and after every restart,
without a table of the permutation. Slots are dealt in ranges to shards; a shard is a file
of fixed-stride records, so the record of a slot lies at a known byte and a reader resumes
at any slot with one seek.

Texts are tokenised once, into a table of compressed ids. Its counts give every document
its first position, and its ids then go in compressed pieces straight to the shards of
their slots, crossing the network once. A shard is written to a temporary name and renamed,
by any attempt alike: a lost executor repeats its shards and nothing else.

Behaviour on odd input: a null or empty text is its end id alone; long texts run over many
sequences; the last sequence is filled with the padding id; repeated rows are laid one after
another; null ids come first; an empty table gives no sequence and no shard; other columns
are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.common import Scratch, map_arrow, maybe_broadcast, shuffle_partitions
from quirework.llm.hashing import U64, chunks, mix
from quirework.llm.token_ids import coder, tokenizer_path

STRIDE = 2048
END, PAD = 1, 0
ROUNDS = 6
LEVEL = 3
KEY = 0x5DEECE66D
SHARD_SEQUENCES = 2048  # 8 MB a shard
RANGE_ROWS = 1 << 20
MOST_TASKS = 20_000
COPY_BLOCK = 256


def feistel(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. n-1, element by element."""
    if n <= 1:
        return np.zeros_like(numbers)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U64) + U64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << U64(half)) | right

    out = once(numbers.astype(U64))
    outside = out >= U64(n)
    while outside.any():
        out[outside] = once(out[outside])
        outside = out >= U64(n)
    return out.astype(np.int64)


def unfeistel(slots: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The sequence number of each slot."""
    if n <= 1:
        return np.zeros_like(slots)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U64) + U64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U64(half), x & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & mask), left
        return (left << U64(half)) | right

    out = once(slots.astype(U64))
    outside = out >= U64(n)
    while outside.any():
        out[outside] = once(out[outside])
        outside = out >= U64(n)
    return out.astype(np.int64)


def _encoded(path: str):
    """Number and compressed 16-bit ids of each text, its end id with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = coder(path), zstandard.ZstdCompressor(level=LEVEL).compress
        end = np.array([END], dtype="<u2").tobytes()
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            at = 0
            for part in chunks(texts, lambda t: len(t) + 64, 1 << 20):
                held = [x + end for x in encoder.encode(part)]
                keys = [batch.column(i).slice(at, len(part)) for i in (0, 1)]
                at += len(part)
                sizes = pa.array([len(x) // 2 for x in held], pa.int64())
                yield pa.RecordBatch.from_arrays([*keys, sizes, pa.array([pack(x) for x in held], pa.binary())], names=["doc_id", "text_key", "n", "ids"])

    return run


def _pieces(total: int, stride: int, key: int, shard: int):
    """Cuts each document's ids at sequence ends: (shard, slot, sequence_id, at, ids)."""
    n = -(-total // stride)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sequence, offset, held = [], [], []
            for first, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = unpack(packed)
                size, at = len(ids) // 2, 0
                while at < size:
                    where = (first + at) % stride
                    length = min(size - at, stride - where)
                    sequence.append((first + at) // stride)
                    offset.append(where)
                    held.append(pack(ids[2 * at : 2 * (at + length)]))
                    at += length
            numbers = np.array(sequence, dtype=np.int64)
            slots = feistel(numbers, n, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // shard), pa.array(slots), pa.array(numbers), pa.array(offset, pa.int32()), pa.array(held, pa.binary())],
                names=["shard", "slot", "sequence_id", "at", "ids"],
            )

    return run


def _records(stride: int):
    """Whole records, out of pieces in the order of (shard, slot, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad, unpack = np.array([PAD], dtype="<u2").tobytes(), zstandard.ZstdDecompressor().decompress
        names = ["shard", "slot", "sequence_id", "n_tokens", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        slot, held, out = None, [], []

        def close() -> None:
            body = b"".join(held)
            out.append((*slot, len(body) // 2, body + pad * (stride - len(body) // 2)))

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for shard, s, number, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if slot is None or slot[1] != s:
                    if slot is not None:
                        close()
                    slot, held = (shard, s, number), []
                held.append(unpack(ids))
                if len(out) >= 1024:
                    yield batch_of(out)
                    out = []
        if slot is not None:
            close()
        if out:
            yield batch_of(out)

    return run


def training_sequences(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", stride: int = STRIDE, key: int = KEY, shard_sequences: int = SHARD_SEQUENCES, tokenizer: str | None = None
) -> DataFrame:
    """(shard, slot, sequence_id, n_tokens, payload): every sequence at its slot, ordered by slot inside each shard.

    payload: stride ids as little-endian unsigned 16-bit numbers.
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "training-order")
    path = tokenizer or tokenizer_path()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body, F.length(body)).alias("text_key"), body.alias("__text"))
    tokens = scratch.save(map_arrow(source, _encoded(path), "doc_id long, text_key long, n long, ids binary"), "tokens")
    # equal rows have equal keys: they get one range of positions and share it out by number
    distinct = tokens.groupBy("doc_id", "text_key").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    distinct = scratch.save(distinct, "distinct")
    rows, total = distinct.agg(F.count("*"), F.sum(F.col("n") * F.col("copies"))).first()
    total = total or 0
    # ranges by id and text: neither null ids nor one id with many texts are a range of their own
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key").asc()]
    ranges = int(min(MOST_TASKS, max(1, shuffle_partitions(spark), -(-rows // RANGE_ROWS))))
    ranged = scratch.save(distinct.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sums = {r["part"]: r["s"] for r in ranged.groupBy("part").agg(F.sum(F.col("n") * F.col("copies")).alias("s")).collect()}
    first, at = [], 0
    for p in sorted(sums):
        first.append((p, at))
        at += sums[p]
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = spark.createDataFrame(first, "part int, base long")
    starts = ranged.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("copies")).over(inside), F.lit(0))).join(F.broadcast(base), "part")
    starts = starts.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), (F.col("base") + F.col("before")).alias("__start"), "n", "copies")
    starts = scratch.save(starts, "starts")
    scratch.drop("distinct", "ranged")

    same = tokens["doc_id"].eqNullSafe(F.col("__id")) & (tokens["text_key"] == F.col("__key"))
    # one row of equal ones speaks for all of them, at every copy's position
    repeated = starts.filter("copies > 1").withColumnRenamed("n", "size")
    single = tokens.join(maybe_broadcast(starts.filter("copies = 1").drop("n"), 32), same).select(F.col("__start").alias("start"), "ids")
    many = tokens.join(maybe_broadcast(repeated, 40), same).dropDuplicates(["__id", "__key"])
    # copies in blocks, so that one text with very many of them is not one task
    many = many.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPY_BLOCK)))).repartition("__id", "__key", "block")
    last = F.least(F.col("block") + (COPY_BLOCK - 1), F.col("copies") - 1)
    many = many.withColumn("copy", F.explode(F.sequence(F.col("block"), last)))
    placed = single.unionByName(many.select((F.col("__start") + F.col("copy") * F.col("size")).alias("start"), "ids"))
    pieces = map_arrow(placed, _pieces(total, stride, key, shard_sequences), "shard long, slot long, sequence_id long, at int, ids binary")
    shards = -(-(-(-total // stride)) // shard_sequences)
    # ranges of neighbouring shards: a task writes a stretch of the order
    tasks = int(max(1, min(shards, MOST_TASKS)))
    each = -(-shards // tasks) or 1
    ordered = pieces.repartitionById(tasks, (F.col("shard") / each).cast("int")).sortWithinPartitions("shard", "slot", "at")
    return map_arrow(ordered, _records(stride), "shard long, slot long, sequence_id long, n_tokens int, payload binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _filesystem(target: str):
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(target)
    return found, path


def write_shards(sequences: DataFrame, target: str, stride: int = STRIDE, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """Writes each shard as one file below target, a folder that all executors see, and reads it back.

    Returns (shard, slot, sequence_id, n_tokens, offset, crc32) of every record as read from
    the file. A shard's file is complete or absent: it is written aside and renamed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _filesystem(target)
        store.create_dir(top, recursive=True)

        def finish(shard: int, rows: list[tuple[int, int, int]], stream, aside: str) -> pa.RecordBatch:
            stream.close()
            final = f"{top}/{shard_name(shard)}"
            store.move(aside, final)
            with store.open_input_stream(final) as f:
                data = f.read()
            crcs = [zlib.crc32(data[2 * stride * i : 2 * stride * (i + 1)]) for i in range(len(rows))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(rows), pa.int64()),
                    *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))),
                    pa.array([2 * stride * i for i in range(len(rows))], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                names=["shard", "slot", "sequence_id", "n_tokens", "offset", "crc32"],
            )

        shard, rows, stream, aside = None, [], None, ""
        for batch in batches:
            for s, slot, number, n, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard:
                    if shard is not None:
                        yield finish(shard, rows, stream, aside)
                    shard, rows, aside = s, [], f"{top}/.{shard_name(s)}-{uuid.uuid4().hex}"
                    stream = store.open_output_stream(aside)
                stream.write(payload)
                rows.append((slot, number, n))
        if shard is not None:
            yield finish(shard, rows, stream, aside)

    return map_arrow(sequences, run, "shard long, slot long, sequence_id long, n_tokens int, offset long, crc32 long")


def read_slots(target: str, first: int, count: int, stride: int = STRIDE, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """Sequences of slots first, first + 1, ...: one seek, then a sequential read, shard after shard."""
    store, top = _filesystem(target)
    while count > 0:
        shard, at = divmod(first, shard_sequences)
        with store.open_input_file(f"{top}/{shard_name(shard)}") as f:
            f.seek(2 * stride * at)
            n = min(count, shard_sequences - at)
            data = f.read(2 * stride * n)
        got = len(data) // (2 * stride)
        yield from np.frombuffer(data, dtype="<u2").reshape(got, stride)
        if got < n:
            return
        first, count = first + n, count - n


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the record of every slot, as read back from the shard files."""
    from quirework.llm.common import documents, shared_root

    target = f"{shared_root(spark)}/quirework-shards-{uuid.uuid4().hex[:12]}"
    return write_shards(training_sequences(documents(spark, sf_dir)), target)
