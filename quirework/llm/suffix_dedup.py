"""Removal of repeated byte strings by distributed prefix doubling (operator 7).

A byte goes when a string of ``length`` (400) bytes that covers it also starts at another
place of the corpus. Sorting the suffixes of every byte would shuffle many times the
corpus; a sample of positions that repeats find again does the same work:

* Anchors. The string that starts at p is anchored at the least (leftmost) 32-byte hash
  among its first 16/25 (256) positions. The anchor depends on the string alone, so equal strings
  have anchors at equal offsets; about one position in 128 is an anchor, with the run of
  starts it serves.
* Prefix doubling over the anchors. Round 0 ranks the 72 bytes behind an anchor; every
  further round sorts the pairs (rank at offset 0, rank at the grown offset) and ranks
  them anew: 72, 144, and then the threshold of 400 with all starts of the run. Names of
  bytes at the grown offset are hashed from the text. An anchor leaves as soon as its rank
  is unique: any string it serves shares 144 bytes behind the anchor with its equal.
* At the threshold, runs whose whole stretch is repeated are decided at once. The others -
  a few at the ends of each repeat - are compared within their rank: groups of up to 64
  stretches byte by byte, larger ones by the hashes of cells of eight neighbouring strings
  and, where a cell is neither repeated whole nor without repeats, of the single strings.

Groups are counted by partial aggregation; a hot passage is one row for each task before
its shuffle, and joins that bring ranks back are plain joins that AQE can split.

Behaviour on odd input: null text counts as empty; texts shorter than the length lose
nothing; equal rows are occurrences of each other; rows with a repeated id are told apart
by their text; null ids are allowed; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import BROADCAST_BYTES, Scratch, map_arrow, maybe_broadcast, shuffle_partitions
from quirework.llm.hashing import U64, PrefixHash, chunks, mix, stream

LENGTH = 400
GRAM = 32


def reach_of(length: int) -> int:
    """Anchor candidates of a string: its first positions, 256 of 400."""
    return length * 16 // 25


def step_of(length: int) -> int:
    """Bytes of the first rank, 72 of 400; twice as many behind an anchor are in every string it serves."""
    return (length - reach_of(length) + 1) // 2


REACH, STEP = reach_of(LENGTH), step_of(LENGTH)
#: Shorter strings have no room for a gram behind their last candidate.
LEAST_LENGTH = next(n for n in range(GRAM, LENGTH) if reach_of(n) + GRAM <= n)
PAIRWISE, CELL = 64, 8
_POSITION = 20  # bits of a position inside a buffer
BUFFER = 1 << 19

_BYTE = stream(17, 256)
_FACTORS = [int(x) | 1 for x in stream(19, 5)]

assert REACH == 256 and STEP == 72


def _grams(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the 32 bytes at each position, by five doublings."""
    h, width = _BYTE[data], 1
    for factor in _FACTORS:
        h = h[:-width] * U64(factor) + h[width:]
        width *= 2
    return h * U64(0x9E3779B97F4A7C15)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH):
    """Runs of string starts by anchor: (text index, lo, hi, anchor), positions in the buffer.

    data holds the texts end to end (starts: n + 1 offsets) and is shorter than 2**20.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    low = U64((1 << _POSITION) - 1)
    h = _grams(data)
    v = (h & ~low) | np.arange(len(h), dtype=U64)
    least = (_sliding_min(v, reach_of(length)) & low).astype(np.int64)[: len(data) - length + 1]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(least)]
    valid = np.arange(len(least)) + length <= starts[text + 1]
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~valid[1:]
    return text[lo], lo, np.flatnonzero(last), least[lo]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of several texts, or of overlapping parts of a long one: whose, offsets, bytes, part offsets."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(x for _, _, x in held), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for _, _, x in held])])
        return [i for i, _, _ in held], bounds, data, np.array([at for _, at, _ in held], dtype=np.int64)

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, BUFFER - length + 1):
            part = t[at : at + BUFFER]
            if held and size + len(part) > BUFFER:
                yield flush()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield flush()


def _binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


ANCHOR_SCHEMA = "doc_id long, text_key long, anchor int, lo int, hi int, n0 long, n1 long, stretch long"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    step = step_of(length)
    for batch in batches:
        for group in chunks(list(enumerate(_binary(batch, "__text"))), lambda r: len(r[1]) + 16, 4 << 20):
            for whose, bounds, data, offset in _pieces([t for _, t in group], length):
                text, lo, hi, q = anchors(data, bounds, length)
                if not len(lo):
                    continue
                hashes = PrefixHash(data)
                rows = np.array(whose, dtype=np.int64)[text] + group[0][0]
                shift = offset[text] - bounds[text]
                as_long = lambda x: pa.array(x.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        batch.column(1).take(pa.array(rows)),
                        *(pa.array((x + shift).astype(np.int32)) for x in (q, lo, hi)),
                        as_long(hashes.slices(q, q + step)),
                        as_long(hashes.slices(q + step, q + 2 * step)),
                        as_long(mix(hashes.slices(lo, hi + length) + (q - lo).astype(U64) * U64(0xA24BAED4963EE407))),
                    ],
                    names=["doc_id", "text_key", "anchor", "lo", "hi", "n0", "n1", "stretch"],
                )


def _stretch_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches asked for, out of each text."""
    for batch in batches:
        texts = _binary(batch, "__text")
        out: list[tuple] = []
        for doc, key, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
            out += [(a["rank"], doc, key, a["anchor"], a["lo"], a["hi"], text[a["lo"] : a["hi"] + length], a["done"]) for a in asked]
            if len(out) > 20_000:
                yield _stretch_batch(out)
                out = []
        if out:
            yield _stretch_batch(out)


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    names = ["rank", "doc_id", "text_key", "anchor", "lo", "hi", "bytes", "done"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _pairwise(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Within a rank's few stretches: which starts of each have an equal string in another."""
    for batch in batches:
        out = {"doc_id": [], "text_key": [], "lo": [], "hi": []}
        for members in batch.column(0).to_pylist():
            cut = [m["anchor"] - m["lo"] for m in members]
            data = [np.frombuffer(m["bytes"], dtype=np.uint8) for m in members]
            for i, m in enumerate(members):
                if m["done"]:
                    continue
                found = np.zeros(m["hi"] - m["lo"] + 2, dtype=np.int32)
                for j in range(len(members)):
                    if i == j:
                        continue
                    n = min(cut[i], cut[j])
                    differ = np.flatnonzero(data[i][cut[i] - n : cut[i]] != data[j][cut[j] - n : cut[j]])
                    left = n - 1 - int(differ[-1]) if len(differ) else n
                    a, b = data[i][cut[i] :], data[j][cut[j] :]
                    n = min(len(a), len(b))
                    differ = np.flatnonzero(a[:n] != b[:n])
                    right = int(differ[0]) if len(differ) else n
                    # starts at distance d before the anchor: d <= left and length - d <= right, in both runs
                    most = min(left, cut[i], cut[j])
                    least = max(length - right, cut[i] - (m["hi"] - m["lo"]), cut[j] - (members[j]["hi"] - members[j]["lo"]))
                    if least <= most:
                        found[cut[i] - most] += 1
                        found[cut[i] - least + 1] -= 1
                on = np.concatenate([[0], (np.cumsum(found) > 0).astype(np.int8)])
                edge = np.diff(on)
                for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    out["doc_id"].append(m["doc_id"])
                    out["text_key"].append(m["text_key"])
                    out["lo"].append(m["lo"] + int(s))
                    out["hi"].append(m["lo"] + int(e) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc_id"], pa.int64()), pa.array(out["text_key"], pa.int64()), pa.array(out["lo"], pa.int32()), pa.array(out["hi"], pa.int32())],
            names=list(out),
        )


def _cell_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A stretch's strings in cells of CELL neighbouring distances from the anchor.

    core names the bytes that all strings of a cell share, whole the bytes that any of them
    has (null for a cell that the stretch has in part), strings the single strings.
    """
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            lo, hi, q = row["lo"], row["hi"], row["anchor"]
            hashes = PrefixHash(np.frombuffer(row["bytes"], dtype=np.uint8))
            d = np.arange(q - hi, q - lo + 1)
            single = hashes.slices(q - d - lo, q - d - lo + length).view(np.int64)
            first = np.arange((q - hi) // CELL, (q - lo) // CELL + 1) * CELL
            core = hashes.slices(q - first - lo, q - first - lo + length - CELL + 1).view(np.int64)
            for f, c in zip(first.tolist(), core.tolist(), strict=True):
                a, b = max(f, q - hi), min(f + CELL - 1, q - lo)
                whole = None
                if b - a == CELL - 1:
                    at = np.array([q - b - lo])
                    whole = int(hashes.slices(at, at + length + CELL - 1).view(np.int64)[0])
                out.append((row["rank"], f, c, whole, row["doc_id"], row["text_key"], q, a, single[a - d[0] : b - d[0] + 1].tolist(), row["done"]))
        if out:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()]
            names = ["rank", "cell", "core", "whole", "doc_id", "text_key", "anchor", "distance", "strings", "done"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


CELL_SCHEMA = "rank long, cell int, core long, whole long, doc_id long, text_key long, anchor int, distance int, strings array<long>, done boolean"


def _crowded(stretches: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """Runs of repeated starts in ranks of many stretches.

    Cells whose core is unique hold no repeat, cells that are repeated whole are decided, and
    only the strings of the cells between - where a repeat ends - are compared one by one.
    """
    cells = scratch.save(map_arrow(stretches, lambda b: _cell_rows(b, length), CELL_SCHEMA), "cells")
    cores = cells.groupBy("rank", "cell", "core").agg(F.count("*").alias("n"), F.bool_and("done").alias("closed")).filter("n > 1 and not closed")
    alive = scratch.save(cells.join(cores.select("rank", "cell", "core"), ["rank", "cell", "core"], "left_semi"), "alive")
    wholes = alive.filter("whole is not null").groupBy("rank", "cell", "core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("distance", "strings")).alias("one"))
    wholes = scratch.save(wholes.filter("n > 1").drop("n"), "wholes")
    key = ["rank", "cell", "whole"]
    decided = alive.filter("not done").join(wholes.select(*key), key, "left_semi")
    decided = decided.select("doc_id", "text_key", (F.col("anchor") - F.col("distance") - (CELL - 1)).alias("lo"), (F.col("anchor") - F.col("distance")).alias("hi"))
    rest = scratch.save(alive.filter("not done").join(wholes.select(*key), key, "left_anti"), "rest")
    # what the strings of the rest are compared with: each other, one of each repeated cell, and decided stretches
    core = ["rank", "cell", "core"]
    sides = wholes.select(*core, "one.distance", "one.strings").unionByName(alive.filter("done").join(wholes.select(*key), key, "left_anti").select(*core, "distance", "strings"))
    sides = sides.join(rest.select(*core).distinct(), core, "left_semi").select("rank", "distance", "strings")
    spread = lambda df, *more: df.select("rank", *more, "distance", F.posexplode("strings").alias("k", "string")).withColumn("distance", F.col("distance") + F.col("k")).drop("k")
    open_strings = scratch.save(spread(rest, "doc_id", "text_key", "anchor"), "strings")
    one = ["rank", "distance", "string"]
    twice = open_strings.select(*one).unionByName(spread(sides).select(*one)).groupBy(*one).agg(F.count("*").alias("n")).filter("n > 1").select(*one)
    found = open_strings.join(twice, one, "left_semi")
    start = F.col("anchor") - F.col("distance")
    return decided.unionByName(found.select("doc_id", "text_key", start.alias("lo"), start.alias("hi")))


def _rank(positions: DataFrame, key: list[str], scratch: Scratch, table: str) -> DataFrame:
    """One doubling round: sorts the distinct pairs, ranks those of two or more positions, keeps these."""
    pairs = positions.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1")
    ranked = pairs.select(*key).sort(*key).withColumn("__rank", F.monotonically_increasing_id())
    ranked = scratch.save(ranked, f"{table}-ranks")
    kept = positions.join(ranked, key).drop(*(k for k in key if k != "stretch")).withColumnRenamed("__rank", "rank")
    return scratch.save(kept, table)


def repeated_starts(source: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, lo, hi): runs of starts whose ``length`` bytes also start elsewhere.

    source: doc_id long, text_key long, __text string.
    """
    found = map_arrow(source, lambda b: _anchor_rows(b, length), ANCHOR_SCHEMA)
    at = _rank(found, ["n0"], scratch, "round-0")
    scratch.drop("round-0-ranks")
    at = _rank(at, ["rank", "n1"], scratch, "round-1")
    scratch.drop("round-0", "round-1-ranks")

    entry = F.struct("doc_id", "text_key", "anchor", "lo", "hi")
    whole = at.groupBy("rank", "stretch").agg(F.count("*").alias("n"), F.min(entry).alias("first"))
    whole = whole.withColumn("done", F.col("n") > 1)
    open_ranks = whole.groupBy("rank").agg(F.count("*").alias("stretches"), F.bool_and("done").alias("closed"))
    whole = scratch.save(whole, "stretches")
    open_ranks = scratch.save(open_ranks.filter("not closed and stretches > 1"), "open")
    done = at.join(whole.filter("done").select("rank", "stretch"), ["rank", "stretch"], "left_semi")
    done = scratch.save(done.select("doc_id", "text_key", "lo", "hi"), "done")

    # of an open rank: the undecided positions, each alone with its stretch, and one position of each decided
    # stretch to compare them with
    firsts = whole.join(open_ranks.select("rank"), "rank", "left_semi")
    asked = firsts.select("rank", "first.*", "done")
    asked = asked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("rank", "anchor", "lo", "hi", "done")).alias("asked"))
    asked = scratch.save(asked, "asked")
    wanted = source.alias("s").join(
        maybe_broadcast(asked.select("doc_id", "text_key"), 32).alias("a"),
        F.col("s.text_key").eqNullSafe(F.col("a.text_key")) & F.col("s.doc_id").eqNullSafe(F.col("a.doc_id")),
        "left_semi",
    )
    # equal rows with an equal id ask for the same bytes: one of them will do
    texts = wanted.alias("s").join(asked.alias("a"), F.col("s.text_key").eqNullSafe(F.col("a.text_key")) & F.col("s.doc_id").eqNullSafe(F.col("a.doc_id")))
    texts = texts.select("s.doc_id", "s.text_key", "s.__text", "a.asked")
    stretches = map_arrow(texts, lambda b: _stretch_rows(b, length), "rank long, doc_id long, text_key long, anchor int, lo int, hi int, bytes binary, done boolean")
    stretches = scratch.save(stretches.join(open_ranks.select("rank", "stretches"), "rank"), "bytes")

    # comparing takes time by pairs, not by bytes: as many tasks as the session deals out, not as few as the bytes ask for
    few = stretches.filter(F.col("stretches") <= PAIRWISE).repartition(shuffle_partitions(source.sparkSession), "rank").groupBy("rank")
    few = few.agg(F.collect_set(F.struct("doc_id", "text_key", "anchor", "lo", "hi", "bytes", "done")).alias("members"))
    starts = scratch.save(map_arrow(few.select("members"), lambda b: _pairwise(b, length), "doc_id long, text_key long, lo int, hi int"), "pairwise")
    crowded = _crowded(stretches.filter(F.col("stretches") > PAIRWISE), scratch, length)
    return done.unionByName(starts).unionByName(crowded)


def _merge(spans, length: int) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((x["lo"], x["hi"] + length) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def _span_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of starts, some hundred in a long text, to the few spans of bytes they remove."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        spans = [[{"lo": lo, "hi": hi} for lo, hi in _merge(runs, length)] for runs in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], names=["doc_id", "text_key", "__spans"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row number, byte counts, digest and text of what is left."""
    for batch in batches:
        texts = _binary(batch, "__text")
        spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
        for part in chunks(list(range(len(texts))), lambda i: len(texts[i]) + 256, 8 << 20):
            counts, removed, runs, digests, kept = [], [], [], [], []
            for i in part:
                t, cuts = texts[i], spans[i] or []
                at, left = 0, []
                for cut in cuts:
                    left.append(t[at : cut["lo"]])
                    at = cut["hi"]
                left.append(t[at:])
                rest = b"".join(left) if cuts else t
                counts.append(len(t))
                removed.append(len(t) - len(rest))
                runs.append(len(cuts))
                digests.append(hashlib.sha256(rest).hexdigest())
                # a cut may split a character: what is left of it on either side goes too
                kept.append("".join(x.decode("utf-8", "ignore") for x in left))
            held = batch.slice(part[0], len(part))
            base = [held.column(i) for i, n in enumerate(held.schema.names) if n not in ("__text", "__spans")]
            names = [n for n in held.schema.names if n not in ("__text", "__spans")]
            yield pa.RecordBatch.from_arrays(
                [*base, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(kept)],
                names=[*names, "__n_bytes", "__n_removed", "__n_spans", "__sha", "__kept"],
            )


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, length: int = LENGTH) -> DataFrame:
    """All columns of df, its text without repeated bytes, and n_bytes, n_removed, n_spans, kept_sha256.

    A character that loses some of its bytes is left out of the text; kept_sha256 is of the
    remaining bytes. with_text=False returns the id and the counts alone. A column of df
    named like one of the counts is replaced by it. length: bytes of a string, LEAST_LENGTH at least.
    """
    if length < LEAST_LENGTH:
        raise ValueError(f"length {length} is under {LEAST_LENGTH}")
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    number = F.col(f"`{doc_id}`").cast("long")
    key = F.xxhash64(body, F.length(body))
    source = df.select(number.alias("doc_id"), key.alias("text_key"), body.alias("__text"))
    starts = repeated_starts(source.filter(F.octet_length("__text") >= length), scratch, length)
    spans = starts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))
    kind = "doc_id long, text_key long, __spans array<struct<lo:int,hi:int>>"
    spans = scratch.save(map_arrow(spans, lambda b: _span_rows(b, length), kind), "spans")
    scratch.drop(*(t for t in list(scratch.paths) if t != "spans"))

    counts = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    carried = [c for c in df.columns if c not in (text, *counts)] if with_text else [doc_id]
    inner = {c: f"__c{i}" for i, c in enumerate(carried)}
    left = df.select(*(F.col(f"`{c}`").alias(a) for c, a in inner.items()), body.alias("__text"), number.alias("__id"), key.alias("__key"))
    total = spans.agg(F.sum(F.size("__spans") * 40 + 128)).first()[0] or 0
    side = F.broadcast(spans) if total <= BROADCAST_BYTES else spans.hint("merge")
    joined = left.join(side, left["__id"].eqNullSafe(side["doc_id"]) & left["__key"].eqNullSafe(side["text_key"]), "left")
    joined = joined.select(*inner.values(), "__text", "__spans")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    added = [("__n_bytes", LongType()), ("__n_removed", LongType()), ("__n_spans", LongType()), ("__sha", StringType()), ("__kept", StringType())]
    schema = StructType([joined.schema[a] for a in inner.values()] + [StructField(n, t) for n, t in added])
    cut = map_arrow(joined, _cut_rows, schema)
    named = [F.col(f"__{n}").alias(n) for n in counts[:3]] + [F.col("__sha").alias("kept_sha256")]
    if not with_text:
        return cut.select(F.col(inner[doc_id]).alias(doc_id), *named)
    return cut.select(*(F.col("__kept").alias(text) if c == text else F.col(inner[c]).alias(c) for c in df.columns if c not in counts), *named)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: what every document loses to strings repeated anywhere, and the text that is left."""
    from quirework.llm.common import documents

    left = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
