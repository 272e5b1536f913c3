"""Near-duplicate groups by HyperMinHash (operator 5).

Every text becomes its set of 5-word shingles (A-Z lower-cased). A set's sketch has one
register for each hash function: the leading-zero count of the function's least value
and the mantissa bits behind the leading one, packed into 16 bits. Every function sees
every shingle, so the sketch of a one-shingle set has no empty register.

1. Equal sets form a class, named by 64 bits and told apart by 128; from here on a class
   counts once, however many copies it has.
2. Compressed registers, three to a band, give 21 band keys; classes that share a key are
   candidates. A pair at similarity 0.85 shares none with probability 2e-9.
3. In each bucket, every member is tested against one centre, the member that lies in the
   most populous buckets: the original of a crowd of copies. Linked classes are merged.
4. All members of a bucket share its centre, so the pairs not tested yet lie around common
   centres. Where several merged groups meet around one, the members outside the largest
   group are compared with all members of other groups, a block of members with another at
   a time; a block pair gives the links that join groups, not its pairs.
5. Every comparison is the collision-corrected Jaccard estimate of the registers (a margin
   of five standard errors under the threshold), then the exact test on full shingle sets.

No bucket is capped, no row holds a bucket and no bucket is expanded into its pairs; pairs
inside one group are left out, as another link cannot change the groups.

Behaviour on odd input: a null, empty or blank text has no shingle, links with nothing
and is kept; fewer than five words are one shingle; equal rows are copies; rows with a
null id take part, and their group's id is the least non-null one (null if none); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import Scratch, map_arrow, maybe_broadcast
from quirework.llm.components import connected_components
from quirework.llm.hashing import U64, Batch, chunks, mix, owners, stream, windows

SHINGLE = 5
BANDS, ROWS = 21, 3
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Members of a block whose sketches are compared, shingles of a block whose sets are.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 18
CHUNK_BYTES = 1 << 19

_MULTIPLIERS = stream(11, REGISTERS) | U64(1)
_BAND = stream(13, REGISTERS) | U64(1)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and the n + 1 bounds between texts."""
    b = Batch(texts, lower=True)
    counts = b.n_words()
    grams = windows(b.words, width)
    text_of = owners(b.word_of, len(b.words))
    at = np.arange(len(grams))
    at = at[text_of[at] == text_of[at + width - 1]] if len(grams) else at
    keys, whose = grams[at], text_of[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), dtype=U64)
        for i, t in enumerate(short):
            held = b.words[b.word_of[t] : b.word_of[t + 1]]
            extra[i] = windows(held, len(held))[0] + U64(len(held))
        keys, whose = np.concatenate([keys, mix(extra)]), np.concatenate([whose, short])
    order = np.lexsort((keys, whose))
    keys, whose = keys[order], whose[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])
    keys, whose = keys[first], whose[first]
    return keys, np.searchsorted(whose, np.arange(b.n + 1))


def compress(least: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """A 64-bit minimum as leading-zero count (6 bits) and the mantissa bits after the leading one."""
    value = least | U64(1)
    zeros = np.zeros(value.shape, dtype=U64)
    rest = value.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < U64(1 << (64 - step))
        zeros += np.where(low, U64(step), U64(0))
        rest = np.where(low, rest << U64(step), rest)
    bits = (rest << U64(1)) >> U64(64 - mantissa)
    return ((zeros << U64(mantissa)) | bits).astype(np.uint16)


def digests(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values for each set, equal for equal sets: the class, and a check of it."""
    sums = []
    for salt in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(keys ^ U64(salt)), dtype=U64)])
        sums.append(total[bounds[1:]] - total[bounds[:-1]])
    size = np.diff(bounds).astype(U64)
    return mix(sums[0] + mix(sums[1]) + size), mix(sums[2] ^ mix(sums[1] + size))


def sketch(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (texts x REGISTERS) of non-empty sets; empty sets get zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, REGISTERS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[full]
        least = np.empty((len(full), REGISTERS), dtype=U64)
        for j in range(REGISTERS):
            h = keys * _MULTIPLIERS[j]
            h ^= h >> U64(29)
            least[:, j] = np.minimum.reduceat(h, at)
        out[full] = compress(least)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of compressed registers."""
    weighted = (registers.astype(U64) + U64(1)) * _BAND
    return mix(weighted.reshape(len(registers), BANDS, ROWS).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64))


def collision_rate(n: float, m: float) -> float:
    """Chance that a register of two disjoint sets of n and m shingles is equal.

    Summed over the register's cells: a cell of width w at height x of the unit interval
    holds both minima with probability about (n w e**(-n x)) (m w e**(-m x)).
    """
    zeros = np.arange(0, 40)[:, None]
    steps = np.arange(0, 1 << MANTISSA, 1 << (MANTISSA - 4))[None, :] + (1 << (MANTISSA - 5))
    top = 2.0 ** -(zeros + 1.0)
    width = top / (1 << MANTISSA)
    x = top + steps * width
    return float(np.sum(n * m * width * width * np.exp(-(n + m) * x)) * (1 << (MANTISSA - 4)))


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from counts of equal registers, corrected for accidental equality."""
    rates = np.array([collision_rate(2.0**a, 2.0**b) for a in range(40) for b in range(40)]) if not _RATES else None
    if rates is not None:
        _RATES.append(rates.reshape(40, 40))
    la = np.clip(np.log2(np.maximum(n, 1)).round().astype(int), 0, 39)
    lb = np.clip(np.log2(np.maximum(m, 1)).round().astype(int), 0, 39)
    chance = np.minimum(_RATES[0][la, lb], 0.5)
    return (equal / REGISTERS - chance) / (1 - chance)


_RATES: list[np.ndarray] = []


def floor_estimate(percent: int) -> float:
    """Least estimate that a pair at the threshold may show: five standard errors below."""
    j = percent / 100
    return j - 5 * (j * (1 - j) / REGISTERS) ** 0.5


# --- stage functions -------------------------------------------------------------------


def _texts(batch: pa.RecordBatch, column: str = "__text") -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(list(enumerate(_texts(batch))), lambda r: len(r[1]) + 64, CHUNK_BYTES):
            keys, bounds = shingle_sets([t for _, t in part])
            sizes = np.diff(bounds)
            registers = sketch(keys, bounds)
            named, check = digests(keys, bounds)
            ids, text_keys = (batch.column(i).slice(part[0][0], len(part)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    text_keys,
                    pa.array(sizes),
                    pa.array(named.view(np.int64)),
                    pa.array(check.view(np.int64)),
                    pa.array([r.tobytes() if s else None for r, s in zip(registers, sizes, strict=True)], type=pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "class", "check", "registers"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets; a text that is not of the class asked for (its id is repeated) is left out."""
    for batch in batches:
        for part in chunks(list(enumerate(_texts(batch))), lambda r: len(r[1]) + 64, CHUNK_BYTES):
            keys, bounds = shingle_sets([t for _, t in part])
            shingles = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))
            asked, check = (batch.column(i).slice(part[0][0], len(part)) for i in (0, 1))
            same = pa.array(check.to_numpy() == digests(keys, bounds)[1].view(np.int64))
            yield pa.RecordBatch.from_arrays([asked, shingles], names=["class", "shingles"]).filter(same)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(registers)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "class"]
        )


def _side(members: list[dict]):
    ids = np.array([m["class"] for m in members], dtype=np.int64)
    groups = np.array([m["component"] for m in members], dtype=np.int64)
    sizes = np.array([m["n_shingles"] for m in members], dtype=np.int64)
    return ids, groups, sizes, np.frombuffer(b"".join(m["registers"] for m in members), dtype=np.uint16).reshape(-1, REGISTERS)


def _near(a, b, percent: int) -> np.ndarray:
    """Members of two blocks that may be linked: other groups, sizes and estimate near enough, a band in common."""
    (_, ga, na, ra), (_, gb, nb, rb) = a, b
    equal = np.zeros((len(na), len(nb)), dtype=np.uint8)
    shared = np.zeros(equal.shape, dtype=bool)
    for band in range(BANDS):
        whole = np.ones(equal.shape, dtype=bool)
        for j in range(band * ROWS, band * ROWS + ROWS):
            same = ra[:, j][:, None] == rb[:, j][None, :]
            equal += same
            whole &= same
        shared |= whole
    near = shared & (ga[:, None] != gb[None, :])
    near &= 100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)
    x, y = np.nonzero(near)
    near[x, y] = estimate(equal[x, y], na[x], nb[y]) >= floor_estimate(percent)
    return near


def _block_candidates(percent: int):
    """(centre, class) of the members of two blocks that have a possible link between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = _side(row["minor"]), _side(row["members"])
                near = _near(a, b, percent)
                found = np.unique(np.concatenate([a[0][near.any(axis=1)], b[0][near.any(axis=0)]]))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["centre"])), pa.array(found)], names=["centre", "class"])

    return run


def _block_links(percent: int):
    """Links between two blocks, as many as join their groups: checked on full sets."""

    def matrix(members: list[dict], common: np.ndarray) -> np.ndarray:
        out = np.zeros((len(members), len(common)), dtype=np.float32)
        for i, m in enumerate(members):
            keys = np.array(m["shingles"], dtype=np.int64)
            at = np.searchsorted(common, keys)
            at = at[(at < len(common)) & (common[np.minimum(at, len(common) - 1)] == keys)] if len(common) else at[:0]
            out[i, at] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = _side(row["minor"]), _side(row["members"])
                near = _near(a, b, percent)
                rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(rows):
                    continue
                left, right = [row["minor"][i] for i in rows], [row["members"][j] for j in columns]
                # only shingles on both sides can be common to a pair
                common = np.intersect1d(np.concatenate([m["shingles"] for m in left]), np.concatenate([m["shingles"] for m in right]))
                both = np.zeros((len(left), len(right)), dtype=np.float32)
                for at in range(0, len(common), 8192):
                    part = common[at : at + 8192]
                    both += matrix(left, part) @ matrix(right, part).T
                na, nb = a[2][rows], b[2][columns]
                both = both.astype(np.int64)
                linked = near[np.ix_(rows, columns)] & (100 * both >= percent * (na[:, None] + nb[None, :] - both))
                parent: dict[int, int] = {}

                def top(x: int, parent=parent) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                u, v = [], []
                for i, j in zip(*np.nonzero(linked), strict=True):
                    g, h = top(int(a[1][rows[i]])), top(int(b[1][columns[j]]))
                    if g != h:
                        parent[g] = h
                        x, y = int(a[0][rows[i]]), int(b[0][columns[j]])
                        u.append(max(x, y))
                        v.append(min(x, y))
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _star_pairs(percent: int):
    least = floor_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v, na, nb = (batch.column(i).to_numpy() for i in range(4))
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            near = estimate((ra == rb).sum(axis=1), na, nb) >= least
            near &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            yield pa.RecordBatch.from_arrays([pa.array(u[near]), pa.array(v[near])], names=["u", "v"])

    return run


# --- the operator -----------------------------------------------------------------------


def _sets(nodes: DataFrame, source: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, shingles) of the classes named, from the text of a row of each."""
    wanted = nodes.join(classes.select("class", "check", F.col("first_id").alias("wanted_id")), "class")
    texts = source.join(maybe_broadcast(wanted, 32), source["doc_id"].eqNullSafe(wanted["wanted_id"])).select("class", "check", "__text")
    return map_arrow(texts, _set_rows, "class long, shingles array<long>").dropDuplicates(["class"])


def _verified(pairs: DataFrame, source: DataFrame, classes: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """Pairs (u, v) of classes whose full shingle sets have 100 * intersection >= percent * union."""
    nodes = scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct(), f"{name}-nodes")
    sets = scratch.save(_sets(nodes, source, classes), f"{name}-sets")
    both = pairs.join(sets.select(F.col("class").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("class").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    links = both.filter(F.lit(100) * common >= F.lit(percent) * (F.size("a") + F.size("b") - common)).select("u", "v")
    links = scratch.save(links, f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-nodes")
    return links


def _block_pairs(around: DataFrame, entry: list[str], weight: Column, most: int) -> DataFrame:
    """(centre, minor, members): a block of minor members beside a block of any, blocks of about ``most`` weight."""
    spread = around.groupBy("centre", "minor").agg(F.sum(weight).alias("total"))
    blocks = around.join(spread, ["centre", "minor"]).withColumn("block", F.pmod(F.xxhash64("class"), F.ceil(F.col("total") / most)))
    arrays = blocks.groupBy("centre", "minor", "block").agg(F.collect_list(F.struct(*entry)).alias("held"))
    left = arrays.filter("minor").select("centre", F.col("held").alias("minor"))
    return left.join(arrays.select("centre", F.col("held").alias("members")), "centre")


def text_key(text: Column) -> Column:
    """64 bits that tell texts under one id apart."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(body, F.length(body))


def near_duplicates(df: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, group_id, text_key) of every row.

    class_id names equal shingle sets (null for the empty set); component_id is the least
    doc_id reachable over links with 100 * intersection >= percent * union; kept marks the
    rows whose id it is; group_id names the group also where ids are null or in several
    groups (null for the empty set).
    """
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "near-dedup")
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))
    keyed = source.select("doc_id", text_key(F.col("__text")).alias("text_key"), "__text")
    rows = scratch.save(map_arrow(keyed, _sketch_rows, "doc_id long, text_key long, n_shingles long, class long, check long, registers binary"), "rows")

    # the sketch is a function of the set: any member's will do
    facts = [F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")]
    classes_of = lambda r: r.filter("n_shingles > 0").groupBy("class").agg(*facts, F.min("check").alias("check"), F.max("check").alias("other"))
    classes = scratch.save(classes_of(rows), "classes")
    twins = classes.filter("check <> other").select("class", "check")
    if not twins.isEmpty():
        # unlike sets under one 64-bit class: all but one of them get names from both values
        twins = maybe_broadcast(scratch.save(twins.withColumnRenamed("check", "__first"), "twins"), 16)
        renamed = F.when(F.col("__first") != F.col("check"), F.xxhash64("class", "check")).otherwise(F.col("class"))
        rows = rows.join(twins, "class", "left").withColumn("class", renamed).select(*rows.columns)
        rows = scratch.save(rows, "rows-apart")
        classes = scratch.save(classes_of(rows), "classes-apart")
    classes = classes.drop("other")

    banded = map_arrow(classes.select("class", "registers"), _band_rows, "bucket long, class long")
    crowd = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.save(banded.join(crowd, "bucket"), "members")
    weight = members.groupBy("class").agg(F.sum("size").alias("weight"))
    weighed = members.join(weight, "class")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "class")).alias("top")).select("bucket", F.col("top.class").alias("centre"))
    centres = scratch.save(centres, "centres")
    # who meets around a centre: the other members of its buckets
    met = scratch.save(members.join(centres, "bucket").filter("class <> centre").select("centre", "class").distinct(), "met")
    tested = scratch.save(met.select(F.greatest("class", "centre").alias("u"), F.least("class", "centre").alias("v")).distinct(), "star")

    def sides(pairs: DataFrame) -> DataFrame:
        """Adds size and sketch of both ends."""
        a = classes.select(F.col("class").alias("u"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
        b = classes.select(F.col("class").alias("v"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "na", "nb", "ra", "rb")

    near = scratch.save(map_arrow(sides(tested), _star_pairs(percent), "u long, v long"), "near")
    links = _verified(near, source, classes, scratch, "star", percent)
    merged = connected_components(links, scratch, "merged")

    # each with its merged group
    around = met.join(merged.withColumnRenamed("node", "class"), "class", "left")
    around = around.select("centre", "class", F.coalesce("component", "class").alias("component"))
    counts = around.groupBy("centre", "component").agg(F.count("*").alias("n"))
    major = counts.groupBy("centre").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    mixed = around.join(major.select("centre", F.col("top.component").alias("major")), "centre")
    mixed = mixed.join(classes.select("class", "n_shingles", "registers"), "class")
    mixed = scratch.save(mixed.withColumn("minor", F.col("component") != F.col("major")).drop("major"), "mixed")
    entry = ["class", "component", "n_shingles", "registers"]
    pairs = _block_pairs(mixed, entry, F.lit(1), BLOCK).select("centre", "minor", "members")
    found = scratch.save(map_arrow(pairs, _block_candidates(percent), "centre long, class long").distinct(), "found")
    sets = scratch.save(_sets(found.select("class").distinct(), source, classes), "found-sets")
    close = mixed.join(found, ["centre", "class"], "left_semi").join(sets, "class")
    pairs = _block_pairs(close, [*entry, "shingles"], F.col("n_shingles"), BLOCK_SHINGLES).select("minor", "members")
    more = scratch.save(map_arrow(pairs, _block_links(percent), "u long, v long").distinct(), "more")
    final = connected_components(links.unionByName(more), scratch, "final")

    label = classes.select("class", "first_id").join(final.withColumnRenamed("node", "class"), "class", "left")
    label = label.withColumn("component", F.coalesce("component", "class"))
    least = label.groupBy("component").agg(F.min("first_id").alias("component_id"))
    label = scratch.save(label.join(least, "component").select("class", "component_id", F.col("component").alias("group_id")), "label")
    result = rows.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class_id"))
    result = result.join(label.select(F.col("class").alias("class_id"), "component_id", "group_id"), "class_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = result.select("doc_id", "n_shingles", component.alias("component_id"), "class_id", "group_id", "text_key")
    result = result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    scratch.drop(*(t for t in list(scratch.paths) if t not in ("rows", "rows-apart", "label")))
    return result.select("doc_id", "n_shingles", "component_id", "kept", "class_id", "group_id", "text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's shingle count, group and whether it stays."""
    from quirework.llm.common import documents

    return near_duplicates(documents(spark, sf_dir)).drop("class_id", "group_id", "text_key")
