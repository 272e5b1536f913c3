"""Functions that Spark lacks: word-level edit distance, longest common subsequence, raster measurement, fingerprints.

Arrow UDFs over whole batches; everything else in the engine is builtin expressions.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

WER_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and substitutions; one numpy row at a time."""
    if not a or not b:
        return max(len(a), len(b))
    names: dict = {}
    x = np.array([names.setdefault(w, len(names)) for w in a])
    y = np.array([names.setdefault(w, len(names)) for w in b])
    row = np.arange(len(y) + 1)
    steps = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        best = np.minimum(row[:-1] + (y != w), row[1:] + 1)
        # a run of insertions: the least of (value - position) so far, plus the position
        row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
    return int(row[-1])


@F.pandas_udf(LongType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between the words of two texts."""
    return pd.Series([None if x is None or y is None else edit_distance(WER_TOKEN.findall(x), WER_TOKEN.findall(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def token_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between white-space-separated words, case kept."""
    return pd.Series([None if x is None or y is None else edit_distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int64")


def common_subsequence(a: list, b: list) -> int:
    """Length of a longest common subsequence: a bit for each word of a, a row of bits for each word of b.

    Space is linear: only rows of words that make up a 64th of a or more are kept.
    """
    n = len(a)
    places: dict = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    frequent: dict = {}

    def bits(w) -> int:
        if w in frequent:
            return frequent[w]
        marks = bytearray(n // 8 + 1)
        for i in places[w]:
            marks[i >> 3] |= 1 << (i & 7)
        row = int.from_bytes(marks, "little")
        if 64 * len(places[w]) >= n:
            frequent[w] = row
        return row

    full = (1 << n) - 1
    left = full
    for w in b:
        if w in places:
            met = left & bits(w)
            left = ((left + met) | (left - met)) & full
    return n - left.bit_count()


@F.pandas_udf(LongType())
def ordered_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words in common in the same order."""
    return pd.Series([None if x is None or y is None else common_subsequence(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int64")


# --- raster measurement ---------------------------------------------------------------------

# Fixed values of the raster rules.
ALPHA, DISTANCE, UNIFORM, LOW, EXPAND, SIGNIFICANT, SAMPLES, MOST_PIXELS = 16, 18, 0.95, 0.01, 2, 16, 128, 16_000_000

RASTER = StructType(
    [
        StructField("fg_state", StringType()), StructField("uniformity", DoubleType()), StructField("fg_ratio", DoubleType()), StructField("interaction", StringType()), StructField("words_touched", DoubleType()),
        StructField("components", IntegerType()), StructField("effective", ArrayType(DoubleType())),
    ]
)


def _components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(pixels, left, top, right, bottom) of 8-connected regions, by union of runs on neighbouring rows."""
    parent: list[int] = []
    runs: list[tuple[int, int, int, int]] = []
    before: list[int] = []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(len(mask)):
        edge = np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]]))
        now = []
        at = 0
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            k = len(runs)
            runs.append((y, s, e, k))
            parent.append(k)
            now.append(k)
            while at < len(before) and runs[before[at]][2] < s:
                at += 1
            j = at
            while j < len(before) and runs[before[j]][1] <= e:
                parent[top(before[j])] = top(k)
                j += 1
        before = now
    found: dict[int, list[int]] = {}
    for y, s, e, k in runs:
        f = found.setdefault(top(k), [0, s, y, e, y + 1])
        f[0] += e - s
        f[1], f[2], f[3], f[4] = min(f[1], s), min(f[2], y), max(f[3], e), max(f[4], y + 1)
    return [tuple(f) for f in found.values()]


def measure(rgba: bytes | None, width: int, height: int, words: list | None) -> dict:
    """Foreground, words on it, and its connected parts. words: boxes l, t, r, b in 0..1."""
    out = dict.fromkeys(("uniformity", "fg_ratio", "words_touched", "components", "effective"))
    out |= {"fg_state": "Unavailable", "interaction": "NotMeasured"}
    if rgba is None or width <= 0 or height <= 0 or width * height > MOST_PIXELS or len(rgba) != 4 * width * height:
        return out
    image = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4).astype(np.int32)
    stride = max(1, min(width, height) // SAMPLES)
    rim = np.concatenate([image[0, ::stride], image[-1, ::stride], image[::stride, 0], image[::stride, -1]])
    opaque = rim[rim[:, 3] > ALPHA][:, :3]
    ground = np.sort(opaque, axis=0)[len(opaque) // 2] if len(opaque) else np.zeros(3, dtype=np.int32)
    near = lambda p: ((p[..., :3] - ground) ** 2).sum(axis=-1) <= DISTANCE**2
    out["uniformity"] = float(((rim[:, 3] <= ALPHA) | near(rim)).mean())
    if out["uniformity"] < UNIFORM:
        return out
    mask = (image[..., 3] > ALPHA) & ~near(image)
    count = int(mask.sum())
    if not count:
        return out | {"fg_state": "BlankCanvas", "fg_ratio": 0.0, "interaction": "BlankCanvas", "words_touched": 0.0, "components": 0}
    out |= {"fg_state": "Measured", "fg_ratio": count / (width * height)}
    if words:
        inside, touched = np.zeros_like(mask), 0
        for w in words:
            l, t, r, b = (w[k] for k in ("l", "t", "r", "b")) if isinstance(w, dict) else w
            x0, x1 = max(0, int(np.floor(l * width)) - EXPAND), min(width, int(np.ceil(r * width)) + EXPAND)
            y0, y1 = max(0, int(np.floor(t * height)) - EXPAND), min(height, int(np.ceil(b * height)) + EXPAND)
            if x1 > x0 and y1 > y0:
                touched += bool(mask[y0:y1, x0:x1].any())
                inside[y0:y1, x0:x1] = True
        share, out["words_touched"] = float((mask & inside).sum() / count), touched / len(words)
        kind = "NoForegroundWordIntersection" if not share else "LowForegroundWordInteraction" if share <= LOW and out["words_touched"] <= LOW else "ForegroundWordInteraction"
        out["interaction"] = kind
    else:
        out |= {"interaction": "NoNativeWords", "words_touched": 0.0}
    parts = _components(mask)
    large = [p for p in parts if p[0] >= SIGNIFICANT] or [max(parts, key=lambda p: p[0])]
    out["components"] = sum(p[0] >= SIGNIFICANT for p in parts)
    out["effective"] = [min(p[1] for p in large) / width, min(p[2] for p in large) / height, max(p[3] for p in large) / width, max(p[4] for p in large) / height]
    return out


@F.pandas_udf(RASTER)
def measure_raster(rgba: pd.Series, width: pd.Series, height: pd.Series, words: pd.Series) -> pd.DataFrame:
    """F1-F4 on RGBA bytes."""
    rows = [measure(bytes(a) if a is not None else None, int(w), int(h), list(x) if x is not None else None) for a, w, h, x in zip(rgba, width, height, words, strict=True)]
    return pd.DataFrame(rows, columns=[f.name for f in RASTER.fields])


# --- fingerprints ---------------------------------------------------------------------------


#: Names of the projections, and the numbers of kinds and origins in them.
TEXT_SEQUENCE, TEXT_PROJECTION = "dual-run-selected-text-sequence-v1", "dual-run-text-projection-v1"
KINDS = ("Text", "Heading", "Caption", "Visual", "UnresolvedText", "Deferred")
ORIGINS = ("None", "Native", "Ocr")


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<i", len(raw)) + raw


def fingerprint(elements: list, full: bool) -> str:
    """Length-prefixed little-endian bytes of an ordered projection, hashed; -0.0 counts as 0.0.

    elements have text, each of them, and with full: order, kind, l, t, r, b, origin, block_seq
    (of the native block, or null) and reconciled.
    """
    h = hashlib.sha256(_text(TEXT_PROJECTION if full else TEXT_SEQUENCE) + struct.pack("<i", len(elements)))
    for e in elements:
        get = e.get if isinstance(e, dict) else e.__getitem__
        if full:
            h.update(struct.pack("<ii4d", get("order"), KINDS.index(get("kind")), *(float(get(k)) + 0.0 for k in ("l", "t", "r", "b"))))
        h.update(_text(get("text")))
        if full:
            block = get("block_seq")
            known = block is not None and block == block  # a missing number arrives as NaN
            h.update(struct.pack("<i?", ORIGINS.index(get("origin")), known) + (struct.pack("<i", int(block)) if known else b""))
            h.update(struct.pack("<?", bool(get("reconciled"))))
    return h.hexdigest()


@F.pandas_udf(StringType())
def text_fingerprint(elements: pd.Series) -> pd.Series:
    return elements.map(lambda x: fingerprint(list(x), full=False))


@F.pandas_udf(StringType())
def projection_fingerprint(elements: pd.Series) -> pd.Series:
    return elements.map(lambda x: fingerprint(list(x), full=True))


@F.pandas_udf(BooleanType())
def is_epub(content: pd.Series) -> pd.Series:
    """A4: a ZIP file whose ``mimetype`` entry says so exactly."""
    import io
    import zipfile

    def test(raw) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                info = z.getinfo("mimetype")
                return info.file_size <= 64 and z.read(info) == b"application/epub+zip"
        except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, NotImplementedError, EOFError):
            return False

    return content.map(lambda x: False if x is None else test(bytes(x)))
