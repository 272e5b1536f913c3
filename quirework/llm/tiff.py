"""TIFF media columns (operator 1): read every page of a TIFF file, and write the files the query reads.

The reader walks the chain of image directories in either byte order, gathers strips or
tiles, undoes their compression (none, PackBits, LZW, deflate), undoes the horizontal or
the floating-point predictor, and gives one row a page. Directories that loop, point
outside the file or lie about sizes end the file's walk with an error text in a row of
their own; they never raise and never drop another file's pages.

Behaviour on odd input: null or empty content gives one row with page -1 and the error
"empty"; a file of any size is decoded strip by strip; repeated rows give repeated pages;
an empty table gives an empty result; other columns are carried along on request.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import documents, map_arrow
from quirework.llm.hashing import chunks

# Fixed values of TIFF 6.0: tags, field types and their sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", DEFLATE_OLD: "deflate"}
CLEAR, STOP, FIRST = 256, 257, 258

#: Bytes that a byte of each scheme may stand for, at most.
EXPANSION = {NONE: 1, LZW: 2731, DEFLATE: 1032, DEFLATE_OLD: 1032, PACKBITS: 64}
#: A row of Spark's holds no more.
MOST_BYTES = (1 << 31) - (1 << 16)


# --- compression schemes ------------------------------------------------------------------


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, held = [], 0, 0
    end = len(data)
    while at < end and held < size:
        n = data[at]
        at += 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
            held += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
            held += 257 - n
    return b"".join(out)[:size]


def pack_bits_row(row: bytes) -> bytes:
    """One row: runs of three and more as runs, the rest as literals of at most 128 bytes."""
    x = np.frombuffer(row, dtype=np.uint8)
    cut = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])
    long = (ends - starts) >= 3
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            out.append(bytes([min(128, b - i) - 1]) + row[i : min(b, i + 128)])

    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        literal(at, s)
        for i in range(s, e, 128):
            n = min(128, e - i)
            out.append(bytes([257 - n if n > 1 else 0]) + row[s : s + 1])
        at = e
    literal(at, len(row))
    return b"".join(out)


def pack_bits(piece: np.ndarray) -> bytes:
    """Rows of a strip or tile, each on its own; rows of up to 128 bytes without a run are one literal."""
    width = piece.shape[1]
    runs = ((piece[:, 2:] == piece[:, 1:-1]) & (piece[:, 1:-1] == piece[:, :-2])).any(axis=1)
    if width <= 128 and not runs.any():
        return np.concatenate([np.full((len(piece), 1), width - 1, np.uint8), piece], axis=1).tobytes()
    plain = bytes([width - 1]) if width <= 128 else None
    return b"".join(plain + r.tobytes() if plain and not run else pack_bits_row(r.tobytes()) for r, run in zip(piece, runs, strict=True))


def _schedule() -> np.ndarray:
    """Bit widths of the codes behind a clear code: the table has grown to FIRST + k - 1 at code k, and a width ends one code early."""
    size = FIRST + np.maximum(np.arange(4096 - FIRST + 2) - 1, 0)
    return np.select([size < 511, size < 1023, size < 2047], [9, 10, 11], 12)


_WIDTHS = _schedule()
_ENDS = np.cumsum(_WIDTHS)
_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def unlzw(data: bytes, size: int) -> bytes:
    """Codes are read a table's life at a time: their widths depend on their number alone."""
    padded = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8)
    bits, at, out, held = 8 * len(data), 0, [], 0
    while at < bits and held < size:
        n = int(np.searchsorted(_ENDS, bits - at, side="right"))
        if not n:
            break
        first = at + _ENDS[:n] - _WIDTHS[:n]
        byte = first >> 3
        word = (padded[byte].astype(np.uint32) << 16) | (padded[byte + 1].astype(np.uint32) << 8) | padded[byte + 2]
        codes = (word >> (24 - (first & 7) - _WIDTHS[:n]).astype(np.uint32)) & ((1 << _WIDTHS[:n]) - 1).astype(np.uint32)
        ends = np.flatnonzero((codes == CLEAR) | (codes == STOP))
        stop = int(ends[0]) if len(ends) else n
        table = list(_SINGLE)
        add, emit = table.append, out.append
        before = b""
        for code in codes[:stop].tolist():
            if not before:
                before = table[code] if code < CLEAR else b""
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                add(before + entry[:1])
                before = entry
            emit(before)
            held += len(before)
        if not len(ends) or codes[stop] == STOP:
            break
        at += int(_ENDS[stop])
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}
    size, k, prefix = FIRST, 0, -1
    live = _WIDTHS.tolist()
    for value in data:
        if prefix < 0:
            prefix = value
            continue
        pair = (prefix << 8) | value
        known = table.get(pair)
        if known is not None:
            prefix = known
            continue
        codes.append(prefix)
        widths.append(live[k])
        k += 1
        table[pair] = size
        size += 1
        prefix = value
        if size == 4094:
            codes.append(CLEAR)
            widths.append(live[k])
            table, size, k = {}, FIRST, 0
    if prefix >= 0:
        codes.append(prefix)
        widths.append(live[k])
        k += 1
    codes.append(STOP)
    widths.append(live[k])
    wide = np.unpackbits(np.array(codes, dtype=">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(wide[np.arange(16)[None, :] >= 16 - np.array(widths)[:, None]]).tobytes()


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


def expand(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return data[:size]
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    if scheme == LZW:
        return unlzw(data, size)
    if scheme in (DEFLATE, DEFLATE_OLD):
        return _inflate(data, size)
    raise ValueError(f"compression {scheme}")


# --- reading ---------------------------------------------------------------------------------


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    bits: int = 0
    samples: int = 0
    compression: str | None = None
    predictor: int = 1
    tiled: bool = False
    pieces: int = 0
    pixels: bytes = b""
    error: str | None = None
    tags: dict = field(default_factory=dict)


def _undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples of the stored kind."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, columns * samples * size)
        step = raw.reshape(rows, -1, samples)
        summed = np.cumsum(step, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        planes = summed.transpose(0, 2, 1)  # most significant byte first
        return np.ascontiguousarray(planes).view(f">u{size}").reshape(rows, columns, samples).astype(f"{order}u{size}")
    return block


def _directory(data: bytes, at: int, order: str) -> tuple[dict, int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = TYPE_SIZE.get(kind, 0) * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        if where + size > len(data):
            raise ValueError(f"tag {tag} lies outside the file")
        letter = {1: "B", 3: "H", 4: "I", 13: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
        tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where) if letter else (data[where : where + size],)
    (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, after


def _decode(data: bytes, page: Page, order: str) -> None:
    tags = page.tags
    one = lambda t, other=None: tags[t][0] if tags.get(t) else other
    page.width, page.height = one(WIDTH, 0), one(HEIGHT, 0)
    depths = set(tags.get(BITS, (1,)))
    page.bits, page.samples = max(depths), one(SAMPLES, 1)
    scheme, page.predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    page.compression, page.tiled = NAMES.get(scheme, str(scheme)), TILE_OFFSETS in tags
    if not page.width or not page.height:
        raise ValueError("bad size")
    if len(depths) > 1 or page.bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"bits {sorted(depths)}")
    if page.predictor not in (1, 2, 3) or (page.predictor > 1 and page.bits < 8):
        raise ValueError(f"predictor {page.predictor}")
    planes = page.samples if one(PLANAR, 1) == 2 else 1
    samples = 1 if planes > 1 else page.samples
    if page.tiled:
        across, down = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        across, down = page.width, min(one(ROWS_PER_STRIP, page.height), page.height)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    page.pieces = len(offsets)
    columns, rows = -(-page.width // across), -(-page.height // down)
    if len(offsets) != len(counts) or len(offsets) < columns * rows * planes:
        raise ValueError("too few strips or tiles")
    row_bytes = lambda w: (w * samples * page.bits + 7) // 8
    size = planes * page.height * row_bytes(page.width)
    if scheme in EXPANSION and size > sum(counts) * EXPANSION[scheme]:
        raise ValueError(f"bad size: {size} bytes are more than {sum(counts)} can hold")
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes are more than a row can hold")
    whole = np.zeros((planes, page.height, row_bytes(page.width)), dtype=np.uint8)
    if page.tiled and page.bits < 8 and (across * samples * page.bits) % 8:
        raise ValueError("tiles of part bytes")
    for i in range(columns * rows * planes):
        plane, cell = divmod(i, columns * rows)
        r, c = divmod(cell, columns)
        height = down if page.tiled else min(down, page.height - r * down)
        want = height * row_bytes(across)
        if offsets[i] + counts[i] > len(data):
            raise ValueError("strip or tile outside the file")
        raw = expand(data[offsets[i] : offsets[i] + counts[i]], scheme, want)
        if len(raw) < want:
            raise ValueError(f"{page.compression}: {len(raw)} of {want} bytes")
        block = np.frombuffer(raw, dtype=np.uint8).reshape(height, -1)
        if page.predictor > 1:
            typed = block.view(f"{order}u{page.bits // 8}").reshape(height, across, samples)
            block = np.ascontiguousarray(_undo(typed, page.predictor, order)).view(np.uint8).reshape(height, -1)
        top, left = r * down, c * row_bytes(across)
        high, wide = min(height, page.height - top), min(block.shape[1], whole.shape[2] - left)
        whole[plane, top : top + high, left : left + wide] = block[:high, :wide]
    page.pixels = whole.tobytes()


def read_pages(data: bytes | None) -> Iterator[Page]:
    """All pages of a file; an undecodable one has an error and no pixels."""
    if not data:
        yield Page(-1, error="empty")
        return
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        yield Page(-1, error="not a TIFF file")
        return
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen, number = set(), 0
    while at:
        page = Page(number)
        if at in seen:
            yield Page(number, error="directories loop")
            return
        seen.add(at)
        try:
            page.tags, at = _directory(data, at, order)
        except (struct.error, ValueError) as e:
            yield Page(number, error=f"directory: {e}")
            return
        try:
            _decode(data, page, order)
        except (ValueError, KeyError, TypeError, zlib.error, struct.error, IndexError, MemoryError) as e:
            page.pixels, page.error = b"", f"{type(e).__name__}: {e}"
        yield page
        number += 1


# --- writing ---------------------------------------------------------------------------------


def write_page(payload: bytes, width: int, scheme: int, predictor: int = 1, tile: int = 0, rows: int = 128, order: str = "<") -> bytes:
    """A one-page 8-bit grey file of payload (a multiple of width bytes). tile: side of tiles, 0 for strips."""
    return write_file([payload], width, scheme, predictor, tile, rows, order)


def write_file(payloads: list[bytes], width: int, scheme: int, predictor: int = 1, tile: int = 0, rows: int = 128, order: str = "<") -> bytes:
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for payload in payloads:
        image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
        height, pieces = len(image), []
        for top in range(0, height, tile or rows):
            band = image[top : top + (tile or rows)]
            if tile:
                band = np.pad(band, ((0, tile - len(band)), (0, -width % tile)))
                pieces += [band[:, left : left + tile] for left in range(0, band.shape[1], tile)]
            else:
                pieces.append(band)
        offsets, counts = [], []
        for piece in pieces:
            if predictor == 2:
                piece = np.concatenate([piece[:, :1], np.diff(piece, axis=1)], axis=1)
            raw = np.ascontiguousarray(piece).tobytes()
            if scheme == PACKBITS:
                raw = pack_bits(np.frombuffer(raw, dtype=np.uint8).reshape(piece.shape))
            elif scheme == LZW:
                raw = lzw(raw)
            elif scheme in (DEFLATE, DEFLATE_OLD):
                raw = zlib.compress(raw, 6)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1])]
        entries += [(PREDICTOR, 3, [predictor])] if predictor > 1 else []
        if tile:
            entries += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        fields = b""
        for tag, kind, values in sorted(entries):
            packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                where = struct.pack(order + "I", len(out))
                out += packed
            else:
                where = packed.ljust(4, b"\0")
            fields += struct.pack(order + "HHI", tag, kind, len(values)) + where
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields) // 12) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- the operator ----------------------------------------------------------------------------

PAGE_COLUMNS = {
    "page": "int", "width": "int", "height": "int", "bits": "int", "samples": "int", "compression": "string",
    "predictor": "int", "tiled": "boolean", "pieces": "int", "pixels": "binary", "error": "string",
}


def _page_rows(batches: Iterator[pa.RecordBatch], kept: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def out(rows: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        at = pa.array([i for i, _ in rows], pa.int64())
        pages = [p for _, p in rows]
        columns = [batch.column(i).take(at) for i in range(kept)]
        for f, get in zip(
            list(schema)[kept:],
            ("number", "width", "height", "bits", "samples", "compression", "predictor", "tiled", "pieces", "pixels", "error"),
            strict=True,
        ):
            columns.append(pa.array([getattr(p, get) for p in pages], f.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        rows, size = [], 0
        for i, value in enumerate(batch.column(kept)):
            for page in read_pages(value.as_py()):
                rows.append((i, page))
                size += len(page.pixels) + 64
                if size > 8 << 20:
                    yield out(rows, batch)
                    rows, size = [], 0
        if rows:
            yield out(rows, batch)


def tiff_pages(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """One row for each page of each file in a binary column, with the columns to keep.

    keep columns come first, under their names, then PAGE_COLUMNS; one of these that is named
    like a kept column gets ``tiff_`` before its name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    source = df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{content}`").cast("binary").alias("__content"))
    added = _parse_datatype_string(", ".join(f"{'tiff_' if k in keep else ''}{k} {t}" for k, t in PAGE_COLUMNS.items()))
    out = StructType([source.schema[k] for k in keep] + list(added.fields))
    arrow, n = to_arrow_schema(out), len(keep)
    return map_arrow(source, lambda batches: _page_rows(batches, n, arrow), out)


#: How the query stores a payload, chosen by its checksum: scheme, predictor, tile side.
FORMS = [(PACKBITS, 1, 0), (LZW, 1, 0), (DEFLATE, 2, 0), (DEFLATE, 1, 32), (LZW, 2, 64), (DEFLATE_OLD, 2, 64)]
UNIT = 64


def store(text: str | bytes | None) -> tuple[int, bytes]:
    """A text's unpadded size and its TIFF file: 64 samples a row, zero bytes up to a full row."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    padded = raw + b"\0" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)
    scheme, predictor, tile = FORMS[zlib.crc32(padded) % len(FORMS)]
    return len(raw), write_page(padded, UNIT, scheme, predictor, tile, order="<>"[zlib.crc32(padded) >> 16 & 1])


def _store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for part in chunks(list(range(len(texts))), lambda i: len(texts[i] or b"") + 512, 4 << 20):
            made = [store(texts[i]) for i in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part[0], len(part)), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: E731, B023
        rows = []
        for pixels, width, height, compression, predictor, tiled, pieces, error in zip(
            *(get(c) for c in ("pixels", "width", "height", "compression", "predictor", "tiled", "pieces", "error")), strict=True
        ):
            held = np.frombuffer(pixels, dtype=np.uint8)
            counts = np.bincount(held, minlength=256)
            shape = f"{width}x{height} {compression} p{predictor} {'tiles' if tiled else 'strips'}:{pieces}"
            light = f"sum:{int(held.sum(dtype=np.int64))} zero:{int(counts[0])} levels:{int((counts > 0).sum())} top:{int(counts.argmax())}"
            rows.append((len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-UNIT:]), error or f"{shape} {light}"))
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [*keep, *made], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every text stored as a TIFF file, its page read back and measured."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    files = map_arrow(docs, _store_rows, "doc_id long, n_bytes long, media binary")
    files = files.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    found = tiff_pages(files, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    made = map_arrow(found, _digest_rows, schema)
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
