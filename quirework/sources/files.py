"""Files as rows: custody, format selection, image assets, spools (ids A1-A4, A12, A15-A18)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.measures import is_epub

MOST_ASSET_BYTES = 64 << 20
SPOOL_SCHEMA = 1


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files below a path of any store Spark reads: path, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def prepare(files: DataFrame) -> DataFrame:
    """A1: digest, length and status of (path, content); an empty file is an error of its own."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    return files.withColumns({"sha256": F.sha2("content", 256), "byte_length": size, "prepared": size > 0})


def is_pdf(content: Column) -> Column:
    """A3: the first five bytes."""
    return F.coalesce(F.substring(content, 1, 5) == F.unhex(F.lit("255044462D")), F.lit(False))


FORMATS: dict[str, Callable[[Column], Column]] = {"pdf": is_pdf, "epub": is_epub}


def select_format(files: DataFrame, formats: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A2: every format may claim a file; no claim and several claims are outcomes, not errors."""
    formats = formats or FORMATS
    claims = F.filter(F.array(*(F.when(test(F.col("content")), F.lit(name)) for name, test in sorted(formats.items()))), lambda x: x.isNotNull())
    out = files.withColumn("claims", claims)
    status = F.when(F.size("claims") == 0, "NotRecognized").when(F.size("claims") > 1, "Ambiguous").otherwise("Recognized")
    return out.withColumns({"format_status": status, "format": F.when(F.size("claims") == 1, F.col("claims")[0])})


def image_kind(content: Column) -> Column:
    """By magic bytes."""
    starts = lambda h: F.coalesce(F.substring(content, 1, len(h) // 2) == F.unhex(F.lit(h)), F.lit(False))
    return F.when(starts("FFD8FF"), "image/jpeg").when(starts("89504E470D0A1A0A"), "image/png").when(starts("47494638"), "image/gif").when(starts("424D"), "image/bmp").when(starts("49492A00") | starts("4D4D002A"), "image/tiff")


def preserve_assets(assets: DataFrame) -> DataFrame:
    """Digest, length and kind of each asset; larger ones than the limit are refused by name, not dropped."""
    size = F.octet_length("content").cast("long")
    return assets.withColumns({"byte_length": size, "sha256": F.sha2("content", 256), "media_type": image_kind(F.col("content")), "refused": F.coalesce(size > MOST_ASSET_BYTES, F.lit(True))})


def materialize_packaged(visuals: DataFrame, entries: DataFrame) -> DataFrame:
    """The exact bytes of packaged images, by document and resource path."""
    return visuals.join(entries.select("doc_id", F.col("name").alias("resource"), "content"), ["doc_id", "resource"], "left")


def write_assets(assets: DataFrame, writer: Callable[[str, bytes], None]) -> None:
    """Hands each asset to a user's writer on the executors; the writer must bear repeats of an id."""

    def each(rows) -> None:
        for row in rows:
            writer(row["asset_id"], bytes(row["content"]))

    assets.select("asset_id", "content").foreachPartition(each)


def read_assets(ids: DataFrame, reader: Callable[[str], bytes | None]) -> DataFrame:
    """(asset_id, content) of each id, by a user's reader on the executors; null for an asset it doesn't have."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"asset_id": batch["asset_id"], "content": [reader(x) for x in batch["asset_id"]]}, columns=["asset_id", "content"])

    return ids.select("asset_id").mapInPandas(run, "asset_id string, content binary")


def folder_assets(folder: str) -> tuple[Callable[[str, bytes], None], Callable[[str], bytes | None]]:
    """A writer and a reader of assets as files of a folder; a file appears whole, and a repeat replaces it by itself."""
    from pyarrow import fs

    def place(asset_id: str):
        store, top = fs.FileSystem.from_uri(folder)
        return store, top, f"{top}/{hashlib.sha256(asset_id.encode()).hexdigest()}"

    def write(asset_id: str, content: bytes) -> None:
        store, top, path = place(asset_id)
        store.create_dir(top, recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as out:
            out.write(content)
        store.move(aside, path)

    def read(asset_id: str) -> bytes | None:
        store, _, path = place(asset_id)
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as held:
            return held.read()

    return write, read


def write_spool(layout: DataFrame, path: str) -> None:
    """Layout between the two phases, written once; a spool that exists is an error."""
    layout.withColumn("spool_schema", F.lit(SPOOL_SCHEMA)).write.mode("errorifexists").parquet(path)


def read_spool(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("Unknown", "Text", "Heading", "Caption", "Figure", "Table")) -> DataFrame:
    """Reads it again; rows of another schema or an unknown kind fail the read."""
    rows = spark.read.parquet(path)
    good = (F.col("spool_schema") == SPOOL_SCHEMA) & F.col("kind").isin(*kinds) & (F.col("page_no") >= 1)
    checked = rows.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("bad spool row"))))
    return checked.drop("spool_schema")


def coordinate_space(width: Column, height: Column, rotation: Column, box: dict[str, Column], crop: dict[str, Column]) -> dict[str, Column]:
    """A box in points (origin bottom left) to shares of the rotated crop box (origin top left)."""
    w, h = crop["r"] - crop["l"], crop["t"] - crop["b"]
    l, r = (box["l"] - crop["l"]) / w, (box["r"] - crop["l"]) / w
    t, b = (crop["t"] - box["t"]) / h, (crop["t"] - box["b"]) / h
    del width, height
    turn = ((rotation % 360) + 360) % 360
    pick = lambda a0, a90, a180, a270: F.when(turn == 90, a90).when(turn == 180, a180).when(turn == 270, a270).otherwise(a0)
    return {"l": pick(l, 1 - b, 1 - r, t), "t": pick(t, l, 1 - b, 1 - r), "r": pick(r, 1 - t, 1 - l, b), "b": pick(b, r, 1 - t, 1 - l)}
