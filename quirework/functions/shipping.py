"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset a local session gets a folder of its own; on a cluster it is an error,
    as every executor would write to its own disk.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _own_folders:
            _own_folders[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quirework-")
        root = _own_folders[sc.applicationId]
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="quirework-src-")) / "quirework_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
