"""Archive sources: list ``.zip`` archives (S-3, S-4) and their members (S-5).

Listing uses the ``binaryFile`` source with only ``path``/``length``
selected, so the content column is pruned.  Member listing reads each
archive's central directory inside a ``mapInPandas`` task (one archive per
row; Spark spreads archives over tasks) and emits ``(archive, member, size)``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = "archive string, member string, size long"
# Member pattern for task images (task word, run side, image suffix).
TASK_MEMBER_RE = r"(EMOTION|GAMBLING|LANGUAGE|MOTOR|RELATIONAL|WM|SOCIAL)_(LR|RL)\.nii\.gz$"


def list_archives(spark: SparkSession, folder: str, globs: Sequence[str] = ("*.zip",)) -> DataFrame:
    """S-3 / S-4: ``(path, length)`` of archives matching any glob (union of scans)."""
    frames = [spark.read.format("binaryFile").option("pathGlobFilter", g).load(folder).select("path", "length")
              for g in globs]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                rows += [(path, info.filename, info.file_size) for info in zf.infolist() if not info.is_dir()]
        yield pd.DataFrame(rows, columns=["archive", "member", "size"])


def list_members(spark: SparkSession, folder: str, glob: str = "*.zip") -> DataFrame:
    """S-5: one row per archive member."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return raw.mapInPandas(_members, MEMBER_SCHEMA)


def task_members(members: DataFrame) -> DataFrame:
    """S-5 selection: task images, with the ``<subject>_<task>`` output folder.

    Subject = first path piece; task = second ``_`` piece of the fourth piece.
    """
    parts = F.split("member", "/")
    folder = F.concat(parts.getItem(0), F.lit("_"), F.split(parts.getItem(3), "_").getItem(1))
    return members.filter(F.col("member").rlike(TASK_MEMBER_RE)).withColumn("folder", folder)
