"""Shared pieces: tables, materialised steps, words, connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.session import ensure_checkpoint_dir, ship_package
from sigframe.sources.tables import load

#: Words of a text: runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return load(spark, sf_dir, name)


def scratch(spark: SparkSession) -> str:
    """This session's folder under the shared ``spark.checkpoint.dir``; it is
    deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped: the folder goes with the session's own
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Step:
    """A frame written once as Parquet in the shared folder and read from there,
    so that a lost executor costs a re-read and not the lineage before it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def written(df: DataFrame) -> DataFrame:
    return Step(df).df


def fold(key: str = "doc_id"):
    """The contract's fold of a document: crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(key).cast("string")) % 4


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table as ``(node, component)``, the
    component being its smallest node; nodes without an edge do not appear.

    Alternating large-star and small-star rounds until nothing changes.  Each
    round is two map-side-combined minima and two equi-joins on the node, so a
    node with millions of neighbours is only ever a skewed join side (split by
    AQE), never a collected group.  Every round is written to the shared folder.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    step = Step(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    mark = _mark(step.df)
    while True:
        e = step.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = Step(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(nxt.df)
        step.drop()
        step = nxt
        if now == mark:
            break
        mark = now
    star = step.df
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())
