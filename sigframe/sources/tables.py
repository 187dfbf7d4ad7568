"""Named-table store (S-1, S-2), shape/profile report (S-10), manifests (S-7),
per-run partitioned output (S-8), key-value export rows (S-9) and model
persistence (S-12).

The store is a folder of Parquet tables addressed by name; CSV import/export
takes an explicit schema (no inference at scale).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigframe.operators import boosting

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables by name."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Catalog:
    """Folder of named tables.  ``base`` is used as given (no dirname trimming)."""

    def __init__(self, spark: SparkSession, base: str, fmt: str = "parquet"):
        self.spark, self.base, self.fmt = spark, base.rstrip("/"), fmt

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read_table(self, name: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read
        if self.fmt == "csv":
            reader = reader.option("header", "true")
            if schema is None:
                raise ValueError("CSV tables need an explicit schema")
        if schema is not None:
            reader = reader.schema(schema)
        return reader.format(self.fmt).load(self.path(name))

    def write_table(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        writer = df.write.mode("overwrite").format(self.fmt)
        if self.fmt == "csv":
            writer = writer.option("header", "true")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(self.path(name))


def shape(df: DataFrame) -> DataFrame:
    """S-10: one row ``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """S-10 extended: per column count, non-null count, distinct count, min, max.

    One aggregate pass over the table (partial aggregation), then a tiny
    unpivot.  min/max are reported as strings so mixed types share a column.
    """
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"nn{i}"), F.count_distinct(q).alias(f"nd{i}"),
                 F.min(q).cast("string").alias(f"mn{i}"), F.max(q).cast("string").alias(f"mx{i}")]
    wide = df.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"nn{i}").alias("non_null"),
                                 F.col(f"nd{i}").alias("n_distinct"), F.col(f"mn{i}").alias("min_value"),
                                 F.col(f"mx{i}").alias("max_value")) for i, c in enumerate(cols)])
    return wide.select(F.col("_rows").alias("n_rows"), F.inline(entries))


def manifest(files: DataFrame, key: str = "archive", path: str = "path") -> DataFrame:
    """S-7: long manifest ``(archive, pos, path)`` with ``pos`` ordered by path.

    The window is per archive (a handful of members each), never global.
    """
    w = Window.partitionBy(key).orderBy(path)
    return files.select(key, path).withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def write_runs(catalog: Catalog, name: str, series: DataFrame) -> None:
    """S-8: one output folder per (subject, run) instead of counter-suffixed files.

    Rows are dealt by folder, so that a folder is one file and not one for every
    task that has rows of it; a long run's blocks of ``t`` go to several tasks.  A
    file takes its time however short it is, so tasks are not merged by bytes."""
    from sigframe.operators.ordering import DEFAULT_BLOCK

    block = [F.floor(F.col("t") / F.lit(DEFAULT_BLOCK))] if "t" in series.columns else []
    dealt = series.repartition(_tasks(series.sparkSession), F.col("subject"), F.col("run"), *block)
    catalog.write_table(name, dealt, partition_by=("subject", "run"))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_runs(catalog: Catalog, name: str) -> DataFrame:
    """The table that ``write_runs`` has written.  A scan counts every file as several MB and
    would be a task for each few of them; here it has as many tasks as a shuffle, at most."""
    return catalog.read_table(name).coalesce(_tasks(catalog.spark))


def kv_rows(series: DataFrame, dataset: str, atlas: str, prefix: str = "HCP_",
            cell_points: int = 4096) -> DataFrame:
    """S-9: key-value export rows ``(rowkey, qualifier, value)`` per subject run
    (row key ``<prefix><subject>_<target>``).

    Person, dataset and atlas cells as in the source layout; the region data
    is JSON ``{t: x}`` split into cells of at most ``cell_points`` points
    (qualifier ``data:roi:<channel>:<block>``) so no cell, and no task, has to
    hold a whole subject.  The store client itself is not part of the engine.
    """
    rowkey = F.concat(F.lit(prefix), F.col("subject").cast("string"), F.lit("_"), F.col("target").cast("string"))
    blk = F.floor(F.col("t") / F.lit(cell_points)).cast("bigint")
    entries = F.array_sort(F.collect_list(F.struct(F.col("t").alias("k"), F.col("x").alias("v"))))
    body = F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit('"'), e["k"].cast("string"), F.lit('":'), e["v"].cast("string"))), ",")
    roi = series.groupBy("subject", "target", "channel", blk.alias("blk")).agg(
        F.concat(F.lit("{"), body, F.lit("}")).alias("value"))
    roi = roi.select(rowkey.alias("rowkey"),
                     F.concat_ws(":", F.lit("data:roi"), F.col("channel"), F.col("blk").cast("string"))
                     .alias("qualifier"), "value")
    people = series.select("subject", "target").distinct()
    cells = F.array(
        F.struct(F.lit("data:person").alias("qualifier"), F.col("subject").cast("string").alias("value")),
        F.struct(F.lit("data:dataset").alias("qualifier"), F.lit(dataset).alias("value")),
        F.struct(F.lit("data:atlas").alias("qualifier"), F.lit(atlas).alias("value")),
    )
    meta = people.select(rowkey.alias("rowkey"), F.inline(cells))
    return meta.unionByName(roi)


def save_model(model, path: str) -> None:
    """S-12: persist a fitted model (overwrite): a ``PipelineModel``, or boosted trees as one line of JSON."""
    if isinstance(model, boosting.Model):
        spark = SparkSession.active()
        spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/boosted")
    else:
        model.write().overwrite().save(path)


def load_model(path: str):
    """S-12: load a model that ``save_model`` has written."""
    from pyspark.errors import AnalysisException
    from pyspark.ml import PipelineModel

    try:
        return boosting.Model.from_json(SparkSession.active().read.text(f"{path}/boosted").first()[0])
    except AnalysisException:
        return PipelineModel.load(path)
