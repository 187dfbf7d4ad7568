"""Canonical inputs derived from the given tables (the engine's test inputs).

* ``events``  -> ``series``: subject = user_id, class = event type code,
  order ``(ts, event_id)``, channels ``x_0`` = value, ``x_1`` = JSON ``k``;
  run = ``LR`` for even event ids, ``RL`` for odd ones (two runs per series).
* ``lineitem`` x ``part`` -> ``voxels`` / ``atlas``: scan = supplier, voxel =
  part, t = ship month, x = extended price; label = brand number.
* ``events`` -> scan ``paths``: one archive and one file per (subject, task, run).
* ``embeddings`` -> feature matrix ``(id, target, features array<double>)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators.ordering import dense_index

# Series ids are subject * SERIES_STRIDE + class code (class codes < stride).
SERIES_STRIDE = 100


def event_classes(events: DataFrame) -> DataFrame:
    """Class dimension ``(event_type, task, target)``: codes by sorted event type.

    The window runs over the distinct class table only (a handful of rows).
    """
    kinds = events.select("event_type").distinct()
    w = Window.orderBy("event_type")
    return kinds.select("event_type", F.upper("event_type").alias("task"),
                        (F.dense_rank().over(w) - 1).cast("int").alias("target"))


def series_id(subject, target):
    return (F.col(subject).cast("bigint") * SERIES_STRIDE + F.col(target)).alias("series_id")


def wide_events(events: DataFrame) -> DataFrame:
    """Events with class code, run and both channels as columns (one row per event)."""
    classes = F.broadcast(event_classes(events))  # bounded: one row per class
    return events.join(classes, "event_type").select(
        F.col("user_id").alias("subject"), "target", "event_id", "ts",
        F.when(F.col("event_id") % 2 == 0, F.lit("LR")).otherwise(F.lit("RL")).alias("run"),
        F.col("value").alias("x_0"),
        F.get_json_object("props", "$.k").cast("double").alias("x_1"),
    )


def series_from_events(events: DataFrame, runs_concatenated: bool = False) -> DataFrame:
    """Long ``series(series_id, subject, target, channel, t, x)``.

    ``t`` is dense inside each (subject, class) series, in ``(ts, event_id)``
    order, or — with ``runs_concatenated`` — LR rows first, then RL rows (W-5).
    """
    wide = wide_events(events)
    order = ["ts", "event_id"]
    if runs_concatenated:
        order = [F.when(F.col("run") == "LR", 0).otherwise(1), "ts", "event_id"]
    indexed = dense_index(wide, ["subject", "target"], order)
    return indexed.select(
        series_id("subject", "target"), "subject", "target", "t",
        F.stack(F.lit(2), F.lit("x_0"), "x_0", F.lit("x_1"), "x_1").alias("channel", "x"),
    ).select("series_id", "subject", "target", "channel", "t", "x")


def voxels_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """``voxels(scan_id, voxel, t, x)``: t = months since 1990-01 of the ship date."""
    t = (F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate") - 1
    return lineitem.select(F.col("l_suppkey").alias("scan_id"), F.col("l_partkey").alias("voxel"),
                           t.cast("int").alias("t"), F.col("l_extendedprice").alias("x"))


def atlas_from_part(part: DataFrame) -> DataFrame:
    """``atlas(voxel, label)``: label = brand number (0 would be background)."""
    return part.select(F.col("p_partkey").alias("voxel"),
                       F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("label"))


def scan_paths(events: DataFrame) -> DataFrame:
    """One image path per (subject, task, run) present in ``events``.

    ``/data/<subject6>_<TASK>/<subject6>_3T_tfMRI_<TASK>_<RUN>.nii.gz`` with
    the six-digit subject ``100000 + user_id``.
    """
    wide = wide_events(events).join(F.broadcast(event_classes(events).select("target", "task")), "target")
    subj = F.format_string("%06d", F.col("subject") + 100000)
    folder = F.concat(subj, F.lit("_"), F.col("task"))
    name = F.concat(subj, F.lit("_3T_tfMRI_"), F.col("task"), F.lit("_"), F.col("run"), F.lit(".nii.gz"))
    return wide.select(F.concat(F.lit("/data/"), folder, F.lit("/"), name).alias("path")).distinct()


def archive_paths(events: DataFrame) -> DataFrame:
    """One archive path per (subject, task): ``/source/<subject6>_3T_tfMRI_<TASK>_preproc.zip``."""
    wide = wide_events(events).join(F.broadcast(event_classes(events).select("target", "task")), "target")
    subj = F.format_string("%06d", F.col("subject") + 100000)
    return wide.select(F.concat(F.lit("/source/"), subj, F.lit("_3T_tfMRI_"), F.col("task"),
                                F.lit("_preproc.zip")).alias("path")).distinct()


def matrix_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Feature matrix ``(id, target, features array<double>)``."""
    return embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("target"),
                             F.transform("embedding", lambda v: v.cast("double")).alias("features"))


def atlases_from_part(part: DataFrame) -> DataFrame:
    """Two label maps over the same voxels: ``brand`` (brand number) and
    ``size`` (part size); ``atlas(atlas, voxel, label)``."""
    brand = atlas_from_part(part).withColumn("atlas", F.lit("brand"))
    size = part.select(F.col("p_partkey").alias("voxel"), F.col("p_size").cast("int").alias("label")).withColumn(
        "atlas", F.lit("size"))
    return brand.unionByName(size).select("atlas", "voxel", "label")


def series_with_time(events: DataFrame) -> DataFrame:
    """``series`` plus the event time stamp ``ts`` (for time-aware features)."""
    wide = wide_events(events)
    indexed = dense_index(wide, ["subject", "target"], ["ts", "event_id"])
    return indexed.select(
        series_id("subject", "target"), "subject", "target", "t", "ts",
        F.stack(F.lit(2), F.lit("x_0"), "x_0", F.lit("x_1"), "x_1").alias("channel", "x"),
    ).select("series_id", "subject", "target", "channel", "t", "ts", "x")


#: Columns of the small feature matrix of the series.
SERIES_MATRIX = ("length", "mean", "minimum", "maximum", "variance", "abs_energy", "skewness", "kurtosis")


def matrix_from_series(series: DataFrame) -> DataFrame:
    """``series`` (x_0) -> ``(id, target, fold, features)``: eight statistics a series; those
    that a short series lacks are null."""
    from sigframe.operators.features.distribution import distribution
    from sigframe.operators.models import with_folds

    wide = distribution(series.where(F.col("channel") == "x_0"))
    features = F.array(*[F.col(c).cast("double") for c in SERIES_MATRIX])
    labels = series.select("series_id", F.col("target").cast("int").alias("target")).distinct()
    return with_folds(wide.select("series_id", features.alias("features")).join(labels, "series_id").withColumnRenamed("series_id", "id"))
