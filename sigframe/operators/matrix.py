"""Feature-matrix preparation on the long feature table: P-8 channel drop,
P-9 name sanitising, P-10 keep-first on name collisions, P-11 fill with -1,
P-12 / P-13 label separation and report, M-13 dense vector assembly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.columns import sanitize_name
from sigframe.session import cut_lineage

FILL = -1.0
# Bookkeeping columns that are never features.
NON_FEATURES = ("isLR", "peopleIndex", "target")


def drop_channels(series: DataFrame, names: Sequence[str] = NON_FEATURES) -> DataFrame:
    """P-8: drop bookkeeping channels (missing names are ignored)."""
    return series.filter(~F.col("channel").isin(list(names)))


def name_map(features: DataFrame) -> DataFrame:
    """P-9 / P-10: ``(feature, clean_feature, kept)``; of the originals that
    sanitise to the same name, the first in name order is kept."""
    names = features.select("feature").distinct().withColumn("clean_feature", sanitize_name("feature"))
    first = names.groupBy("clean_feature").agg(F.min("feature").alias("_first"))
    return names.join(first, "clean_feature").select(
        "feature", "clean_feature", (F.col("feature") == F.col("_first")).alias("kept"))


def clean_features(features: DataFrame) -> DataFrame:
    """P-9..P-11: sanitised, de-duplicated names and -1 for NULL / NaN values."""
    kept = cut_lineage(name_map(features).filter("kept").select("feature", "clean_feature"))  # a row a name
    v = F.col("value")
    return features.join(kept, "feature").select(
        "series_id", F.col("clean_feature").alias("feature"),
        F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(FILL)).alias("value"))


def labels(series: DataFrame) -> DataFrame:
    """P-12: one label row per series."""
    return series.select("series_id", "subject", "target").distinct()


def label_report(label_rows: DataFrame) -> DataFrame:
    """P-13: distinct labels with their counts."""
    return label_rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def feature_index(features: DataFrame) -> DataFrame:
    """Dense 0-based feature positions in name order.

    Runs on the distinct feature-name table, whose size is bounded by the
    calculator grid times the channel count (not by the data), so a single
    ordered window is enough here.
    """
    names = features.select("feature").distinct()
    return names.withColumn("idx", (F.row_number().over(Window.orderBy("feature")) - 1).cast("bigint"))


def assemble(features: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """M-13: ``(series_id, features array<double>)`` with -1 for missing cells.

    Each series row holds one value per feature (width bounded by the
    feature set, not by the data): its cells and a fill for each position that has
    none, sorted by position, so a row's cost is that of sorting its width.
    """
    features = cut_lineage(features)  # read for the names and for the cells
    index = index if index is not None else feature_index(features)
    # one number (the feature count) comes back to the driver to shape the vectors
    width = index.agg(F.max("idx") + 1).first()[0]
    if width is None:
        return features.select("series_id", F.array().cast("array<double>").alias("features")).limit(0)
    cells = features.join(index, "feature").groupBy("series_id").agg(
        F.collect_list(F.struct("idx", F.coalesce("value", F.lit(FILL)).alias("value"))).alias("_c"))
    all_of = F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))
    missing = F.transform(F.array_except(all_of, F.col("_c.idx")), lambda i: F.struct(i.alias("idx"), F.lit(FILL).alias("value")))
    vec = F.transform(F.sort_array(F.concat("_c", missing)), lambda c: c["value"])
    return cells.select("series_id", vec.alias("features"))
