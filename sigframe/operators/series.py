"""Series-level operators: point counts (A-1), shortest length (A-2), length
equalisation (W-2), series numbering (W-3), run concatenation order (W-5),
median smoothing (W-6), Savitzky–Golay smoothing (W-7), wide <-> long reshape
(P-15) and per-channel standardisation (R-3).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators.ordering import BLK, HALO, block_window, blocked, dense_index

KEY = ["series_id", "channel"]


def _finite(x):
    return F.when(~F.isnan(x), x)


def point_counts(series: DataFrame, channel: str | None = "x_0") -> DataFrame:
    """A-1: non-null, non-NaN point count per series of one channel (partial
    agg); with ``channel=None`` per (series, channel) over all channels."""
    if channel is None:
        return series.groupBy("series_id", "subject", "target", "channel").agg(
            F.count(_finite(F.col("x"))).alias("n_points"))
    return (series.filter(F.col("channel") == channel)
            .groupBy("series_id", "subject", "target")
            .agg(F.count(_finite(F.col("x"))).alias("n_points")))


def min_length(series: DataFrame, channel: str | None = "x_0") -> DataFrame:
    """A-2: one-row table with the smallest A-1 count."""
    return point_counts(series, channel).agg(F.min("n_points").alias("min_length"))


def equalise(series: DataFrame, channel: str | None = "x_0") -> DataFrame:
    """W-2: keep the first ``min_length`` positions of every series, all channels.

    Two aggregate passes (per-series counts, then a one-row minimum) feed a
    scalar subquery; the fact table is only filtered, never re-partitioned.
    """
    shortest = min_length(series, channel).scalar()
    return series.filter(F.col("t") < shortest)


def number_series(keys: DataFrame, cols: Sequence[str] = ("subject", "target"),
                  out: str = "series_no") -> DataFrame:
    """W-3: dense series number ordered by ``cols`` (subject-major, then class).

    Runs on the distinct key table with the range-partitioned dense index, so
    even millions of series never meet in one task.
    """
    distinct = keys.select(*cols).distinct()
    return dense_index(distinct, [], list(cols), out=out)


def to_wide(series: DataFrame, channels: Sequence[str],
            keys: Sequence[str] = ("series_id", "subject", "target", "t")) -> DataFrame:
    """P-15 long -> wide for a known, small channel list (explicit pivot values)."""
    return series.groupBy(*keys).pivot("channel", list(channels)).agg(F.first("x"))


def to_long(wide: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """P-15 wide -> long."""
    return wide.unpivot(list(ids), list(channels), "channel", "x")


def standardise(series: DataFrame) -> DataFrame:
    """R-3: ``(x - mean) / stddev_pop`` per (series, channel); constant -> 0.

    Stats come from a partial aggregate joined back (AQE broadcasts it when
    small and splits skewed partitions otherwise).
    """
    stats = series.groupBy(*KEY).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("x") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return series.join(stats, KEY).withColumn("x", z).drop("_m", "_s")


def median_smooth(series: DataFrame, kernel: int = 3) -> DataFrame:
    """W-6: running median of width ``kernel`` (odd), zero padding at the ends."""
    if kernel % 2 != 1:
        raise ValueError("kernel must be odd")
    h = kernel // 2
    b = blocked(series, halo=h)
    w = block_window(KEY).rowsBetween(-h, h)
    vals = F.collect_list("x").over(w)
    padded = F.concat(vals, F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size(vals)))
    out = b.withColumn("x", F.element_at(F.array_sort(padded), h + 1))
    return out.filter(~F.col(HALO)).drop(BLK, HALO)


def savgol_weights(window: int, poly: int) -> np.ndarray:
    """Least-squares polynomial smoothing weights, one row per output position.

    Row ``i`` gives the weights over the ``window`` points of a full window for
    the value at position ``i`` (centre row = interior weights; the others
    are the edge rows of the polynomial-fit ("interp") end treatment).
    """
    pos = np.arange(window, dtype=float)
    vander = np.vander(pos, poly + 1, increasing=True)
    return vander @ np.linalg.pinv(vander)


def savgol_smooth(series: DataFrame, window: int = 5, poly: int = 2) -> DataFrame:
    """W-7: Savitzky–Golay smoothing, polynomial fit at both ends.

    Interior points use the centre weights over ``[t-h, t+h]``; the first and
    last ``h`` points use the edge rows over the first / last full window.
    Needs ``n >= window``; shorter series are returned unchanged.
    """
    if window % 2 != 1 or poly >= window:
        raise ValueError("window must be odd and larger than poly")
    h = window // 2
    wts = savgol_weights(window, poly)
    n = series.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    b = blocked(series.join(n, KEY), halo=window)
    w = block_window(KEY)
    # value at offset j from t (j may be negative)
    at = {j: (F.lead("x", j) if j > 0 else F.lag("x", -j)).over(w)
          for j in range(-(window - 1), window) if j != 0}
    at[0] = F.col("x")
    t, last = F.col("t"), F.col("_n") - 1
    interior = sum(float(wts[h][k]) * at[k - h] for k in range(window))
    expr = interior
    for i in range(h):  # first h points: window anchored at 0, output row i
        expr = F.when(t == i, sum(float(wts[i][k]) * at[k - i] for k in range(window))).otherwise(expr)
    for i in range(h):  # last h points: window anchored at n-window, row window-1-i
        r = window - 1 - i
        expr = F.when(t == last - i, sum(float(wts[r][k]) * at[k - r] for k in range(window))).otherwise(expr)
    out = b.withColumn("x", F.when(F.col("_n") >= window, expr).otherwise(F.col("x")))
    return out.filter(~F.col(HALO)).drop(BLK, HALO, "_n")
