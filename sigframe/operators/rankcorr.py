"""Kendall's S of many features at once, without pairs, class columns or a task per feature.

S is the sum over all pairs of points of ``sign(dx) * sign(dy)``.  Points are
first counted by ``(feature, x, y)``.  Borders at quantiles cut both axes into
slices of at most about ``slice_rows`` points; a border value is a slice of its
own, so a value that many points share never widens one.  Then

* pairs inside a slice of x are counted in that slice,
* pairs inside a slice of y but in different slices of x are counted in that one,
  with the number of the slice as x,
* all other pairs differ in both slices, so the counts of the cells
  (slice of x, slice of y) stand for them: these are the points of the next level.

Each level has far fewer points than the one before; the last one fits one slice.
A slice is counted by a bitwise merge over the ranks of x, in n log n.  The
borders decide only where the work is done, so approximate quantiles give an
exact result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.session import cut_lineage, ship_package

#: Points of a slice, and borders of all features and both axes that the driver may hold.
SLICE_ROWS = 1 << 16
MOST_BORDERS = 1 << 22


def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum over pairs of ``w * w' * sign(dx) * sign(dy)``."""
    xr = np.unique(x, return_inverse=True)[1]
    yr = np.unique(y, return_inverse=True)[1]
    by_y = np.argsort(yr, kind="stable")
    xr, yr, w = xr[by_y], yr[by_y], np.asarray(w, np.int64)[by_y]
    total = 0
    for level in range(int(xr.max(initial=0)).bit_length()):
        # pairs whose ranks first differ in this bit: same block, lower half against upper half
        block = xr >> (level + 1)
        at = np.argsort(block, kind="stable")
        b, r, ww = block[at], yr[at], w[at]
        low = np.where((xr[at] >> level) & 1, 0, ww)
        run = np.concatenate([[0], np.cumsum(low)])
        start = np.concatenate([[True], b[1:] != b[:-1]])
        tie = start | np.concatenate([[True], r[1:] != r[:-1]])
        block_of, tie_of = np.cumsum(start) - 1, np.cumsum(tie) - 1
        first, last = np.flatnonzero(tie), np.append(np.flatnonzero(tie)[1:], len(b))
        block_end = np.append(np.flatnonzero(start)[1:], len(b))[block_of]
        below = run[first][tie_of] - run[np.flatnonzero(start)][block_of]
        above = run[block_end] - run[last][tie_of]
        total += int(((ww - low) * (below - above)).sum())
    return total


def _borders(points: DataFrame, k: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    share = [F.lit((i + 1) / (k + 1)) for i in range(k)]
    rows = points.groupBy("feature").agg(*[
        F.percentile_approx(c, F.array(*share), 20 * k).alias(c) for c in ("x", "y")]).collect()
    return {r["feature"]: (np.unique(r["x"]), np.unique(r["y"])) for r in rows}


def _slices(points: DataFrame, k: int) -> DataFrame:
    """``points`` with ``xs`` and ``ys``: even between borders, odd on a border."""
    borders = _borders(points, k)

    def place(v: np.ndarray, at: np.ndarray) -> np.ndarray:
        lower = np.searchsorted(at, v, side="left")
        return 2 * lower + (at[np.minimum(lower, len(at) - 1)] == v)

    def run(frames):
        for f in frames:
            xs, ys = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for name, own in f.groupby("feature", sort=False).indices.items():
                bx, by = borders[name]
                xs[own], ys[own] = place(f["x"].to_numpy()[own], bx), place(f["y"].to_numpy()[own], by)
            yield f.assign(xs=xs, ys=ys)

    return points.mapInPandas(run, "feature string, x double, y double, w long, xs long, ys long")


def _count(x: str, y: str):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": f["feature"].iloc[:1], "s": [signed_pairs(f[x], f[y], f["w"].to_numpy())]})
    return run


def kendall_s(points: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(feature, s)`` for ``points(feature, x, y)``; rows with a null, features
    included, are left out.  Exact up to 3 * 10^9 points a feature (s is a long)."""
    ship_package(points.sparkSession)
    level = points.where(F.col("feature").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(
        "feature", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(
        F.count(F.lit(1)).cast("long").alias("w"))
    parts = []
    while True:
        level = cut_lineage(level)
        size = level.groupBy("feature").count().agg(F.max("count").alias("n"), F.count(F.lit(1)).alias("features")).first()
        if size["n"] is None or size["n"] <= slice_rows:
            break
        # with 4n/k^2 cells of n points at most, every level is far smaller than the last
        most = max(slice_rows, 32 * math.isqrt(size["n"]))
        k = min(max(1, math.ceil(size["n"] / most)), max(1, MOST_BORDERS // (2 * size["features"])))
        cut = cut_lineage(_slices(level, k))
        parts.append(cut.where("xs % 2 = 0").groupBy("feature", "xs").applyInPandas(_count("x", "y"), "feature string, s long"))
        parts.append(cut.where("ys % 2 = 0").groupBy("feature", "ys").applyInPandas(_count("xs", "y"), "feature string, s long"))
        level = cut.groupBy("feature", F.col("xs").cast("double").alias("x"), F.col("ys").cast("double").alias("y")).agg(
            F.sum("w").alias("w"))
    out = level.groupBy("feature").applyInPandas(_count("x", "y"), "feature string, s long")
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("feature").agg(F.sum("s").alias("s"))
