"""R-4 high-variance confounds and their removal (R-5 with a given
confound set), as distributed linear algebra.

Per scan: voxel series are linearly detrended (``regr_*`` aggregates), the
voxels whose mean square exceeds the scan's (100 - percentile) quantile are
kept (exact distributed quantile), and the leading ``n_confounds``
eigenvectors of ``X X^T`` (time x time) are found in a growing block Krylov
basis ``Q``: ``Z = X^T B`` and ``Y = X Z`` of the newest block ``B`` are joins +
grouped sums over the selected voxels (never a time x time pair table); per scan
(``applyInPandas``, a ``T x m`` basis with ``m <= BASIS``) a Rayleigh–Ritz step
gives the leading vectors and their residuals, which are the next block.  A full
basis is restarted from its leading vectors.  Lineage is cut after every iteration.

A scan is done when the residuals are under ``TOLERANCE`` of the gap between the
last confound's eigenvalue and the next (the sine of the angle to the exact
subspace is at most about their ratio), or at rounding level, where no gap can be
told; if a scan is not done after ``ITERATIONS``, an error is raised.  Individual
vectors are defined up to sign / rotation, so checks compare projections, not
vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features.quantiles import quantile_table
from sigframe.session import cut_lineage, ship_package

N_CONFOUNDS = 5
PERCENTILE = 2.0
ITERATIONS = 500
OVERSAMPLE = 5
#: Columns of a scan's basis at most, in blocks of n_confounds + OVERSAMPLE.
BASIS = 200
TOLERANCE = 1e-8
ROUNDING = 1e-12

#: Per (scan, t): rows of the basis, of its image under X X^T, of the next block, of the leading vectors.
_STATE = "scan_id long, t long, basis array<double>, image array<double>, block array<double>, lead array<double>"


def detrended_voxels(voxels: DataFrame) -> DataFrame:
    """Voxel series (mean per (scan, voxel, t)) minus their least-squares line."""
    vs = voxels.groupBy("scan_id", "voxel", "t").agg(F.avg("x").alias("x"))
    td = F.col("t").cast("double")
    fit = vs.groupBy("scan_id", "voxel").agg(F.regr_slope("x", td).alias("_b"),
                                             F.regr_intercept("x", td).alias("_a"), F.avg("x").alias("_m"))
    trend = F.coalesce(F.col("_a") + F.col("_b") * td, F.col("_m"))
    return vs.join(fit, ["scan_id", "voxel"]).select("scan_id", "voxel", F.col("t").cast("bigint").alias("t"),
                                                     (F.col("x") - trend).alias("x"))


def high_variance_voxels(detrended: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """Rows of the voxels whose mean square is above the scan's quantile."""
    ms = detrended.groupBy("scan_id", "voxel").agg(F.avg(F.col("x") * F.col("x")).alias("v"))
    thr = quantile_table(ms, [1 - percentile / 100.0], keys=["scan_id"], value="v", tie="voxel").select(
        "scan_id", F.col("value").alias("_thr"))
    keep = ms.join(thr, "scan_id").filter(F.col("v") > F.col("_thr")).select("scan_id", "voxel")
    return detrended.join(keep, ["scan_id", "voxel"], "left_semi")


def _rows(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.array(pdf[column].tolist(), dtype=np.float64).reshape(len(pdf), -1)


def _orthonormal(block: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """Orthonormal columns for what of ``block`` is outside ``basis`` and above ``floor``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > floor]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0]


def _state(scan_id: int, t: pd.Series, basis: np.ndarray, image: np.ndarray, block: np.ndarray,
           lead: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"scan_id": scan_id, "t": t.to_numpy(np.int64), "basis": basis.tolist(), "image": image.tolist(),
                         "block": block.tolist(), "lead": lead.tolist()})


def _begin(pdf: pd.DataFrame) -> pd.DataFrame:
    """One scan's first block, orthonormal."""
    pdf = pdf.sort_values("t")
    none = np.zeros((len(pdf), 0))
    return _state(int(pdf["scan_id"].iloc[0]), pdf["t"], none, none, _orthonormal(_rows(pdf, "q"), none, ROUNDING), none)


def _advance(state: pd.DataFrame, image: pd.DataFrame, n: int, k: int, most: int) -> pd.DataFrame:
    """One scan's basis with the newest block and its image added; the leading
    vectors in it, and the next block, which is empty once they have converged."""
    state = state.sort_values("t").reset_index(drop=True)
    block = _rows(state, "block")
    y = np.zeros_like(block)
    y[np.searchsorted(state["t"], image["t"]), image["j"]] = image["y"]
    q, a = np.hstack([_rows(state, "basis"), block]), np.hstack([_rows(state, "image"), y])
    g = q.T @ a
    vals, vecs = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    lead, led = q @ vecs[:, :k], a @ vecs[:, :k]
    residual = led - lead * vals[:k]
    error, top = np.linalg.norm(residual[:, :n]), abs(vals[0])
    gap = vals[n - 1] - vals[n] if len(vals) > n else 0.0
    if error <= max(TOLERANCE * gap, ROUNDING * top):
        following = np.zeros((len(q), 0))
    else:
        if q.shape[1] + k > most:
            q, a = lead, led
        following = _orthonormal(residual, q, ROUNDING * top / 100)
    return _state(int(state["scan_id"].iloc[0]), state["t"], q, a, following, lead[:, :n])


def high_variance_confounds(voxels: DataFrame, n_confounds: int = N_CONFOUNDS, percentile: float = PERCENTILE,
                            iterations: int = ITERATIONS, oversample: int = OVERSAMPLE, basis: int = BASIS) -> DataFrame:
    """``(scan_id, t, c, u)``: ``n_confounds`` orthonormal time courses per scan.
    Raises if a scan has not converged after ``iterations`` blocks."""
    ship_package(voxels.sparkSession)
    x = cut_lineage(high_variance_voxels(detrended_voxels(voxels), percentile))
    k = n_confounds + oversample
    times = x.where("t is not null").select("scan_id", "t").distinct()
    # deterministic start block from a hash of (scan, t, j)
    q = [(F.pmod(F.xxhash64("scan_id", "t", F.lit(j)), F.lit(2001)) - 1000) / 1000.0 for j in range(k)]
    state = cut_lineage(times.select("scan_id", "t", F.array(*q).alias("q")).groupBy("scan_id").applyInPandas(_begin, _STATE))
    for _ in range(iterations):
        going = state.where(F.size("block") > 0)
        block = going.select("scan_id", "t", F.posexplode("block").alias("j", "q"))
        z = x.join(block, ["scan_id", "t"]).groupBy("scan_id", "voxel", "j").agg(F.sum(F.col("x") * F.col("q")).alias("z"))
        y = x.where("t is not null").join(z, ["scan_id", "voxel"]).groupBy("scan_id", "t", "j").agg(
            F.coalesce(F.sum(F.col("x") * F.col("z")), F.lit(0.0)).alias("y"))
        ahead = going.groupBy("scan_id").cogroup(y.groupBy("scan_id")).applyInPandas(
            lambda s, i: _advance(s, i, n_confounds, k, max(basis, 2 * k)), _STATE)
        state = cut_lineage(state.where(F.size("block") == 0).unionByName(ahead))
        if state.where(F.size("block") > 0).isEmpty():
            return state.select("scan_id", "t", F.posexplode("lead").alias("c", "u"))
    raise RuntimeError(f"confounds of some scans have not converged after {iterations} iterations")


#: Eigenvalues of a region's Gram matrix under this share of the largest count as 0.
RANK = 1e-10


def _least_squares(k: int):
    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, right: pd.Series) -> pd.Series:
        """Coefficients from the upper triangle of U'U and U'x; smallest norm where U'U is singular."""
        g = np.zeros((len(gram), k, k))
        i, j = np.triu_indices(k)
        g[:, i, j] = g[:, j, i] = np.array(gram.tolist()).reshape(len(gram), -1)
        b = np.array(right.tolist()).reshape(len(gram), k)
        vals, vecs = np.linalg.eigh(g)
        keep = vals > RANK * np.maximum(vals[:, -1:], 1e-300)
        inverse = np.where(keep, 1 / np.where(keep, vals, 1.0), 0.0)
        beta = np.einsum("nij,nj,nkj,nk->ni", vecs, inverse, vecs, b)
        return pd.Series(list(beta))
    return solve


def project_out(regions: DataFrame, confounds: DataFrame) -> DataFrame:
    """R-5 / R-7 with confounds ``(scan_id, t, c, u)``, c from 0: the least-squares residual
    of each (scan, label) on the scan's confounds, over the points that the region has.

    The k x k Gram matrix and the k products of a region are grouped sums, so
    regions may lack time points (the confounds are then not orthonormal on the
    rest).  Points at which the scan has no confounds, and null values, stay as they are."""
    ship_package(regions.sparkSession)
    top = confounds.agg(F.max("c")).first()[0]
    if top is None:
        return regions.select("scan_id", "label", "t", F.col("x").cast("double").alias("x"))
    k = top + 1
    wide = confounds.groupBy("scan_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("c", "u"))).alias("_m"))
    u = [F.coalesce(F.get(F.col("_u"), F.lit(c)), F.lit(0.0)) for c in range(k)]
    wide = wide.select("scan_id", "t", F.array(*[F.try_element_at("_m", F.lit(c).cast("int")) for c in range(k)]).alias("_u"))
    joined = regions.join(wide, ["scan_id", "t"], "left")
    has = joined.where(F.col("_u").isNotNull() & F.col("x").isNotNull())
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = has.groupBy("scan_id", "label").agg(
        *[F.sum(u[i] * u[j]).alias(f"_g{n}") for n, (i, j) in enumerate(pairs)],
        *[F.sum(F.col("x") * u[i]).alias(f"_b{i}") for i in range(k)])
    beta = sums.select("scan_id", "label", _least_squares(k)(
        F.array(*[F.col(f"_g{n}") for n in range(len(pairs))]), F.array(*[F.col(f"_b{i}") for i in range(k)])).alias("_beta"))
    fit = sum((F.get(F.col("_beta"), F.lit(i)) * u[i] for i in range(1, k)), F.get(F.col("_beta"), F.lit(0)) * u[0])
    return joined.join(beta, ["scan_id", "label"], "left").select(
        "scan_id", "label", "t", F.when(F.col("_u").isNull() | F.col("_beta").isNull(), F.col("x").cast("double")).otherwise(
            F.col("x") - fit).alias("x"))
