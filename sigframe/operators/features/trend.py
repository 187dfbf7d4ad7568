"""Trend features: F-15 linear_trend, F-16 agg_linear_trend, F-14
Dickey–Fuller statistic (re-aimed: no lag search, no p-value surface) and
F-9 change_quantiles.

Regressions use the ``regr_*`` / ``corr`` aggregates (partial, mergeable);
p-values use the normal approximation of the t statistic (documented
deviation from a Student-t tail).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.columns import normal_two_sided_p
from sigframe.operators.features import KEY
from sigframe.operators.features.naming import column_name
from sigframe.operators.features.quantiles import quantile_table
from sigframe.operators.ordering import HALO, block_window, blocked

# Default parameter grids of the calculators.
AGG_CHUNKS = [5, 10, 50]
AGG_FUNCS = ["max", "min", "mean", "var"]
CHANGE_Q = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def _regression(y, x, n):
    """slope, intercept, rvalue, stderr, pvalue columns of y ~ x over n points."""
    vy, vx = F.var_pop(y), F.var_pop(x)
    r = F.when((vy > 0) & (vx > 0), F.covar_pop(y, x) / F.sqrt(vy * vx))
    df = n - 2
    # 1 - r^2 is clamped at 0: |r| can exceed 1 by rounding for collinear points
    stderr = F.when(df > 0, F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * F.var_pop(y) / F.var_pop(x) / df))
    tstat = r * F.sqrt(df / ((1 - r) * (1 + r)))
    pvalue = F.when(df > 0, F.when(F.abs(r) < 1, normal_two_sided_p(tstat)).otherwise(F.lit(0.0)))
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "rvalue": r,
            "stderr": stderr, "pvalue": pvalue}


def linear_trend(series: DataFrame) -> DataFrame:
    t = F.col("t").cast("double")
    reg = _regression(F.col("x"), t, F.count("x"))
    return series.groupBy(*KEY).agg(*[reg[a].alias(column_name("linear_trend", attr=a))
                                      for a in ("pvalue", "rvalue", "intercept", "slope", "stderr")])


def agg_linear_trend(series: DataFrame) -> DataFrame:
    """Regressions over chunk aggregates for every chunk length in one pass:
    points are expanded to one row per chunk length (3x), aggregated per
    (series, channel, length, chunk), regressed per (series, channel, length)."""
    c = F.explode(F.array(*[F.lit(v).cast("bigint") for v in AGG_CHUNKS])).alias("_len")
    rows = series.select(*KEY, "t", "x", c)
    per = rows.groupBy(*KEY, "_len", F.floor(F.col("t") / F.col("_len")).cast("bigint").alias("_c")).agg(
        F.max("x").alias("max"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    m = F.count(F.lit(1))
    aggs = []
    for f in AGG_FUNCS:
        reg = _regression(F.col(f), F.col("_c").cast("double"), m)
        for a in ("rvalue", "intercept", "slope", "stderr"):
            aggs.append(F.when(m > 1, reg[a]).alias(f"{f}_{a}"))
    fits = per.groupBy(*KEY, "_len").agg(*aggs)
    cols = []
    for length in AGG_CHUNKS:
        for f in AGG_FUNCS:
            for a in ("rvalue", "intercept", "slope", "stderr"):
                cols.append(F.max(F.when(F.col("_len") == length, F.col(f"{f}_{a}"))).alias(
                    column_name("agg_linear_trend", attr=a, chunk_len=length, f_agg=f)))
    return fits.groupBy(*KEY).agg(*cols)


def dickey_fuller(series: DataFrame) -> DataFrame:
    """t statistic of b in dx_t = a + b x_{t-1} (lag 0), NULL when undefined."""
    b = blocked(series, halo=1)
    w = block_window(KEY)
    own = b.select(*KEY, HALO, "x", F.lag("x", 1).over(w).alias("_l")).filter(~F.col(HALO))
    d = F.col("x") - F.col("_l")
    ok = own.filter(F.col("_l").isNotNull())
    sxx, syy, sxy = F.regr_sxx(d, F.col("_l")), F.regr_syy(d, F.col("_l")), F.regr_sxy(d, F.col("_l"))
    m = F.count(F.lit(1))
    resid = (syy - sxy * sxy / sxx) / (m - 2)
    stat = F.when((m > 2) & (sxx > 0) & (resid > 0), (sxy / sxx) / F.sqrt(resid / sxx))
    return ok.groupBy(*KEY).agg(stat.alias('augmented_dickey_fuller__attr_teststat'))


def change_quantiles(series: DataFrame) -> DataFrame:
    """Mean / variance of (absolute) changes with both ends inside a quantile corridor."""
    qt = quantile_table(series, CHANGE_Q)
    edges = qt.groupBy(*KEY).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"_q{i}")
                                   for i, q in enumerate(CHANGE_Q)])
    b = blocked(series.join(edges, KEY, "left"), halo=1)
    w = block_window(KEY)
    b = b.withColumn("_x1", F.lead("x", 1).over(w))
    own = b.filter(~F.col(HALO) & F.col("_x1").isNotNull())
    x, x1 = F.col("x"), F.col("_x1")
    aggs = []
    for i, ql in enumerate(CHANGE_Q):
        for k, qh in enumerate(CHANGE_Q):
            if ql >= qh:
                continue
            lo, hi = F.col(f"_q{i}"), F.col(f"_q{k}")
            inside = (lo < hi) & (x >= lo) & (x <= hi) & (x1 >= lo) & (x1 <= hi)
            for isabs in (False, True):
                d = F.abs(x1 - x) if isabs else x1 - x
                for f in ("mean", "var"):
                    agg = F.avg(F.when(inside, d)) if f == "mean" else F.var_pop(F.when(inside, d))
                    aggs.append(F.coalesce(agg, F.lit(0.0)).alias(
                        column_name("change_quantiles", f_agg=f, isabs=isabs, qh=qh, ql=ql)))
    out = own.groupBy(*KEY).agg(*aggs)
    return series.select(*KEY).distinct().join(out, KEY, "left").fillna(0.0)


def trend(series: DataFrame) -> DataFrame:
    return linear_trend(series).join(agg_linear_trend(series), KEY).join(dickey_fuller(series), KEY, "left")


def linear_trend_timewise(series_ts: DataFrame) -> DataFrame:
    """F-17: linear trend of x over hours since the series' first time stamp
    (input carries ``ts``)."""
    # time differences on the stamps themselves (no session time-zone involved)
    first = series_ts.groupBy(*KEY).agg(F.min("ts").alias("_t0"))
    hours = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("ts")).cast("double") / F.lit(3600.0 * 1e6)
    j = series_ts.join(first, KEY).withColumn("_h", hours)
    reg = _regression(F.col("x"), F.col("_h"), F.count("x"))
    return j.groupBy(*KEY).agg(*[reg[a].alias(column_name("linear_trend_timewise", attr=a))
                                 for a in ("pvalue", "rvalue", "intercept", "slope", "stderr")])
