"""Feature relevance selection (FRESH): V-1 feature kinds, V-2 Kendall tau-b
test (real feature vs target), V-3 two-sample Kolmogorov–Smirnov test
(binary feature vs target), V-4 ANOVA, V-5 Mann–Whitney and Fisher's exact
test, V-6 normal tails, V-7 Benjamini–Yekutieli procedure at level 0.05, V-8
application of the selection.

Targets are real numbers, with as many distinct values as there are rows, and
values are compared as they are.  Ties and class sizes are grouped counts,
Kendall's S comes from ``rankcorr`` and running counts from ``ordering.running``,
so no test has a column per class, a pair of points, or a feature in one task.
The p-value table has one row per feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.functions.columns import normal_two_sided_p, safe_div
from sigframe.operators.ordering import running
from sigframe.operators.rankcorr import SLICE_ROWS, kendall_s
from sigframe.session import cut_lineage

FDR_LEVEL = 0.05
KS_TERMS = 20
KS_LAMBDA_MIN = 0.27


def feature_kinds(features: DataFrame) -> DataFrame:
    """V-1: ``(feature, n_distinct, kind)`` with kind constant / binary / real."""
    nd = features.groupBy("feature").agg(F.count_distinct("value").alias("n_distinct"))
    kind = F.when(F.col("n_distinct") <= 1, "constant").when(F.col("n_distinct") == 2, "binary").otherwise("real")
    return nd.withColumn("kind", kind)


def _ties(pts: DataFrame, col: str, p: str) -> DataFrame:
    """Per feature, the tie terms of ``col``: n, t(t-1)/2, t(t-1)(2t+5) and t(t-1)(t-2)
    summed over its groups of equal values."""
    t = F.col("_t")
    return pts.groupBy("feature", col).agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy("feature").agg(
        F.sum(t).alias(f"{p}n"), F.sum(t * (t - 1) / 2).alias(f"{p}t"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{p}1"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"{p}2"))


def kendall(features: DataFrame, targets: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """V-2: ``(feature, statistic = tau_b, p_value)`` with tie-corrected normal p."""
    pts = cut_lineage(features.join(targets.select("series_id", "target"), "series_id").where(
        F.col("value").isNotNull() & F.col("target").isNotNull()).select("feature", "value", "target"))
    s = kendall_s(pts.select("feature", F.col("value").alias("x"), F.col("target").alias("y")), slice_rows)
    agg = s.select("feature", F.col("s").cast("double").alias("cd")).join(_ties(pts, "value", "x"), "feature").join(
        _ties(pts, "target", "y"), "feature").withColumnRenamed("xn", "n")
    yt, y1, y2 = F.col("yt"), F.col("y1"), F.col("y2")
    n, cd = F.col("n"), F.col("cd")
    n0 = n * (n - 1) / 2
    denom = (n0 - F.col("xt")) * (n0 - yt)
    tau = F.when(denom > 0, cd / F.sqrt(denom))
    m = n * (n - 1)
    var = ((m * (2 * n + 5) - F.col("x1") - y1) / 18 + safe_div(2 * F.col("xt") * yt, m)
           + safe_div(F.col("x2") * y2, 9 * m * (n - 2)))
    p = F.when((denom > 0) & (var > 0) & (n > 2), normal_two_sided_p(cd / F.sqrt(var)))
    return agg.select("feature", tau.alias("statistic"), p.alias("p_value"))


def ks_binary(features: DataFrame, targets: DataFrame) -> DataFrame:
    """V-3: KS distance between the target distributions of the two feature
    values, with the asymptotic Kolmogorov tail (Stephens' small-sample factor)."""
    pts = features.join(targets.select("series_id", "target"), "series_id")
    lo = pts.groupBy("feature").agg(F.min("value").alias("_lo"))
    grp = pts.join(lo, "feature").withColumn("_g", (F.col("value") == F.col("_lo")).cast("int"))
    cnt = grp.groupBy("feature", "target").agg(F.count_if(F.col("_g") == 1).alias("_a"),
                                                F.count_if(F.col("_g") == 0).alias("_b"))
    tot = cnt.groupBy("feature").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    cdf = running(cnt, ["feature"], ["target"], {"_ca": "_a", "_cb": "_b"}).join(tot, "feature").select(
        "feature", safe_div(F.col("_ca"), F.col("_na")).alias("_fa"), safe_div(F.col("_cb"), F.col("_nb")).alias("_fb"),
        "_na", "_nb")
    d = cdf.groupBy("feature").agg(F.max(F.abs(F.col("_fa") - F.col("_fb"))).alias("statistic"),
                                   F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
    en = safe_div(F.col("_na") * F.col("_nb"), F.col("_na") + F.col("_nb"))
    lam = (F.sqrt(en) + 0.12 + safe_div(F.lit(0.11), F.sqrt(en))) * F.col("statistic")
    # Kolmogorov tail: 20 alternating terms; below lambda = 0.27 the tail is 1
    # to within 1e-5 and the truncated series would not converge
    series_sum = sum(((-1) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, KS_TERMS + 1))
    p = F.when(lam < KS_LAMBDA_MIN, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series_sum, F.lit(0.0)), F.lit(1.0)))
    return d.select("feature", "statistic", F.when(F.col("statistic") > 0, p).otherwise(F.lit(1.0)).alias("p_value"))


def feature_pvalues(features: DataFrame, targets: DataFrame) -> DataFrame:
    """V-1..V-3: ``(feature, kind, statistic, p_value)`` for non-constant features."""
    features = cut_lineage(features)  # four passes read it
    kinds = feature_kinds(features)
    real = features.join(kinds.filter(F.col("kind") == "real").select("feature"), "feature", "left_semi")
    binary = features.join(kinds.filter(F.col("kind") == "binary").select("feature"), "feature", "left_semi")
    tested = kendall(real, targets).withColumn("kind", F.lit("real")).unionByName(
        ks_binary(binary, targets).withColumn("kind", F.lit("binary")))
    return tested.select("feature", "kind", "statistic", "p_value")


def benjamini_yekutieli(pvalues: DataFrame, level: float = FDR_LEVEL) -> DataFrame:
    """V-7: rank by p; threshold ``level * k / (m * (1 + 1/2 + ... + 1/m))`` at rank
    k of m; relevant are all ranks up to the largest that meets its threshold.
    Runs on the per-feature table; null p-values rank last and are not relevant."""
    w = Window.orderBy(F.col("p_value").asc_nulls_last(), "feature")
    all_ranks = Window.partitionBy()
    ranked = pvalues.withColumn("rank", F.row_number().over(w))
    ranked = ranked.withColumns({"_h": F.sum(1.0 / F.col("rank")).over(all_ranks),
                                 "_m": F.count(F.lit(1)).over(all_ranks)})
    ranked = ranked.withColumn("threshold", F.lit(level) * F.col("rank") / (F.col("_m") * F.col("_h")))
    last = F.max(F.when(F.col("p_value") <= F.col("threshold"), F.col("rank"))).over(all_ranks)
    return ranked.withColumn("relevant", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("_h", "_m")


def select_relevant(features: DataFrame, relevance: DataFrame) -> DataFrame:
    """V-8: keep the features marked relevant."""
    return features.join(relevance.filter("relevant").select("feature"), "feature", "left_semi")


def _upper_normal_tail(z):
    """P(Z >= z) from the two-sided tail helper."""
    p2 = normal_two_sided_p(z)
    return F.when(z >= 0, p2 / 2).otherwise(1 - p2 / 2)


def anova(features: DataFrame, targets: DataFrame) -> DataFrame:
    """V-4: one-way ANOVA F across target classes per feature; p-value by the
    Wilson–Hilferty normal approximation of the F tail (documented)."""
    pts = features.join(targets.select("series_id", "target"), "series_id")
    per = pts.groupBy("feature", "target").agg(F.count("value").alias("nk"), F.sum("value").alias("sk"),
                                               (F.var_pop("value") * F.count("value")).alias("ssw"))
    g = per.groupBy("feature").agg(F.sum("nk").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("sk").alias("s"),
                                   F.sum("ssw").alias("ssw"),
                                   F.sum(F.col("sk") * F.col("sk") / F.col("nk")).alias("_q"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    ssb = F.col("_q") - F.col("s") * F.col("s") / n
    d1, d2 = k - 1, n - k
    fstat = F.when((d1 > 0) & (d2 > 0) & (F.col("ssw") > 0), (ssb / d1) / (F.col("ssw") / d2))
    c = F.pow(fstat, 1.0 / 3.0)
    z = ((1 - 2 / (9 * d2)) * c - (1 - 2 / (9 * d1))) / F.sqrt(2 / (9 * d2) * c * c + 2 / (9 * d1))
    return g.select("feature", fstat.alias("statistic"), F.when(fstat.isNotNull(), _upper_normal_tail(z)).alias("p_value"))


def mann_whitney(features: DataFrame, binary_targets: DataFrame) -> DataFrame:
    """V-5: two-sided Mann–Whitney U of each feature between target 1 and 0
    (average ranks for ties, tie-corrected normal approximation with continuity)."""
    pts = features.join(binary_targets.select("series_id", "target"), "series_id")
    per_v = pts.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"),
                                                F.count_if(F.col("target") == 1).alias("c1"))
    per_v = running(per_v, ["feature"], ["value"], {"_upto": "c"}).withColumn("_below", F.col("_upto") - F.col("c"))
    avg_rank = F.col("_below") + (F.col("c") + 1) / 2.0
    g = per_v.groupBy("feature").agg(F.sum(F.col("c1") * avg_rank).alias("r1"), F.sum("c").alias("n"),
                                     F.sum("c1").alias("n1"),
                                     F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("tie"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n0 = n - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n0 - u1)
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (u - n1 * n0 / 2 - 0.5) / sigma
    p = F.when((n1 > 0) & (n0 > 0) & (sigma > 0), F.least(normal_two_sided_p(z), F.lit(1.0)))
    return g.select("feature", u1.alias("statistic"), p.alias("p_value"))


def _log_factorial(k: Column) -> Column:
    """ln k! for whole k >= 0: exact table below 16, else Stirling's series (error under 1e-13)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = k.cast("double") + 1
    inv = 1 / x
    series = ((x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi)
              + inv / 12 - F.pow(inv, 3) / 360 + F.pow(inv, 5) / 1260 - F.pow(inv, 7) / 1680)
    return F.when(k < 16, F.get(table, k.cast("int"))).otherwise(series)


def fisher(features: DataFrame, binary_targets: DataFrame) -> DataFrame:
    """V-5, binary feature and binary target: Fisher's exact test, ``(feature, statistic, p_value)``.

    ``statistic`` is the odds ratio of the 2 x 2 counts (null where it divides by 0);
    the two-sided p sums the hypergeometric probabilities of all tables with the
    same margins that are no likelier than the one seen (within 1e-7 of it).
    The tables of one feature are spread over rows, one for each count of the
    first cell, so a large margin is many rows and no loop."""
    pts = features.join(binary_targets.select("series_id", "target"), "series_id")
    lo = pts.groupBy("feature").agg(F.min("value").alias("_lo"))
    hi, one = F.col("value") != F.col("_lo"), F.col("target") == 1
    n = pts.join(lo, "feature").groupBy("feature").agg(
        F.count_if(hi & one).alias("a"), F.count_if(hi & ~one).alias("b"), F.count_if(~hi & one).alias("c"),
        F.count_if(~hi & ~one).alias("d"))
    row, col, all_ = F.col("a") + F.col("b"), F.col("a") + F.col("c"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    f = _log_factorial
    margins = f(row) + f(all_ - row) + f(col) + f(all_ - col) - f(all_)

    def log_p(a: Column) -> Column:
        return margins - f(a) - f(row - a) - f(col - a) - f(all_ - row - col + a)

    tables = n.select("*", F.explode(F.sequence(F.greatest(F.lit(0), row + col - all_), F.least(row, col))).alias("k"))
    tail = tables.groupBy("feature").agg(F.sum(F.when(
        log_p(F.col("k")) <= log_p(F.col("a")) + 1e-7, F.exp(log_p(F.col("k")))).otherwise(0.0)).alias("p"))
    return n.join(tail, "feature").select(
        "feature", safe_div((F.col("a") * F.col("d")).cast("double"), (F.col("b") * F.col("c")).cast("double")).alias("statistic"),
        F.least(F.col("p"), F.lit(1.0)).alias("p_value"))
