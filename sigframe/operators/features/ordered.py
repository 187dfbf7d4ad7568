"""Order-dependent features on the block/halo decomposition:

F-19 longest_strike_above_mean / below_mean (run starts carried across blocks),
F-27 number_peaks (complete frames of width n on both sides),
F-28 index_mass_quantile (running |x| mass carried across blocks),
F-37 permutation_entropy (ordinal patterns of d consecutive points) and
mean_n_absolute_max (salted two-level top-k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.operators.features import KEY
from sigframe.operators.features.location import series_stats
from sigframe.operators.features.naming import column_name
from sigframe.operators.ordering import BLK, HALO, block_carry, block_window, blocked, top_k_per_group

# Default parameter grids of the calculators.
PEAK_SUPPORTS = [1, 3, 5, 10, 50]
MASS_QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
PERMUTATION_DIMS = [3, 4, 5, 6, 7]
N_ABS_MAX = 7


def strikes(series: DataFrame) -> DataFrame:
    """Longest run of consecutive points above / below the series mean."""
    st = series_stats(series).select(*KEY, "_m")
    b = blocked(series.join(st, KEY), halo=1)
    w = block_window(KEY)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = b
    for name, flag in (("above", F.col("x") > F.col("_m")), ("below", F.col("x") < F.col("_m"))):
        f = F.coalesce(flag, F.lit(False))
        prev = F.coalesce(F.lag(f, 1).over(w), F.lit(False))
        nxt = F.coalesce(F.lead(f, 1).over(w), F.lit(False))
        out = out.withColumn(f"_s_{name}", F.when(f & ~prev, F.col("t")))
        out = out.withColumn(f"_e_{name}", f & ~nxt)
        out = out.withColumn(f"_ls_{name}", F.max(f"_s_{name}").over(upto))
    own = out.filter(~F.col(HALO))
    carry = block_carry(own, KEY, {f"_c_{k}": ("max", F.col(f"_s_{k}")) for k in ("above", "below")})
    j = own.join(carry, [*KEY, BLK], "left")
    aggs = []
    for k in ("above", "below"):
        start = F.greatest(F.col(f"_ls_{k}"), F.col(f"_c_{k}"))
        length = F.when(F.col(f"_e_{k}"), F.col("t") - start + 1)
        aggs.append(F.coalesce(F.max(length), F.lit(0)).cast("bigint").alias(f"longest_strike_{k}_mean"))
    return j.groupBy(*KEY).agg(*aggs)


def peaks(series: DataFrame) -> DataFrame:
    """Number of points larger than their ``n`` neighbours on both sides."""
    h = max(PEAK_SUPPORTS)
    b = blocked(series, halo=h)
    w = block_window(KEY)
    cols = []
    for n in PEAK_SUPPORTS:
        left, right = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
        is_peak = ((F.count("x").over(left) == n) & (F.count("x").over(right) == n) &
                   (F.col("x") > F.max("x").over(left)) & (F.col("x") > F.max("x").over(right)))
        cols.append(is_peak.alias(f"_p{n}"))
    own = b.select(*KEY, HALO, *cols).filter(~F.col(HALO))
    return own.groupBy(*KEY).agg(*[F.count_if(F.col(f"_p{n}")).alias(column_name("number_peaks", n=n))
                                   for n in PEAK_SUPPORTS])


def index_mass(series: DataFrame) -> DataFrame:
    """Relative index where the running |x| mass first reaches each quantile."""
    st = series_stats(series).select(*KEY, "_n")
    tot = series.groupBy(*KEY).agg(F.sum(F.abs("x")).alias("_tot"))
    b = blocked(series, halo=0)
    w = block_window(KEY).rowsBetween(Window.unboundedPreceding, 0)
    own = b.withColumn("_run", F.sum(F.abs("x")).over(w))
    carry = block_carry(own, KEY, {"_cm": ("sum", F.abs(F.col("x")))})
    j = own.join(carry, [*KEY, BLK], "left").join(st, KEY).join(tot, KEY)
    frac = (F.col("_run") + F.coalesce(F.col("_cm"), F.lit(0.0))) / F.col("_tot")
    aggs = [F.when(F.first("_tot") != 0, (F.min(F.when(frac >= q, F.col("t"))) + 1) / F.first("_n"))
            .alias(column_name("index_mass_quantile", q=q)) for q in MASS_QUANTILES]
    return j.groupBy(*KEY).agg(*aggs)


def permutation_entropy(series: DataFrame) -> DataFrame:
    """Shannon entropy of ordinal patterns (tau = 1) for each dimension."""
    h = max(PERMUTATION_DIMS) - 1
    b = blocked(series, halo=h)
    w = block_window(KEY)
    b = b.select(*KEY, HALO, "x", *[F.lead("x", k).over(w).alias(f"_x{k}") for k in range(1, h + 1)])
    own = b.filter(~F.col(HALO))
    rows = []
    for d in PERMUTATION_DIMS:
        vals = [F.col("x")] + [F.col(f"_x{k}") for k in range(1, d)]
        # ordinal pattern as an integer: rank of each value (ties by position)
        # in base d; plain comparisons keep it inside whole-stage codegen
        code = F.lit(0).cast("bigint")
        for i in range(d):
            rank = sum(((vals[j] < vals[i]) | ((vals[j] == vals[i]) & F.lit(j < i))).cast("bigint")
                       for j in range(d) if j != i)
            code = code + rank * F.lit(d ** i)
        rows.append(F.when(F.col(f"_x{d - 1}").isNotNull(),
                           F.struct(F.lit(d).alias("d"), code.alias("pat"))))
    pats = own.select(*KEY, F.explode(F.filter(F.array(*rows), lambda e: e.isNotNull())).alias("e"))
    counts = pats.groupBy(*KEY, F.col("e.d").alias("d"), F.col("e.pat").alias("pat")).agg(
        F.count(F.lit(1)).alias("c"))
    tot = Window.partitionBy(*KEY, "d")
    probs = counts.withColumn("p", F.col("c") / F.sum("c").over(tot))
    ent = probs.groupBy(*KEY, "d").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    keys = series.select(*KEY).distinct()
    wide = ent.groupBy(*KEY).agg(*[F.max(F.when(F.col("d") == d, F.col("h")))
                                   .alias(column_name("permutation_entropy", dimension=d, tau=1))
                                   for d in PERMUTATION_DIMS])
    return keys.join(wide, KEY, "left")


def mean_n_absolute_max(series: DataFrame) -> DataFrame:
    """Mean of the ``N_ABS_MAX`` largest |x| (NULL unless n > N_ABS_MAX)."""
    st = series_stats(series).select(*KEY, "_n")
    top = top_k_per_group(series.withColumn("_a", F.abs("x")), KEY, [F.col("_a").desc(), F.col("t")], N_ABS_MAX)
    agg = top.groupBy(*KEY).agg(F.avg("_a").alias("_v"))
    name = column_name("mean_n_absolute_max", number_of_maxima=N_ABS_MAX)
    return st.join(agg, KEY).select(*KEY, F.when(F.col("_n") > N_ABS_MAX, F.col("_v")).alias(name))


def ordered(series: DataFrame) -> DataFrame:
    """All order-dependent families side by side (one row per series/channel)."""
    out = strikes(series)
    for part in (peaks(series), index_mass(series), permutation_entropy(series), mean_n_absolute_max(series)):
        out = out.join(part, KEY)
    return out
