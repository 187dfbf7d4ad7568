"""F-36 approximate and sample entropy by range counting, without template pairs.

A template of length m is m consecutive values; two match where all values
differ by at most r.  The templates that match one are those in a box around it,
so the matches of all are counted, not listed:

* templates are sorted by their first value, numbered, and packed in blocks, one row a block;
* blocks of one series whose first values come within r of each other meet once;
* inside a pair of blocks, a template's box is an interval of the first value's
  order.  For m = 2 a wavelet matrix over the second value counts in any
  interval; for m = 3 the interval falls into at most two nodes a level of a merge
  tree, in each of which the second value is an interval again and a wavelet
  matrix counts the third.  That is n log^2 n for blocks of n templates.

Counts of a template are added over the blocks it has met before any logarithm is taken.

Series of fewer than ``SHORT`` points take no part in that: many of them go to a task as rows, and
those of one length are counted together, template by template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.operators.features import KEY
from sigframe.operators.features.naming import column_name
from sigframe.operators.ordering import block_window, blocked, dense_index
from sigframe.session import cut_lineage, ship_package

# Template length, tolerances as shares of the standard deviation.
M = 2
APPROXIMATE_R = (0.1, 0.3, 0.5, 0.7, 0.9)
SAMPLE_R = 0.2

#: Comparisons that take less time than a tree.
FEW = 1 << 11

#: Points from which on a series is cut into blocks, and distances held at a time for shorter ones.
SHORT = 1 << 9
HELD = 1 << 20

#: Templates of a block.
BLOCK_ROWS = 1 << 14


class Wavelet:
    """Counts of values below a bound in any interval of an array of ranks."""

    def __init__(self, ranks: np.ndarray):
        self.bits = max(1, int(ranks.max(initial=0)).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            zero = ((ranks >> b) & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def below(self, bound: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many of the ranks at p .. q - 1 are under ``bound``."""
        out = np.zeros(len(bound), np.int64)
        over = bound >= (1 << self.bits)
        out[over] = (q - p)[over]
        bound = np.where(over, 0, bound)
        p, q = p.copy(), q.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            z = self.zeros[level]
            p0, q0, one = z[p], z[q], ((bound >> b) & 1) == 1
            out += np.where(one & ~over, q0 - p0, 0)
            p, q = np.where(one, p - p0 + z[-1], p0), np.where(one, q - q0 + z[-1], q0)
        return out


def ranges(values: np.ndarray, at: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``at`` the ranks [lo, hi) of the sorted, distinct ``values`` that differ
    from it by at most ``r``, as the rounded difference says."""
    lo, hi = np.searchsorted(values, at - r), np.searchsorted(values, at + r, side="right")
    n = len(values)
    for _ in range(2):  # the rounded bound can be off by a neighbour
        lo -= (lo > 0) & (at - values[np.maximum(lo - 1, 0)] <= r)
        hi += (hi < n) & (values[np.minimum(hi, n - 1)] - at <= r)
        lo += (lo < n) & (at - values[np.minimum(lo, n - 1)] > r)
        hi -= (hi > 0) & (values[np.maximum(hi - 1, 0)] - at > r)
    return lo, hi


def _ranked(points: np.ndarray, queries: np.ndarray, r: float):
    values, rank = np.unique(points, return_inverse=True)
    return rank, *ranges(values, queries, r)


def matches(points: np.ndarray, queries: np.ndarray, r: float) -> np.ndarray:
    """How many rows of ``points`` (n, 2 or 3) match each row of ``queries``."""
    if not len(points) or not len(queries):
        return np.zeros(len(queries), np.int64)
    if len(points) * len(queries) <= FEW:  # a short series: less than one level of the tree
        return (np.abs(points[None] - queries[:, None]).max(axis=2) <= r).sum(axis=1)
    order = np.argsort(points[:, 0], kind="stable")
    points = points[order]
    rank, lo, hi = _ranked(points[:, 0], queries[:, 0], r)
    p, q = np.searchsorted(rank, lo), np.searchsorted(rank, hi)
    second, b_lo, b_hi = _ranked(points[:, 1], queries[:, 1], r)
    if points.shape[1] == 2:
        tree = Wavelet(second)
        return tree.below(b_hi, p, q) - tree.below(b_lo, p, q)
    third, c_lo, c_hi = _ranked(points[:, 2], queries[:, 2], r)
    out = np.zeros(len(queries), np.int64)
    place, width = np.arange(len(points)), int(second.max()) + 2
    p, q = p.copy(), q.copy()
    for level in range(len(points).bit_length() + 1):
        # the nodes of this level that the open intervals end on
        ends = [(np.flatnonzero((p < q) & (p & 1 == 1)), p), (np.flatnonzero((p < q) & (q & 1 == 1)), q - 1)]
        if any(len(w) for w, _ in ends):
            key = (place >> level) * width + second
            by = np.argsort(key, kind="stable")
            key, tree = key[by], Wavelet(third[by])
            for who, node in ends:
                at = node[who] * width
                s, e = np.searchsorted(key, at + b_lo[who]), np.searchsorted(key, at + b_hi[who])
                out[who] += tree.below(c_hi[who], s, e) - tree.below(c_lo[who], s, e)
        p, q = np.where(p < q, (p + 1) >> 1, 0), np.where(p < q, q >> 1, 0)
    return out


def templates(series: DataFrame) -> DataFrame:
    """``(keys..., t, a, b, c)``: each value and the two after it (null past the end)."""
    w = block_window(KEY)
    rows = blocked(series.select(*KEY, "t", "x"), halo=M)
    return rows.select(*KEY, "t", "_halo", F.col("x").alias("a"), F.lead("x", 1).over(w).alias("b"),
                       F.lead("x", 2).over(w).alias("c")).where(~F.col("_halo")).drop("_halo")


CASES = [(m, r) for r in (SAMPLE_R, *APPROXIMATE_R) for m in (M, M + 1)]


def _table(p: bytes) -> np.ndarray:
    return np.frombuffer(p).reshape(-1, M + 1)


def template_counts(series: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(keys..., m, r, n, logs, pairs)``: for each template length and tolerance (a share of
    the series' standard deviation) the number of templates, the sum of the logarithms of
    their match counts, and the sum of the counts; own matches are counted."""
    ship_package(series.sparkSession)
    std = series.groupBy(*KEY).agg(F.stddev_pop("x").alias("std"), F.count(F.lit(1)).alias("len"))
    rows = dense_index(templates(series).where(F.col("a").isNotNull() & F.col("b").isNotNull()), KEY, ["a", "t"], out="pos")
    keyed = rows.withColumn("blk", F.floor(F.col("pos") / block_rows).cast("long"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        x = f[["a", "b", "c"]].to_numpy(np.float64)
        return pd.DataFrame({**{k: f[k].iloc[:1] for k in KEY}, "blk": f["blk"].iloc[:1], "lo": x[:1, 0], "hi": x[-1:, 0],
                             "rows": [x.tobytes()]})

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in KEY)
    packed = cut_lineage(keyed.groupBy(*KEY, "blk").applyInPandas(
        pack, f"{kinds}, blk long, lo double, hi double, rows binary").join(std, KEY))
    left = packed.select(*KEY, F.col("blk").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), "std")
    right = packed.select(*KEY, F.col("blk").alias("j"), "lo", "hi")
    reach = F.col("std") * (1.000001 * max(r for _, r in CASES))
    near = left.join(right, KEY).where((F.col("lo") <= F.col("hi_i") + reach) & (F.col("hi") >= F.col("lo_i") - reach))
    near = near.select(*KEY, "i", "j").repartition(*KEY, "i", "j")
    asked = packed.select(*KEY, F.col("blk").alias("i"), F.col("rows").alias("asked"), "std")
    pairs = near.join(asked, [*KEY, "i"]).join(packed.select(*KEY, F.col("blk").alias("j"), "rows"), [*KEY, "j"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f.to_dict("records"):
                own, all_ = _table(p["asked"]), _table(p["rows"])
                out = []
                for m, r in CASES:
                    mine, them = (v[~np.isnan(v[:, m - 1]), :m] for v in (own, all_))
                    out.append(matches(them, mine, r * p["std"]).tobytes())
                yield pd.DataFrame({**{k: [p[k]] * len(CASES) for k in KEY}, "i": p["i"], "which": range(len(CASES)), "counts": out})

    counted = pairs.select(*KEY, "i", "j", "asked", "rows", "std").mapInPandas(count, f"{kinds}, i long, which int, counts binary")

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds the rows of one block and case, which come one after the other."""
        at, sums = None, None

        def closed():
            seen = sums[sums > 0]
            return {**dict(zip(KEY, at, strict=False)), "which": at[-1], "n": len(sums), "logs": float(np.log(seen).sum()),
                    "pairs": int(sums.sum())}

        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                here = (*[getattr(row, k) for k in KEY], row.i, row.which)
                c = np.frombuffer(row.counts, np.int64)
                if here != at:
                    if at is not None:
                        out.append(closed())
                    at, sums = here, c.copy()
                else:
                    sums += c
            yield pd.DataFrame(out, columns=[*KEY, "which", "n", "logs", "pairs"])
        if at is not None:
            yield pd.DataFrame([closed()])

    per = counted.repartition(*KEY, "i", "which").sortWithinPartitions(*KEY, "i", "which").mapInPandas(
        total, f"{kinds}, which int, n long, logs double, pairs long")
    case = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(r).alias("r")) for m, r in CASES])
    return per.groupBy(*KEY, "which").agg(F.sum("n").alias("n"), F.sum("logs").alias("logs"), F.sum("pairs").alias("pairs")).select(
        *KEY, F.get(case, F.col("which"))["m"].alias("m"), F.get(case, F.col("which"))["r"].alias("r"), "n", "logs", "pairs")


def count_together(x: np.ndarray, null: np.ndarray, std: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of :func:`short_counts` for series ``x`` of one length, a row each."""
    a, b, c = (np.pad(x, ((0, 0), (0, j)), constant_values=np.nan)[:, j:] for j in range(M + 1))
    gone = np.pad(null, ((0, 0), (0, M)), constant_values=True)
    valid = ~(gone[:, :-M] | gone[:, 1:-M + 1]) & ~np.isnan(b) & ~np.isnan(std)[:, None]  # no deviation, no tolerance
    with np.errstate(invalid="ignore"):
        near = {M: np.maximum(*(np.abs(np.where(valid, v, np.nan)[:, :, None] - v[:, None]) for v in (a, np.where(valid, b, np.nan))))}
        near[M + 1] = np.maximum(near[M], np.abs(c[:, :, None] - c[:, None]))
        n = {M: valid.sum(axis=1), M + 1: (valid & ~np.isnan(c)).sum(axis=1)}
        counts = {(m, r): (near[m] <= (r * std)[:, None, None]).sum(axis=2) for m, r in CASES}

    def phi(m: int, r: float) -> np.ndarray:
        logs = np.log(np.maximum(counts[m, r], 1)).sum(axis=1)
        return np.where(n[m] > 0, logs / np.maximum(n[m], 1) - np.log(np.maximum(n[m], 1)), np.nan)

    def others(m: int) -> np.ndarray:
        return np.where(n[m] > 0, counts[m, SAMPLE_R].sum(axis=1) - n[m], np.nan)

    return {**{f"_ap{i}": np.abs(phi(M, r) - phi(M + 1, r)) for i, r in enumerate(APPROXIMATE_R)}, "_b": others(M), "_a": others(M + 1)}


def short_counts(series: DataFrame) -> DataFrame:
    """``(keys..., _len, _ap0.., _b, _a)`` of the series of fewer than ``SHORT`` points, one row each."""
    ship_package(series.sparkSession)
    rows = series.where(F.col("t") < SHORT).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("t", "x"))).alias("p"), F.stddev_pop("x").alias("std"), F.max("t").alias("_last"),
        F.count(F.lit(1)).alias("_len")).where(F.col("_last") < SHORT - 1)
    x = F.transform("p", lambda v: v["x"])
    rows = rows.select(*KEY, "_len", "std", x.alias("x"), F.when(F.exists(x, lambda v: v.isNull()), F.transform(
        x, lambda v: v.isNull())).alias("null"))
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in KEY)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, same in f.groupby("_len"):
                step = max(1, HELD // (int(n) * int(n)))
                for at in range(0, len(same), step):
                    g = same.iloc[at:at + step]
                    v = np.array(g["x"].tolist(), np.float64).reshape(len(g), -1)
                    null = np.array([np.zeros(v.shape[1], bool) if m is None else np.asarray(m, bool) for m in g["null"]])
                    yield g[[*KEY, "_len"]].assign(**count_together(v, null, g["std"].to_numpy(np.float64)))

    return rows.mapInPandas(count, f"{kinds}, _len long, " + ", ".join(
        f"{c} double" for c in (*[f"_ap{i}" for i in range(len(APPROXIMATE_R))], "_b", "_a")))


def _long_counts(series: DataFrame, block_rows: int) -> DataFrame:
    """The columns of :func:`short_counts` by :func:`template_counts`."""
    c = template_counts(series, block_rows)

    def of(m: int, r: float, what):
        return F.max(F.when((F.col("m") == m) & (F.col("r") == r) & (F.col("n") > 0), what))

    phi = F.col("logs") / F.col("n") - F.ln(F.col("n").cast("double"))
    others = (F.col("pairs") - F.col("n")).cast("double")
    wide = c.groupBy(*KEY).agg(*[F.abs(of(M, r, phi) - of(M + 1, r, phi)).alias(f"_ap{i}") for i, r in enumerate(APPROXIMATE_R)],
                               of(M, SAMPLE_R, others).alias("_b"), of(M + 1, SAMPLE_R, others).alias("_a"))
    return series.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_len")).join(wide, KEY, "left")


def entropy(series: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """F-36, a column per feature, for ``series(series_id, channel, t, x)``, t dense from 0.

    Approximate entropy is |phi(2) - phi(3)|, phi(m) the mean logarithm of the share of templates
    of length m that match one (itself included), 0 for up to 3 points.  Sample entropy is -ln(A / B), A and B the
    ordered pairs of different templates of length 3 and 2 that match; null without any of either."""
    wide = short_counts(series)
    long = series.where(F.col("t") == SHORT - 1).select(*KEY).distinct()
    if not long.isEmpty():
        wide = wide.unionByName(_long_counts(series.join(long, KEY, "left_semi"), block_rows))
    short = F.col("_len") <= M + 1
    return wide.select(*KEY, *[F.when(short, F.lit(0.0)).otherwise(F.col(f"_ap{i}")).alias(column_name("approximate_entropy", m=M, r=r))
                              for i, r in enumerate(APPROXIMATE_R)],
                      F.when((F.col("_a") > 0) & (F.col("_b") > 0), -F.ln(F.col("_a") / F.col("_b"))).alias("sample_entropy"))
