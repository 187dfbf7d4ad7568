"""Operator 10: mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time 0 to 1, piecewise linear.
Its integral, scaled to the source's target, is the number of words asked of the
source up to a time.  A document that begins ``c`` words into its source is
therefore due at the time where that demand reaches ``c``: the schedule's
integral is inverted, and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import WORD, written

#: (time, weight) knots, taken in turn by the sources in order: early, steady, late.
CURRICULUM = (((0.0, 3.0), (0.5, 2.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)))
ADDED = ("size", "source_size", "target", "taken", "position")
#: Rows of a source that share one bucket of the running sum, about.
BUCKET_ROWS = 4096


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` for rows ``(_nul, _src, source_size, rows)``, one per source.

    Sources in code-point order, null last, take the weights in turn.  Asking
    every source for weight * level words, none above ``most`` times its size,
    the level is set so that all add up to ``share`` of all words: sources are
    full in the order of their size per weight, so the level is the first one
    that the remaining sources need and that does not fill the next.
    """
    by_name = Window.orderBy("_nul", "_src")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("_rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("_w", F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_full", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_full", "_rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("_need", F.sum("source_size").over(everything) * F.lit(float(share))
                     - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_need") / F.sum("_w").over(after))
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_rank", "_level"))).over(everything)
    s = s.withColumn("_set", level["_level"])
    return s.select("_nul", "_src", "source_size", "rows", "_rank",
                    F.coalesce(F.least("_cap", F.col("_w") * F.col("_set")), F.col("_cap")).alias("target"))


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, ...]]:
    """Pieces ``(c0, c1, t0, w0, slope)`` of a schedule scaled to integral 1."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("times rise and weights are not negative")
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((total, total + area, t0, w0, (w1 - w0) / (t1 - t0)))
        total += area
    if knots[0][0] != 0 or knots[-1][0] != 1 or total <= 0:
        raise ValueError("a schedule runs from time 0 to time 1 and has some weight")
    return [(a / total, b / total, t, w / total, m / total) for a, b, t, w, m in pieces]


def due(share: Column, turn: Column, curriculum: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Time at which the schedule number ``turn`` has asked for ``share`` of its
    words: the piece that holds the share, then its quadratic solved."""
    names = ("c0", "c1", "t0", "w0", "m")
    rows = F.array(*[F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, p, strict=True)])
                               for p in _segments(k)]) for k in curriculum])
    pieces = F.element_at(rows, (turn % len(curriculum) + 1).cast("int"))
    piece = F.coalesce(F.try_element_at(F.filter(pieces, lambda x: x["c1"] > share), F.lit(1)),
                       F.element_at(pieces, -1))
    rest = F.greatest(share - piece["c0"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["m"] * rest, F.lit(0.0)))
    return F.least(piece["t0"] + F.when(rest > 0, 2 * rest / (piece["w0"] + root)).otherwise(0.0), F.lit(1.0))


def _assigned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float,
              most: float, size_col: str | None) -> DataFrame:
    """``docs`` with ``_mx_size``, ``_mx_all`` (its source's words), ``_mx_target``,
    ``_mx_turn`` (its source's rank), ``_mx_at`` (words of the source before it),
    ``_mx_first`` and ``_mx_again`` (words taken in the first and second round)."""
    size = F.col(size_col) if size_col else F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))
    base = docs.withColumns({"_mx_size": size.cast("long"), "_nul": F.col(source_col).isNull(),
                             "_src": F.coalesce(F.col(source_col), F.lit("")),
                             "_md": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))})
    base = base.withColumn("_part", F.conv(F.substring("_md", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)))
    sums = base.groupBy("_nul", "_src").agg(F.sum("_mx_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = written(targets(sums, weights, share, most)).select(
        "_nul", "_src", F.col("source_size").alias("_mx_all"), F.col("rows").alias("_rows"),
        F.col("_rank").alias("_mx_turn"), F.col("target").alias("_mx_target"))
    dealt = base.join(sources, ["_nul", "_src"]).withColumn(
        "_bucket", F.floor(F.col("_part") * (F.floor(F.col("_rows") / BUCKET_ROWS) + 1)))
    keys = ["_nul", "_src", "_bucket"]
    buckets = dealt.groupBy(*keys).agg(F.sum("_mx_size").alias("_sum"))
    along = Window.partitionBy("_nul", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*keys, F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy("_md", "_mx_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_in", F.coalesce(F.sum("_mx_size").over(inside), F.lit(0))).join(starts, keys)
    whole = F.floor("_mx_target").cast("long")
    rows = rows.withColumn("_mx_at", F.col("_start") + F.col("_in"))
    return rows.withColumns({
        "_mx_first": F.greatest(F.lit(0), F.least(F.col("_mx_size"), whole - F.col("_mx_at"))),
        "_mx_again": F.greatest(F.lit(0), F.least(F.col("_mx_size"), whole - F.col("_mx_all") - F.col("_mx_at"))),
    }).drop("_nul", "_src", "_md", "_part", "_rows", "_bucket", "_start", "_in")


def _due(words: Column, curriculum: Sequence[Sequence[tuple[float, float]]]) -> Column:
    share = F.least(words / F.greatest(F.col("_mx_target"), F.lit(1.0)), F.lit(1.0))
    return due(share, F.col("_mx_turn"), curriculum)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
           curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM, size_col: str | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (words asked
    of the source), ``taken`` (words taken of the document) and ``position``
    (training time of its first copy, 0 to 1).

    Within a source, documents stand in the order of the md5 of their id.  The
    mix takes the source's words in that order until the target is reached, and
    once more from the start if the target is above the source's size; only the
    document at the end of a target is taken in part, so a source's ``taken``
    add up to its target, rounded down.  ``most`` is at most 2.

    Running sums never gather a source: ids are dealt by hash range into buckets
    of about 4,096 rows, buckets are pre-aggregated, and only bucket sums are
    added up along a source.

    A null text or no word is size 0, taken 0, due where it stands in its
    source; a null source is a source of its own, last in order; null ids stand
    together at md5 of the empty text; repeated rows are documents of their own.
    An empty table gives no rows.  Input columns of the five added names are
    replaced, all others are kept.
    """
    if most > 2:
        raise ValueError("a source is gone through twice at most")
    a = _assigned(docs, id_col, text_col, source_col, weights, share, most, size_col)
    kept = [c for c in docs.columns if c not in ADDED]
    return a.select(*kept, F.col("_mx_size").alias("size"), F.col("_mx_all").alias("source_size"),
                    F.col("_mx_target").alias("target"), (F.col("_mx_first") + F.col("_mx_again")).cast("long").alias("taken"),
                    _due(F.col("_mx_at"), curriculum).alias("position"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
        curriculum: Sequence[Sequence[tuple[float, float]]] = CURRICULUM) -> DataFrame:
    """The training set: a row per copy of a document that the mix takes, with
    the columns of ``docs`` alone, range-sorted by the copy's position.

    Texts stay whole: a copy is there where at least half of its words are
    taken, so a source stays within a document of its target.  Documents of no
    words stay once.  All else as in ``assign``.
    """
    a = _assigned(docs, id_col, text_col, source_col, weights, share, most, None)
    half = [(2 * F.col(c) >= F.col("_mx_size")) & (F.col("_mx_size") > 0) for c in ("_mx_first", "_mx_again")]
    rounds = F.array(F.when(half[0] | (F.col("_mx_size") == 0), 0), F.when(half[1], 1))
    copies = a.withColumn("_mx_round", F.explode(F.array_compact(rounds)))
    copies = copies.withColumn("_mx_pos", _due(F.col("_mx_at") + F.col("_mx_round") * F.col("_mx_all"), curriculum))
    return copies.orderBy("_mx_pos", "_mx_turn", "_mx_at").select(*docs.columns)
