"""Skew-safe ordering primitives.

A single series may hold a large share of all rows, so nothing here partitions
by the series key alone:

* :func:`dense_index` numbers rows 0..n-1 inside a key group.  Rows are range
  partitioned on ``(keys, order)`` — a hot key spans many tasks — each task
  numbers its sorted slice with ``monotonically_increasing_id`` and a small
  ``(partition, key)`` summary supplies each slice's offset (the
  ``zipWithIndex`` pattern expressed with DataFrame operators).
* :func:`blocked` cuts a densely indexed series into fixed-size blocks of ``t``
  and copies ``halo`` edge rows into the neighbouring blocks, so lag/lead and
  bounded frames of width <= ``halo`` are exact inside each block while every
  window partition holds at most ``block + 2*halo`` rows.
* :func:`block_carry` turns per-block aggregates into exclusive running values
  (sum / max / min of all earlier blocks) for running totals across blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.session import cut_lineage

# Rows per block of a series.  Large enough that test-sized series are one
# block; small enough that a block always fits one task at any scale.
# Read at call time, so tests can shrink it to exercise multi-block plans.
DEFAULT_BLOCK = 1 << 20

BLK = "_blk"
HALO = "_halo"


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                out: str = "t", partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row inside ``keys`` ordered by ``order``.

    ``order`` must be a total order inside each group (include a unique
    tie-breaker) so the numbering is reproducible after task retries.
    Equivalent SQL: ``row_number() over (partition by keys order by order) - 1``.
    """
    keys = list(keys)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # Without an explicit count the range exchange follows
    # spark.sql.shuffle.partitions and AQE may coalesce small neighbours
    # (adjacent ranges stay ordered), so slice sizes track the data volume.
    cols = [*[F.col(k) for k in keys], *order_cols]
    exchanged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    # Range bounds come from sampling, so the tagged slices are materialised
    # once (reliable checkpoint) and both the summary and the join-back read
    # the same partition ids and positions.
    ranged = cut_lineage(
        exchanged
        .sortWithinPartitions(*cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    slices = ranged.groupBy("_pid", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = ranged.join(slices.select("_pid", *keys, "_first", "_off"), on=["_pid", *keys])
    return joined.withColumn(
        out, (F.col("_pos") - F.col("_first") + F.col("_off")).cast("bigint")
    ).drop("_pid", "_pos", "_first", "_off")


def blocked(df: DataFrame, t: str = "t", halo: int = 0, block: int | None = None) -> DataFrame:
    """Add ``_blk`` (block of ``t``) and ``_halo`` (copy from a neighbour block).

    Rows of the last ``halo`` positions of a block are copied into the next
    block and rows of the first ``halo`` positions into the previous one.
    Window results must be read from rows with ``_halo = false`` only.
    """
    import sigframe.operators.ordering as _self

    block = block or _self.DEFAULT_BLOCK
    if halo * 2 >= block:
        raise ValueError("block must exceed twice the halo")
    b = F.floor(F.col(t) / F.lit(block)).cast("bigint")
    r = F.col(t) - b * F.lit(block)
    if halo <= 0:
        return df.withColumn(BLK, b).withColumn(HALO, F.lit(False))
    entries = F.array(
        F.struct(b.alias("b"), F.lit(False).alias("h")),
        F.when(r >= block - halo, F.struct((b + 1).alias("b"), F.lit(True).alias("h"))),
        F.when((r < halo) & (b > 0), F.struct((b - 1).alias("b"), F.lit(True).alias("h"))),
    )
    return (
        df.withColumn("_e", F.explode(F.filter(entries, lambda e: e.isNotNull())))
        .withColumn(BLK, F.col("_e.b"))
        .withColumn(HALO, F.col("_e.h"))
        .drop("_e")
    )


def block_window(keys: Sequence[str], t: str = "t"):
    """Window over one block of one series (use on :func:`blocked` output)."""
    return Window.partitionBy(*keys, BLK).orderBy(t)


def block_carry(own_rows: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Exclusive carry-in per block: aggregate of every earlier block of the key.

    ``aggs`` maps output name -> (kind, column) with kind in sum/max/min.
    Returns ``(keys..., _blk, name...)``; the table has one row per block, so
    it is small and joins back on ``(keys, _blk)``.
    """
    per_block = own_rows.groupBy(*keys, BLK).agg(
        *[getattr(F, kind)(col).alias(name) for name, (kind, col) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *keys, BLK, *[getattr(F, kind)(F.col(name)).over(before).alias(name)
                      for name, (kind, _c) in aggs.items()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str],
            block: int | None = None) -> DataFrame:
    """Add, for each ``name: column`` of ``sums``, the sum of ``column`` up to and
    including the row inside ``keys`` ordered by ``order`` (a total order).

    A hot key spans many blocks: sums run inside a block, and the totals of the
    blocks before it are added."""
    rows = blocked(dense_index(df, keys, order, out="_t"), t="_t", block=block)
    w = block_window(keys, "_t").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.sum(c).over(w).alias(f"_own_{n}") for n, c in sums.items()])
    carry = block_carry(rows, keys, {f"_carry_{n}": ("sum", F.col(c)) for n, c in sums.items()})
    joined = own.join(carry, [*keys, BLK])
    return joined.select(*[F.col(c) for c in df.columns], *[
        (F.col(f"_own_{n}") + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n) for n in sums])


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
                    salt_buckets: int = 64, salt_of: Column | None = None) -> DataFrame:
    """Exact first ``k`` rows per group by ``order`` (a total order), skew-safe.

    Level 1 keeps <= k rows per (group, salt) — a hot group is spread over
    ``salt_buckets`` tasks; level 2 ranks the <= k * salt_buckets survivors.
    Adds ``rank`` (1-based).
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    salt = salt_of if salt_of is not None else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_cols)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order_cols)
    return pre.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)
