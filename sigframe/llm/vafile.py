"""Centroid clustering over a vector-approximation file.

Every vector is kept twice, in one row: as cells, ``bits`` bits a dimension, and
as its grid of whole numbers.  For each round a table per dimension, cell and
centroid gives the least and the largest squared difference that a number in the
cell can have; added up over the dimensions they are the interval of a vector's
distance to a centroid.  A centroid whose interval starts above the smallest end
of all is out.  Only where more than one is left is the full vector fetched and
measured.

All numbers are whole, so bounds, sums and means are exact and the cells change
nothing but the work.  The sums of a round are carried on from the round before:
a vector whose intervals under both rounds' centroids name the same cluster
changes no sum and is not fetched either.

A round is one scan without a shuffle of vectors: a task returns a row per
cluster (sum, count), and these are added by Spark.  The driver holds the
centroids, the borders of the cells and one row a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Step
from sigframe.session import ship_package

#: A component of a grid has at most this size, so that a squared distance over 64 of them fits a long.
LARGEST = 1 << 27
#: Vectors from which the borders between cells are cut; they change the work and not the result.
SAMPLE_ROWS = 4096


def grid_vectors(df: DataFrame, vector_col: str = "embedding", dims: int = 64, scale: float = 64.0) -> tuple[Column, Column]:
    """``(usable, grid)``: whether a row's vector has ``dims`` finite components,
    and its components as ``floor(scale * x)``."""
    v = F.col(f"`{vector_col}`")
    ok = F.size(v) == dims
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    grid = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)))
    return F.coalesce(v.isNotNull() & ok & fine, F.lit(False)), grid


class Cells:
    """Borders of the cells: ``inner`` (dims, cells - 1) cuts a dimension evenly where
    all but 2 in 1000 of the sample lie, and the least and largest number in the
    table close its ends."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int):
        n = 1 << bits
        a, b = np.quantile(sample, [0.001, 0.999], axis=0, method="nearest")
        at = np.arange(n - 1) / max(n - 2, 1)
        self.inner = np.ceil(a[:, None] + (np.maximum(b - a, n - 2) + 1)[:, None] * at).astype(np.int64)
        # cell j holds the numbers in [inner[j - 1], inner[j] - 1]
        self.first = np.concatenate([low[:, None], self.inner], axis=1)
        self.last = np.concatenate([self.inner - 1, high[:, None]], axis=1)
        self.bits = bits

    def encode(self, grid: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.inner[d], grid[:, d], side="right") for d in range(grid.shape[1])],
                        axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared difference, each (dims, cells, centroids).
        Cells without a number in them are never looked up."""
        c = centroids.T[:, None, :]
        below, above = self.first[:, :, None] - c, c - self.last[:, :, None]
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        return least * least, most * most

    def candidates(self, cells: np.ndarray, tables) -> np.ndarray:
        """(rows, centroids): whether a centroid can be the nearest."""
        least = np.zeros((len(cells), tables[0].shape[2]), np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            least += tables[0][d][cells[:, d]]
            most += tables[1][d][cells[:, d]]
        return least <= most.min(axis=1, keepdims=True)


def pack_cells(cells: np.ndarray, bits: int) -> list[bytes]:
    wide = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(cells), -1)
    return [r.tobytes() for r in np.packbits(wide, axis=1)]


def unpack_cells(packed: pa.Array, dims: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    one = np.unpackbits(raw, axis=1)[:, :dims * bits].reshape(len(packed), dims, bits)
    wide = np.zeros((len(packed), dims, 8), np.uint8)
    wide[:, :, 8 - bits:] = one
    return np.packbits(wide, axis=2)[:, :, 0]


def fetch(grid: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """The full vectors of ``rows`` (all, if None)."""
    some = grid if rows is None else grid.take(pa.array(rows))
    return np.frombuffer(b"".join(some.to_pylist()), "<i8").reshape(len(some), -1)


def nearest(cells: np.ndarray, grid: pa.Array, borders: Cells, centroids: np.ndarray, tables) -> np.ndarray:
    """Nearest centroid of every row (ties: the smaller number); a row's vector is
    read only where the intervals leave more than one."""
    left = borders.candidates(cells, tables)
    out = left.argmax(axis=1)
    open_ = np.flatnonzero(left.sum(axis=1) > 1)
    if len(open_):
        gap = fetch(grid, open_)[:, None, :] - centroids[None, :, :]
        far = (gap * gap).sum(axis=2)
        out[open_] = np.where(left[open_], far, np.iinfo(np.int64).max).argmin(axis=1)
    return out


#: Rows worked on at a time, so that rows x centroids x dims stays small.
CHUNK = 2048


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, CHUNK):
            part = b.slice(i, CHUNK)
            yield part, unpack_cells(part.column("cells"), dims, bits)


def _ends(dims: int):
    """Per task, the least and the largest number of each dimension."""
    def run(batches):
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        seen = False
        for b in batches:
            x = b.column("grid").flatten().to_numpy().reshape(-1, dims)
            if len(x):
                low, high, seen = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)), True
        if seen:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dims, dtype=np.int32), "low": low, "high": high})
    return run


def _build(borders: Cells):
    def run(batches):
        dims = len(borders.inner)
        for b in batches:
            x = b.column("grid").flatten().to_numpy().reshape(-1, dims)
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(pack_cells(borders.encode(x), borders.bits), pa.binary()),
                 pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())],
                names=[*b.schema.names[:-1], "cells", "grid"])
    return run


def _moves(borders: Cells, before: np.ndarray | None, now: np.ndarray):
    """Per task, what a round's assignment changes in the sums of the one before."""
    def run(batches):
        k, dims = now.shape
        sums, count, moved = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        t_now = borders.tables(now)
        t_before = None if before is None else borders.tables(before)
        for part, cells in _chunks(batches, dims, borders.bits):
            grid = part.column("grid")
            new = nearest(cells, grid, borders, now, t_now)
            old = np.full(len(new), -1) if before is None else nearest(cells, grid, borders, before, t_before)
            rows = np.flatnonzero(new != old)
            if not len(rows):
                continue
            x = fetch(grid, rows)
            np.add.at(sums, new[rows], x)
            moved += np.bincount(new[rows], minlength=k)
            count += np.bincount(new[rows], minlength=k)
            if before is not None:
                np.subtract.at(sums, old[rows], x)
                count -= np.bincount(old[rows], minlength=k)
        yield pa.RecordBatch.from_pydict(
            {"cluster": np.arange(k, dtype=np.int32),
             "sums": pa.array(np.column_stack([sums, count, moved]).tolist(), pa.list_(pa.int64()))})
    return run


def _final(borders: Cells, centroids: np.ndarray):
    def run(batches):
        tables = borders.tables(centroids)
        for part, cells in _chunks(batches, centroids.shape[1], borders.bits):
            c = nearest(cells, part.column("grid"), borders, centroids, tables)
            gap = fetch(part.column("grid")) - centroids[c]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in range(part.num_columns - 2)], pa.array(c.astype(np.int32)),
                 pa.array((gap * gap).sum(axis=1))], names=[*part.schema.names[:-2], "cluster", "distance"])
    return run


class VaFile:
    """The vectors of ``df`` that take part, written once: the columns named in
    ``keep`` (as ``k0``, ``k1``, ...), ``cells`` and ``grid``."""

    def __init__(self, df: DataFrame, keep: list[str], vector_col: str = "embedding", dims: int = 64,
                 scale: float = 64.0, bits: int = 6, seed_key: Column | None = None):
        ship_package(df.sparkSession)
        if not 1 <= bits <= 8:
            raise ValueError("a cell takes 1 to 8 bits")
        self.dims, self.bits = dims, bits
        usable, grid = grid_vectors(df, vector_col, dims, scale)
        key = seed_key if seed_key is not None else F.sha2(F.concat(*[F.col(f"`{c}`").cast("string") for c in keep]), 256)
        rows = df.where(usable).select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], key.alias("key"),
                                       grid.alias("grid"))
        ends = {r["d"]: r for r in rows.select("grid").mapInArrow(_ends(dims), "d int, low long, high long").groupBy("d").agg(
            F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        self.kept = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
        self.empty = not ends
        if self.empty:
            return
        low, high = (np.array([ends[d][f] for d in range(dims)], np.int64) for f in ("low", "high"))
        if max(-low.min(), high.max()) > LARGEST:
            raise ValueError(f"a component is over {LARGEST} after scaling: distances would not fit a long")
        self.sample = [(r["key"], r["grid"]) for r in rows.select("key", "grid").orderBy(
            F.col("key").asc_nulls_last(), "grid").limit(SAMPLE_ROWS).collect()]
        self.borders = Cells(np.array([g for _, g in self.sample], np.int64), low, high, bits)
        self.step = Step(rows.drop("key").mapInArrow(_build(self.borders), f"{self.kept}, cells binary, grid binary"))

    def seeds(self, k: int) -> np.ndarray:
        """The ``k`` vectors (all, if fewer) with the smallest keys, in their order."""
        if k > SAMPLE_ROWS:
            raise ValueError(f"at most {SAMPLE_ROWS} centroids")
        return np.array([g for _, g in self.sample[:k]], np.int64)

    def move(self, before: np.ndarray | None, now: np.ndarray) -> dict[int, tuple[list[int], int, int]]:
        """Per cluster: change of the sums and of the count, and vectors fetched for it."""
        parts = self.step.df.select("cells", "grid").mapInArrow(
            _moves(self.borders, before, now), "cluster int, sums array<long>")
        out: dict[int, list[int]] = {c: [0] * (self.dims + 2) for c in range(len(now))}
        for r in parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect():
            out[r["cluster"]][r["pos"]] = r["s"]
        return {c: (v[:-2], v[-2], v[-1]) for c, v in out.items()}


def cluster(df: DataFrame, keep: list[str], k: int = 16, rounds: int = 3, vector_col: str = "embedding", dims: int = 64,
            scale: float = 64.0, bits: int = 6, seed_key: Column | None = None) -> DataFrame:
    """Lloyd's rounds over the grid of ``df``'s vectors.

    Vectors that are null, have not ``dims`` components or hold a null or
    non-finite one take no part.  The first centroids are the ``k`` vectors with
    the smallest ``seed_key`` (then smallest grid; null keys last); fewer vectors
    give fewer centroids.  Each round assigns every vector to its nearest centroid
    (ties: the smaller number) and moves every centroid that has vectors to their
    mean, rounded down; a last assignment follows.

    Returns the columns ``keep`` with ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``, one row for each row
    that takes part, repeated rows included; columns of ``keep`` with these names
    are replaced.  Components over 2^27 after scaling raise, sums over a long
    too.  An empty table gives an empty result.
    """
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kept = [c for c in keep if c not in results]
    va = VaFile(df, kept, vector_col, dims, scale, bits, seed_key)
    spark = df.sparkSession
    if va.empty:
        none = spark.createDataFrame([], f"{va.kept}, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
        return none.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *results)
    now, before = va.seeds(k), None
    sums, count = np.zeros_like(now), np.zeros(len(now), np.int64)
    for _ in range(rounds):
        for c, (change, n, _) in va.move(before, now).items():
            sums[c] += np.array(change, np.int64)
            count[c] += n
        full = count > 0
        nxt = now.copy()
        nxt[full] = sums[full] // count[full][:, None]
        before, now = now, nxt
    out = Step(va.step.df.mapInArrow(_final(va.borders, now), f"{va.kept}, cluster int, distance long"))
    va.step.drop()
    per = {r["cluster"]: r["d"] for r in out.df.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    named = spark.createDataFrame(
        [(c, d, sum(per.values()), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest())
         for c, d in per.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.df.join(F.broadcast(named), "cluster").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *results)
