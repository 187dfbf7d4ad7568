"""Exact k nearest neighbours by blocks of rows (J-8, W-8).

Rows are packed into blocks, one row a block.  A block lies in a cell of a k-d
tree, whose borders come from a sample and decide nothing but the speed.  The
training rows of a query's own cell bound the distance of its k-th neighbour; a
block of queries then meets the blocks of training rows whose bounding boxes come
within that distance of one of them, all others are too far.  A pair of blocks is
matrix products of strips of queries and the parts of the block within their
bound, which return the k best of the block for each query, and the bests of a
query are ranked at the end.  So what is shuffled is at most blocks x blocks and k
rows a query and block, never a row a pair.  A few blocks of queries and a few of
training rows are one group, a tile; a task holds one tile at a time, whatever the
number of rows.  Where no block is too far (many dimensions), every block meets
every block.

A matrix product is only right to rounding.  It selects: all whose product
distance is within the error bound of the k-th are measured again, component by
component, and ranked by that distance and id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.session import cut_lineage, ship_package

BLOCK_ROWS = 8192
#: Queries measured at a time against a block.
STRIP = 128
#: Most blocks of a side in a tile, and tiles of a side up to which a tile is one block.
TILE_BLOCKS = 4
FEW_TILES = 16

#: Rows of a part of a block that is passed over as a whole.
PART = 256
#: Cells of the tree and numbers of the sample it is made of, at most; sampled rows a cell.
CELLS, SAMPLED, SAMPLE_ROWS = 1 << 10, 1 << 20, 64
#: What a lower bound loses to be under the true one whatever the rounding.
SAFE = 1 - 1e-9

PACKED = "block long, cell int, lo array<double>, hi array<double>, ids binary, ys binary, groups binary, x binary"


def kd_order(x: np.ndarray, rows: int) -> np.ndarray:
    """The rows in an order in which each few that follow each other lie together: halved at
    the median of the widest component down to ``rows``."""
    x, order, todo = np.nan_to_num(x), np.arange(len(x)), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > rows:
            mine = x[order[a:b]]
            column = mine[:, np.argmax(mine.max(axis=0) - mine.min(axis=0))] if x.shape[1] else np.zeros(b - a)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(column, half)]
            todo += [(a, a + half), (a + half, b)]
    return order


class Cells:
    """A complete k-d tree over a sample: node ``i`` has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth if sample.size else 0
        nodes = (1 << self.depth) - 1
        self.column, self.cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        rows = [np.nan_to_num(sample), *[None] * (2 * nodes)]
        for i in range(nodes):
            x = rows[i]
            if len(x):
                self.column[i] = np.argmax(x.max(axis=0) - x.min(axis=0))
                self.cut[i] = np.median(x[:, self.column[i]])
            over = x[:, self.column[i]] >= self.cut[i]
            rows[2 * i + 1], rows[2 * i + 2], rows[i] = x[~over], x[over], None

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.nan_to_num(x[np.arange(len(x)), self.column[node]]) >= self.cut[node])
        return node - ((1 << self.depth) - 1)


def _matrix(features: pd.Series) -> np.ndarray:
    return np.array(features.tolist(), np.float64).reshape(len(features), -1)


def _cells(rows: DataFrame, n: int, block_rows: int) -> Cells:
    """Cells of about ``block_rows`` of ``rows``."""
    depth = min(CELLS.bit_length() - 1, max(0, math.ceil(n / block_rows) - 1).bit_length())
    if not depth:
        return Cells(np.zeros((0, 0)), 0)
    wanted = min(SAMPLE_ROWS << depth, max(1, SAMPLED // max(1, rows.select(F.size("features")).first()[0] or 1)))
    drawn = rows.select("features") if wanted >= n else rows.select("features").sample(wanted / n, seed=0)
    return Cells(np.array([r[0] for r in drawn.collect()], np.float64), depth)


def _packed(rows: DataFrame, cells: Cells, block_rows: int) -> tuple[DataFrame, int]:
    """``rows(id, y, grp, features)`` as one row a block, and their number; blocks are numbered
    from 0, cell by cell."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f["features"])
        by = kd_order(x, STRIP)
        f, x = f.iloc[by], x[by]
        return pd.DataFrame({"block": f["block"].iloc[:1], "cell": f["cell"].iloc[:1], "lo": [np.fmin.reduce(x)], "hi": [np.fmax.reduce(x)],
                             "ids": [f["id"].to_numpy(np.int64).tobytes()], "ys": [f["y"].to_numpy(np.int64).tobytes()],
                             "groups": [f["grp"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    @F.pandas_udf("int")
    def cell(features: pd.Series) -> pd.Series:
        return pd.Series(cells.of(_matrix(features)), dtype="int32")

    celled = rows.withColumn("cell", cell("features") if cells.depth else F.lit(0))
    sizes = {r["cell"]: math.ceil(r["count"] / block_rows) for r in celled.groupBy("cell").count().collect()}
    first, blocks = 0, []
    for c in range(1 << cells.depth):  # a cell with many rows is dealt to several blocks
        blocks.append((c, first, n := sizes.get(c, 0)))
        first += n
    table = F.broadcast(rows.sparkSession.createDataFrame(blocks, "cell int, _first long, _n long"))  # bounded: CELLS rows
    keyed = celled.join(table, "cell").withColumn("block", F.col("_first") + F.pmod(F.xxhash64("id", "features"), F.col("_n")))
    return cut_lineage(keyed.groupBy("block").applyInPandas(pack, PACKED)), first


def box_gaps(lo: np.ndarray, hi: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """How far the boxes (or points) ``lo`` to ``hi`` are from ``lows`` to ``highs`` at least."""
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.maximum(np.maximum(lows - hi, lo - highs), 0.0)
        return np.sqrt((gap * gap).sum(axis=-1)) * SAFE


def block_best(qx, qg, x, ids, groups, k: int, bound=None):
    """For each query row the ``k`` nearest of ``x`` in another group, as (rows, cols, distances);
    those further than ``bound`` (one a query) may be left out."""
    out_r, out_c, out_d = [], [], []
    bound = np.full(len(qx), np.inf) if bound is None else bound
    size = (x * x).sum(axis=1)
    starts = np.arange(0, len(x), PART)
    lows, highs = np.fmin.reduceat(x, starts), np.fmax.reduceat(x, starts)
    largest = np.fmax.reduce(size, initial=0.0)

    for a in range(0, len(qx), STRIP):
        q, mine, most = qx[a:a + STRIP], qg[a:a + STRIP], bound[a:a + STRIP]
        own = (q * q).sum(axis=1)
        slack = 1e-12 * (x.shape[1] + 8) * (own + largest)

        def kth(at):
            """The k-th product distance, squared, to the rows ``at`` of another group."""
            rough = own[:, None] + size[None, at] - 2.0 * (q @ x[at].T)
            rough[groups[None, at] == mine[:, None]] = np.inf
            return np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(q), np.inf)

        at = slice(None)
        gaps = box_gaps(np.fmin.reduce(q), np.fmax.reduce(q), lows, highs)
        if np.isinf(most).any() and len(starts) > 1:
            near = np.argsort(gaps, kind="stable")[:2]
            near = kth(np.concatenate([np.arange(s, min(s + PART, len(x))) for s in starts[near]]))
            most = np.fmin(most, np.sqrt(np.maximum(near, 0.0) + 2 * slack))
        shut = gaps > np.fmax.reduce(most)
        if shut.all():
            continue
        if shut.any():
            at = np.concatenate([np.arange(s, min(s + PART, len(x))) for s in starts[~shut]])
        limit = most * most / SAFE
        if np.isinf(most).any():
            limit = np.fmin(limit, kth(at))
        # rough <= limit + 2 * slack, both sides less the query's square and halved
        half = q @ x[at].T
        np.subtract(0.5 * size[None, at], half, out=half)
        r, c = np.nonzero(half <= (0.5 * (limit - own) + 1.5 * slack)[:, None])
        if not isinstance(at, slice):
            c = at[c]
        other = groups[c] != mine[r]
        r, c = r[other], c[other]
        d = np.zeros(len(r))
        for j in range(x.shape[1]):  # in the order of the components, as a sequential sum
            gap = q[r, j] - x[c, j]
            d += gap * gap
        d = np.sqrt(d)
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.searchsorted(r, np.arange(len(q)))
        best = np.arange(len(r)) - first[r] < k
        out_r.append(r[best] + a)
        out_c.append(c[best])
        out_d.append(d[best])
    return tuple(np.concatenate(p) if p else np.zeros(0, int) for p in (out_r, out_c, out_d))


def _unpacked(block):
    ids, ys, groups = (np.frombuffer(v, np.int64) for v in (block.ids, block.ys, block.groups))
    return ids, ys, groups, np.frombuffer(block.x).reshape(len(ids), -1)


def _visits(asked: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``bound``, which no query's k-th neighbour exceeds, and ``visit``, the blocks
    of ``own`` that come within it."""
    boxes = own.select("block", "lo", "hi").orderBy("block").collect()
    numbers = np.array([b["block"] for b in boxes], np.int64)
    lows, highs = (np.array([b[c] for b in boxes], np.float64).reshape(len(boxes), -1) for c in ("lo", "hi"))

    def bounded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bounds, visits = [], []
        for p in left.itertuples():
            qi, _, qg, qx = _unpacked(p)
            bound = np.full(len(qi), np.inf)
            for o in right.itertuples():
                ids, _, groups, x = _unpacked(o)
                r, _, d = block_best(qx, qg, x, ids, groups, k)
                full = np.bincount(r, minlength=len(qi)) == k
                last = np.zeros(len(qi))
                np.maximum.at(last, r, d)
                bound = np.where(full, np.minimum(bound, last / SAFE), bound)
            far = [(box_gaps(qx, qx, lo, hi) > bound).all() for lo, hi in zip(lows, highs, strict=True)]
            bounds.append(bound.tobytes())
            visits.append(numbers[~np.array(far, bool)])
        return left.assign(bound=pd.Series(bounds, left.index, object), visit=pd.Series(visits, left.index, object))

    one = own.groupBy("cell").agg(F.min("block").alias("_one"))  # any block of the cell bounds
    at = asked.select(F.col("block").alias("_for"), "cell").join(one, "cell").select("_for", F.col("_one").alias("block"))
    beside = own.join(at, "block")
    return cut_lineage(asked.groupBy("block").cogroup(beside.groupBy("_for")).applyInPandas(
        bounded, f"{PACKED}, bound binary, visit array<long>"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, grp, rank, tid, ty, dist)``: for each of ``queries(id, grp, features)`` its ``k``
    nearest ``rows(id, y, grp, features)`` of another group (all, if fewer), nearest first, ties to
    the smaller id.  A null group differs from every other and equals null.  Ids are whole and distinct."""
    ship_package(queries.sparkSession)
    none = -(1 << 62)
    grp = F.coalesce(F.col("grp").cast("long"), F.lit(none))
    base = rows.select(F.col("id").cast("long").alias("id"), F.col("y").cast("long").alias("y"), grp.alias("grp"), "features")
    asked = queries.select(F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("y"), grp.alias("grp"), "features")
    cells = _cells(base, base.count(), block_rows)
    own, n_own = _packed(base, cells, block_rows)
    if queries is rows:
        q, n_asked = own.select(*[F.col(c).alias(c) for c in own.columns]), n_own
    else:
        q, n_asked = _packed(asked, cells, block_rows)
    if n_own > 1:
        q = _visits(q, own, k)
    else:
        q = q.withColumn("bound", F.lit(None).cast("binary")).withColumn("visit", F.array(F.lit(0).cast("long")))
    wide = [min(TILE_BLOCKS, max(1, n // FEW_TILES)) for n in (n_asked, n_own)]
    left = q.withColumn("q_tile", F.floor(F.col("block") / wide[0]).cast("int")).withColumn(
        "tile", F.explode(F.array_distinct(F.transform("visit", lambda b: F.floor(b / wide[1]).cast("int")))))
    wanted = left.select(F.col("q_tile").alias("_q_tile"), F.col("tile").alias("_tile")).distinct()
    right = own.withColumn("_tile", F.floor(F.col("block") / wide[1]).cast("int")).join(wanted, "_tile")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": np.zeros(0, np.int64), "grp": np.zeros(0, np.int64), "tid": np.zeros(0, np.int64),
                             "ty": np.zeros(0, np.int64), "dist": np.zeros(0)})]
        for p in left.itertuples():
            qi, _, qg, qx = _unpacked(p)
            bound = None if p.bound is None else np.frombuffer(p.bound)
            for o in right[right["block"].isin(p.visit)].itertuples():
                ids, ys, groups, x = _unpacked(o)
                r, c, d = block_best(qx, qg, x, ids, groups, k, bound)
                out.append(pd.DataFrame({"id": qi[r], "grp": qg[r], "tid": ids[c], "ty": ys[c], "dist": d}))
        return pd.concat(out[1:] or out)

    found = left.groupBy("q_tile", "tile").cogroup(right.groupBy("_q_tile", "_tile")).applyInPandas(
        search, "id long, grp long, tid long, ty long, dist double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "tid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn(
        "grp", F.when(F.col("grp") != none, F.col("grp")))


def vote(found: DataFrame) -> DataFrame:
    """``(id, yhat)``: the most frequent ``ty`` among each query's neighbours, ties to the smallest."""
    votes = found.groupBy("id", "ty").agg(F.count(F.lit(1)).alias("v"))
    best = F.max(F.struct("v", (-F.col("ty")).alias("low")))
    return votes.groupBy("id").agg(best.alias("b")).select("id", (-F.col("b.low")).alias("yhat"))
