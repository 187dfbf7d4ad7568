"""Operator 1: nearest neighbours by vantage-point trees, one per shard.

A node of a tree keeps a vantage point and, for each of its two halves, the
range [lo, hi] of distances to it.  For a query at distance d from the vantage
point, no point of a half is nearer than max(lo - d, d - hi).  The half is
skipped when that gap times ``factor`` exceeds the query's k-th best distance so
far: factor 1 is exact search, larger factors skip more and may miss.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import written
from sigframe.session import ship_package

LEAF = 64
#: Most shards and most blocks of queries in a tile.  Where there are few tiles, they are smaller.
TILE_SHARDS = 4
TILE_BLOCKS = 16
FEW_TILES = 64


def usable(vector: str) -> Column:
    """The vector is not null, not zero and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tree:
    """Vantage-point tree over the rows of ``x``.  ``order`` lists the rows so
    that every node is a slice; ``nodes`` has a row per node: begin, end, vantage
    row, inside child, outside child (children -1 at leaves); ``ranges`` lo and
    hi of the two halves."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x, rng = x, np.random.default_rng(seed)
        self.order = np.arange(len(x))
        nodes: list[list[int]] = []
        ranges: list[list[float]] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = me
            rows = self.order[begin:end]
            nodes.append([begin, end, -1, -1, -1])
            ranges.append([0.0, 0.0, 0.0, 0.0])
            if end - begin <= LEAF:
                continue
            vantage = int(rows[rng.integers(len(rows))])
            d = distances(x[vantage:vantage + 1], x[rows])[0]
            by = np.argsort(d, kind="stable")
            d, half = d[by], (end - begin) // 2
            if d[0] == d[-1]:  # all alike: nothing to split
                continue
            self.order[begin:end] = rows[by]
            nodes[me][2] = vantage
            ranges[me] = [d[0], d[half - 1], d[half], d[-1]]
            todo += [(begin, begin + half, me, 0), (begin + half, end, me, 1)]
        self.nodes, self.ranges = np.array(nodes), np.array(ranges)
        self.leaf_x = x[self.order]
        self.size = squares(self.leaf_x)


def squares(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * x).sum(axis=-1)


def lengths(gaps: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(gaps))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, every one from the differences themselves."""
    return lengths(q[:, None, :] - x[None, :, :])


class Search:
    """k nearest rows of one tree for a block of queries."""

    def __init__(self, tree: Tree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.q, self.q_ids, self.k, self.factor = tree, ids[tree.order], q, q_ids, k, factor
        self.size = squares(q)
        self.d = np.full((len(q), k), np.inf)
        self.i = np.full((len(q), k), np.iinfo(np.int64).max)
        self.home = np.zeros(len(q), np.int64)
        self.descend()
        self.visit()

    def gaps(self, node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the queries ``who`` the distance to the vantage point, and how far each half is at least."""
        vantage = self.tree.nodes[node][2]
        d = distances(self.q[who], self.tree.x[vantage:vantage + 1])[:, 0]
        lo0, hi0, lo1, hi1 = self.tree.ranges[node].tolist()
        with np.errstate(invalid="ignore"):
            return d, np.maximum(lo0 - d, d - hi0), np.maximum(lo1 - d, d - hi1)

    def descend(self) -> None:
        """Every query to the leaf in its nearer halves, for a first k-th distance."""
        todo = [(0, np.arange(len(self.q)))]
        while todo:
            node, who = todo.pop()
            if not len(who):
                continue
            begin, end, vantage, inside, outside = self.tree.nodes[node].tolist()
            if vantage < 0:
                self.home[who] = node
                self.scan(begin, end, who)
                continue
            _, near, far = self.gaps(node, who)
            todo += [(inside, who[near <= far]), (outside, who[near > far])]

    def visit(self) -> None:
        """All other leaves that may hold nearer points, with all their queries at once."""
        everyone = np.arange(len(self.q))
        todo = [(0, everyone, np.full(len(everyone), -np.inf))]
        while todo:
            node, who, gap = todo.pop()
            who = who[~(gap > self.d[who, -1])]  # a gap beyond the range of doubles leaves the half open
            begin, end, vantage, inside, outside = self.tree.nodes[node].tolist()
            if vantage < 0:
                self.scan(begin, end, who[self.home[who] != node])
            elif len(who):
                d, *both = self.gaps(node, who)
                with np.errstate(invalid="ignore"):
                    bounds = [g * self.factor - 1e-9 * (1 + d) for g in both]
                todo += [(outside, who, bounds[1]), (inside, who, bounds[0])]

    def scan(self, begin: int, end: int, who: np.ndarray) -> None:
        """Product distances, right to rounding, choose who is measured: all but those that
        are over the k-th distance by more than their error."""
        for at in range(begin, end if len(who) else begin, 4 * LEAF):
            stop = min(end, at + 4 * LEAF)
            ids, x, size = self.ids[at:stop], self.tree.leaf_x[at:stop], self.tree.size[at:stop]
            with np.errstate(over="ignore", invalid="ignore"):  # beyond the range of doubles: measured
                own = self.size[who]
                rough = own[:, None] + size[None, :] - 2.0 * (self.q[who] @ x.T)
                same = ids[None, :] == self.q_ids[who][:, None]
                rough[same] = np.inf
                slack = 1e-12 * (x.shape[1] + 8) * (own + size.max()) + 1e-300
                most = self.d[who, -1] ** 2
                if len(ids) > self.k and np.isinf(most).any():
                    most = np.minimum(most, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack)
                r, c = np.nonzero(~(rough > (most + slack)[:, None]) & ~same)
            if not len(r):
                continue
            d = lengths(self.q[who[r]] - x[c])
            better = d <= self.d[who[r], -1]
            if not better.any():
                continue
            rows, r = np.unique(who[r[better]], return_inverse=True)
            r = np.concatenate([np.repeat(np.arange(len(rows)), self.k), r])
            d = np.concatenate([self.d[rows].ravel(), d[better]])
            i = np.concatenate([self.i[rows].ravel(), ids[c[better]]])
            by = np.lexsort((i, d, r))
            best = by[np.searchsorted(r[by], np.arange(len(rows)))[:, None] + np.arange(self.k)]
            self.d[rows], self.i[rows] = d[best], i[best]


def search(points: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id",
           vector_col: str = "embedding", shard_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """The ``k`` nearest points of every query, by Euclidean distance in double
    precision, ties to the smaller id, never the query's own id.

    Points are dealt by hash into shards of about ``shard_rows`` (a cluster of
    points, or a vector that a third of them share, so never meets in one task),
    a tree is built per shard, and blocks of ``query_rows`` queries go to every
    shard; each pair of block and shard returns k rows a query, and the best k of
    all are kept (Spark cuts them down before the shuffle too).  A few blocks and a
    few shards are one group, a tile: tasks hold one tile at a time, whatever the
    number of rows.

    Null or zero vectors and vectors with null, NaN or infinite components take
    no part, on either side, nor do null ids; vectors only meet others of their
    own length.  Repeated rows are candidates of their own.  Query rows repeated
    with the same vector are one query; an id with several vectors is several
    queries, told apart by ``query_key``, a hash of id and vector.  Queries with fewer
    than k candidates have fewer rows, with none no row; empty tables give none.
    Other columns are not read.

    Returns ``(query_id, rank, <id_col>, score, query_key)``.
    """
    ship_package(points.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(
            usable("v") & F.col("id").isNotNull()).withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("id", "v"))

    p, q = clean(points), clean(queries).dropDuplicates(["id", "v"])
    shards = max(1, math.ceil(p.count() / shard_rows))
    blocks = max(1, math.ceil(q.count() / query_rows))

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["v"].tolist(), dtype=np.float64)
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "ids": [rows["id"].to_numpy(np.int64).tobytes()],
                             "keys": [rows["key"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    def packed(df: DataFrame, n: int) -> DataFrame:
        return df.groupBy("dim", F.pmod("key", F.lit(n)).alias("part")).applyInPandas(
            gather, "dim int, part long, ids binary, keys binary, x binary")

    per_tile = min(TILE_SHARDS, max(1, shards * blocks // FEW_TILES))
    wide = [min(TILE_BLOCKS, max(1, blocks * math.ceil(shards / per_tile) // FEW_TILES)), per_tile]
    tiles = [math.ceil(n / w) for n, w in zip((blocks, shards), wide, strict=True)]

    def dealt(df: DataFrame, mine: int) -> DataFrame:
        """A copy of each row for every tile that it is part of."""
        at = F.floor(F.col("part") / wide[mine]).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(tiles[1 - mine] - 1)))
        return df.select("*", *[(at if i == mine else each).alias(c) for i, c in enumerate(("q_tile", "tile"))]).groupBy(
            "dim", "q_tile", "tile")

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "id": np.zeros(0, np.int64),
                             "score": np.zeros(0)})]
        for p in held.itertuples(index=False) if len(asked) else ():
            ids, tree = np.frombuffer(p.ids, np.int64), Tree(np.frombuffer(p.x).reshape(-1, p.dim), int(p.part))
            for r in asked.itertuples(index=False):
                q_ids = np.frombuffer(r.ids, np.int64)
                s = Search(tree, ids, np.frombuffer(r.x).reshape(-1, r.dim), q_ids, k, factor)
                found = np.isfinite(s.d)
                n = found.sum(axis=1)
                out.append(pd.DataFrame({"query_id": np.repeat(q_ids, n), "key": np.repeat(np.frombuffer(r.keys, np.int64), n),
                                         "id": s.i[found], "score": s.d[found]}))
        return pd.concat(out[1:] or out)

    held = written(packed(p, shards))
    found = dealt(packed(q, blocks), 0).cogroup(dealt(held, 1)).applyInPandas(
        nearest, "query_id long, key long, id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score", F.col("key").alias("query_key"))
