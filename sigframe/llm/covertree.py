"""Operator 6: embedding near duplicates by cover trees and dual traversal.

On unit vectors, cosine >= t is distance <= r = sqrt(2 - 2t).  Vectors are dealt
to the centres of the tree's top levels and then to blocks of bounded size, each
with a cover tree of its own: nested levels, each centre's points covered by
centres at half the radius, the first of which is the centre itself.  Two nodes
whose centres are further apart than both covering radii and r hold no linked
pair; the traversal of two trees drops such pairs and compares what is left at
the leaves, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.ann import usable
from sigframe.llm.common import components, written

LEAF = 128
SLACK = 1e-9


def net(x: np.ndarray, radius: float, first: int = 0, most: int | None = None) -> tuple[list[int], np.ndarray] | None:
    """Greedy cover: centres (rows of ``x``, ``first`` the first of them) such
    that every row is within ``radius`` of the one it is given; each further
    centre is the row furthest from those so far.  None if over ``most``."""
    centres, owner = [first], np.zeros(len(x), dtype=np.int64)
    d = _to(x, x[first])
    while True:
        far = int(d.argmax())
        if d[far] <= radius:
            return centres, owner
        if most is not None and len(centres) >= most:
            return None
        e = _to(x, x[far])
        owner[e < d] = len(centres)
        d = np.minimum(d, e)
        centres.append(far)


def _to(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - y) ** 2).sum(axis=1), 0.0))


class CoverTree:
    """Nodes over unit vectors: centre, covering radius, and either children or
    a slice of ``order``."""

    def __init__(self, x: np.ndarray):
        self.x, order = x, []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.slices: list[tuple[int, int]] = []
        self._grow(np.arange(len(x)), 0, order)
        self.order = np.concatenate(order)
        self.leaf_x = np.ascontiguousarray(x[self.order])

    def _grow(self, rows: np.ndarray, first: int, order: list[np.ndarray]) -> int:
        """A node for ``rows`` centred on ``rows[first]``; its children cover it
        at half its radius.  Rows that no few centres cover stay together."""
        me, centre = len(self.centre), self.x[rows[first]]
        radius = float(_to(self.x[rows], centre).max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        begin = sum(map(len, order))
        self.slices.append((begin, begin + len(rows)))
        half = radius / 2
        cover = None
        while len(rows) > LEAF and radius > SLACK:
            cover = net(self.x[rows], half, first, most=max(2, len(rows) // (LEAF // 4)))
            if cover is not None or half >= 0.95 * radius:
                break
            half = (half + radius) / 2  # nothing this small covers it with few centres
        if cover is None or len(cover[0]) < 2:
            order.append(rows)
            return me
        for k, c in enumerate(cover[0]):
            own = rows[cover[1] == k]
            self.children[me].append(self._grow(own, int(np.flatnonzero(own == rows[c])[0]), order))
        return me


class Links:
    """Counts and a spanning forest of the pairs found between rows of two blocks."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tolist() != self.root.tolist():
                self.root = up


def traverse(s: CoverTree, t: CoverTree, shift: int, same: bool, threshold: float, links: Links) -> None:
    """Linked pairs of two trees (of one, if ``same``); rows of ``t`` are
    numbered from ``shift``."""
    r = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        ri, rj = s.radius[i], t.radius[j]
        if same and i == j:
            kids = s.children[i]
            if kids:
                todo += [(a, b) for k, a in enumerate(kids) for b in kids[k:]]
            else:
                _leaves(s, t, i, j, shift, True, threshold, links)
            continue
        gap = math.sqrt(float(((s.centre[i] - t.centre[j]) ** 2).sum()))
        if gap > ri + rj + r:
            continue
        if s.children[i] and (ri >= rj or not t.children[j]):
            todo += [(a, j) for a in s.children[i]]
        elif t.children[j]:
            todo += [(i, b) for b in t.children[j]]
        else:
            _leaves(s, t, i, j, shift, False, threshold, links)


def _leaves(s: CoverTree, t: CoverTree, i: int, j: int, shift: int, same: bool, threshold: float, links: Links) -> None:
    (a0, a1), (b0, b1) = s.slices[i], t.slices[j]
    for at in range(a0, a1, 512):
        x = s.leaf_x[at:min(a1, at + 512)]
        for bt in range(b0, b1, 512):
            y = t.leaf_x[bt:min(b1, bt + 512)]
            a, b = np.nonzero(x @ y.T >= threshold - SLACK)
            if same:
                a, b = a[up := a + at < b + bt], b[up]
            if not len(a):
                continue
            for k in range(0, len(a), 1 << 18):
                u, v = a[k:k + (1 << 18)], b[k:k + (1 << 18)]
                ok = (x[u] * y[v]).sum(axis=1) >= threshold  # each pair on its own, whatever the block
                links.add(s.order[u[ok] + at], shift + t.order[v[ok] + bt])


def _unit(x: bytes, dim: int) -> np.ndarray:
    v = np.frombuffer(x).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding", block_rows: int = 4096, centres: int = 128,
                    sample_rows: int = 4096) -> DataFrame:
    """Links (cosine >= ``threshold``) and their components for all vectors.

    Equal vectors are one class, counted once and never paired with each other.
    The centres of the top level are a cover of a bounded sample of the classes
    (``sample_rows``, at most ``centres`` of them); every class is dealt to its
    nearest one (those of a length without a centre are together), and a centre's
    classes to blocks of about ``block_rows`` by hash, so a hot centre is many
    blocks.  Pairs of blocks that the covering
    radii rule out are dropped; each other pair is one traversal that returns, a
    vector, its number of links, and a spanning forest in place of the links, so
    a dense group yields rows in proportion to its members.  Nothing is sampled
    or capped beyond the choice of centres, which does not change the result.

    Vectors that are null, zero or hold null, NaN or infinite components link
    with nothing: 0 links, a component of their own.  Vectors of different
    lengths do not link.  Repeated rows are vectors of their own that link with
    each other.  Null ids link and count, but give no component its name (a
    component of null ids only is null, and kept is null with a null id).  An
    empty table gives no rows; other columns are not read.

    Returns ``(<id_col>, n_links, component_id, kept)``, a row per input row.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", usable("v"))
    classes = written(rows.where("ok").groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("many"))
                      .withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    n = classes.count()
    tops = _tops(classes, n, sample_rows, centres)
    dealt = written(_deal(classes, tops))
    sizes = dealt.groupBy("dim", "top").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    blocked = dealt.join(sizes, ["dim", "top"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))

    def gather(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(g["v"].tolist(), dtype=np.float64)
        unit = _unit(x.tobytes(), key[0])
        centre = unit.mean(axis=0)
        return pd.DataFrame({"dim": [key[0]], "top": [key[1]], "centre": [centre.tolist()],
                             "radius": [float(_to(unit, centre).max())], "ids": [g["cid"].to_numpy(np.int64).tobytes()],
                             "many": [g["many"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    blocks = written(blocked.groupBy("dim", "top", "part").applyInPandas(
        gather, "dim int, top int, centre array<double>, radius double, ids binary, many binary, x binary")
        .withColumn("block", F.monotonically_increasing_id()))
    found = written(_pairs(blocks, tops, threshold).mapInPandas(
        lambda it: _traversals(it, threshold), "cid long, links long, other long"))
    links = found.where("links is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    comp = comp.withColumnRenamed("node", "cid")
    known = classes.join(links, "cid", "left").join(comp, "cid", "left").select(
        "v", "low", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"),
        F.coalesce("component", "cid").alias("component"))
    names = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(names, "component").select("v", "n_links", "component_id")
    linked = rows.where("ok").join(known, "v").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            (F.col("id") == F.col("component_id")).alias("kept"))


def _tops(classes: DataFrame, n: int, sample_rows: int, most: int) -> dict[int, np.ndarray]:
    """Centres by vector length: the deepest level, radii halving from 2, that
    covers the sample with at most ``most`` centres.  Lengths that the sample
    lacks have none."""
    share = min(1.0, 2 * sample_rows / max(1, n))
    lot = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30))
    picked = classes.where(lot < int(share * (1 << 30))).orderBy(lot)  # by lot, so that the limit favours no partition
    sample: dict[int, list] = {}
    for r in picked.select("dim", "v").limit(2 * sample_rows).collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for dim, vs in sample.items():
        unit = _unit(np.array(vs, dtype=np.float64).tobytes(), dim)
        best, radius = [0], 2.0
        while radius > 1e-3 and (cover := net(unit, radius, 0, most)) is not None:
            best, radius = cover[0], radius / 2
        out[dim] = unit[best]
    return out


def _deal(classes: DataFrame, tops: dict[int, np.ndarray]) -> DataFrame:
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            top = np.zeros(len(b), dtype=np.int32)
            for dim in b["dim"].unique():
                if dim in tops:
                    here = np.flatnonzero(b["dim"] == dim)
                    unit = _unit(np.array(b["v"].iloc[here].tolist(), dtype=np.float64).tobytes(), int(dim))
                    top[here] = (unit @ tops[dim].T).argmax(axis=1)
            yield b.assign(top=top)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInPandas(nearest, f"{kinds}, top int")


def _pairs(blocks: DataFrame, tops: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Pairs of blocks that may hold a link, each with both blocks' rows.

    Blocks meet over pairs of top centres (at most ``centres`` squared of them
    for a vector length) within reach of each other, a centre's reach being the
    furthest that its blocks' points may lie; then over their own radii."""
    spark = blocks.sparkSession
    r = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def gap(a: str, b: str):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    at = spark.createDataFrame([(dim, k, v.tolist()) for dim, vs in tops.items() for k, v in enumerate(vs)],
                               "dim int, top int, place array<double>")
    heads = blocks.select("dim", "top", "block", "centre", "radius").join(at, ["dim", "top"], "left")
    # a length that the sample lacks has one top, whose place may be any point
    heads = heads.withColumn("place", F.coalesce("place", F.array_repeat(F.lit(0.0), F.col("dim"))))
    reach = heads.groupBy("dim", "top", "place").agg(F.max(gap("centre", "place") + F.col("radius")).alias("reach"))

    def side(df: DataFrame, end: str, *shared: str) -> DataFrame:
        return df.select(*shared, *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in shared])

    tops_near = side(reach, "a", "dim").join(side(reach, "b", "dim"), "dim").where(
        gap("place_a", "place_b") <= F.col("reach_a") + F.col("reach_b") + r).select("dim", "top_a", "top_b")
    own = heads.drop("place")
    near = tops_near.join(side(own, "a", "dim"), ["dim", "top_a"]).join(side(own, "b", "dim"), ["dim", "top_b"]).where(
        (F.col("block_a") <= F.col("block_b"))
        & (gap("centre_a", "centre_b") <= F.col("radius_a") + F.col("radius_b") + r)).select("dim", "block_a", "block_b")
    rows = blocks.select("block", "ids", "many", "x")
    return near.join(side(rows, "a"), "block_a").join(side(rows, "b"), "block_b")


def _traversals(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    last, tree = None, None
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.block_b != last:
                last, tree = r.block_b, CoverTree(_unit(r.x_b, r.dim))
            same = r.block_a == r.block_b
            ids, many = np.frombuffer(r.ids_b, np.int64), np.frombuffer(r.many_b, np.int64)
            if same:
                links = Links(many)
                traverse(tree, tree, 0, True, threshold, links)
            else:
                shift = len(r.ids_a) // 8
                ids = np.concatenate([np.frombuffer(r.ids_a, np.int64), ids])
                links = Links(np.concatenate([np.frombuffer(r.many_a, np.int64), many]))
                traverse(CoverTree(_unit(r.x_a, r.dim)), tree, shift, False, threshold, links)
            has = np.flatnonzero(links.count)
            moved = np.flatnonzero(links.root != np.arange(len(ids)))
            yield pd.DataFrame({"cid": ids[has], "links": links.count[has], "other": pd.array([None] * len(has), "Int64")})
            yield pd.DataFrame({"cid": ids[moved], "links": pd.array([None] * len(moved), "Int64"),
                                "other": ids[links.root[moved]]})
