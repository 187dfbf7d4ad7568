"""Random forest as a Spark ML estimator (M-6, M-12, S-12) whose work follows the rows in its nodes.

The trees are those of Spark ML's classifier: Poisson(1) weights a row and tree, a random
subset of features a node, the split with the largest drop of the Gini impurity over
``maxBins`` bins, until a node is pure, none of its features gains, or ``maxDepth`` is reached;
siblings that end with the same class become one leaf.  Spark ML makes a full histogram for
every node of a level, in groups of 256 MB that follow each other; deep trees have most nodes
with a few rows each, and a group reads all rows again.  Here a node of more than
``taskRows`` rows is split by sums over all blocks of rows (a pass a level, all trees in it), and the
rows of a smaller one are dealt to a task that grows the rest of its branch.

The draws are hashes of seed, tree and row (or node), so they depend neither on partitions nor
on the order of rows; rows that agree in id, label and features are drawn together.  The model is
a table of branches, and the small trees above them.  Applying it deals the rows to the branches
they reach, and the votes, whole numbers, back to their blocks.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed,
                                     Param, Params, TypeConverters)
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.operators import boosting
from sigframe.session import cut_lineage, ship_package

#: Rows of a node from which on it is split by sums over all blocks.
TASK_ROWS = 4096
#: Rows a block has at least, and at most if there are more blocks than cores; rows dealt to a task.
FEW_ROWS, MANY_ROWS, DEALT_ROWS = 256, 65536, 65536
#: Cells of the histogram that a task holds at a time while it grows a branch.
MOST_CELLS = 1 << 21
#: Relative difference under which two splits are equal, and a whole vote.
TIE, VOTE = 1e-12, 1 << 40
#: Spark ML's bound of classes.
MOST_CLASSES = 100

POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64 on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Settings:
    depth: int
    bins: int
    classes: int
    dims: int
    subset: int
    seed: int

    def salt(self, tree: int, purpose: int) -> np.uint64:
        return mixed(mixed(np.array([self.seed & (2 ** 64 - 1)], np.uint64) + np.uint64(2 * tree + purpose + 1)))[0]

    def weights(self, keys: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is drawn for a tree: Poisson(1)."""
        u = (mixed(keys + self.salt(tree, 0)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        return np.searchsorted(POISSON, u, side="right")

    def features(self, tree: int, paths: np.ndarray) -> np.ndarray:
        """(nodes, subset): the features that each node may split on, ascending."""
        if self.subset == self.dims:
            return np.tile(np.arange(self.dims), (len(paths), 1))
        h = mixed(mixed(paths.astype(np.uint64) + self.salt(tree, 1))[:, None] + np.arange(1, self.dims + 1, dtype=np.uint64)[None, :])
        return np.sort(np.argpartition(h, self.subset - 1, axis=1)[:, :self.subset], axis=1)


def counted(bins: np.ndarray, ys: np.ndarray, ws: np.ndarray, slot: np.ndarray, feats: np.ndarray, s: Settings) -> np.ndarray:
    """(nodes, subset, bins, classes): weights of the rows by node and bin of each of its features."""
    nodes, m = feats.shape
    own = bins[np.arange(len(slot))[:, None], feats[slot]].astype(np.int64)
    cell = ((slot[:, None] * m + np.arange(m)) * s.bins + own) * s.classes + ys[:, None]
    return np.bincount(cell.ravel(), np.repeat(ws, m), nodes * m * s.bins * s.classes).reshape(nodes, m, s.bins, s.classes)


def best_splits(sums: np.ndarray, total: np.ndarray):
    """By node: whether a split lowers the impurity, its place in the node's features, its bin, the class weights on its left.
    Of equal splits the first counts."""
    left = sums.cumsum(axis=2)
    nl, n = left.sum(axis=3), total.sum(axis=1)[:, None, None]
    nr, ql = n - nl, np.einsum("nmbk,nmbk->nmb", left, left)
    qt = (total ** 2).sum(axis=1)[:, None, None]
    qr = qt - 2 * np.einsum("nmbk,nk->nmb", left, total) + ql
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((nl > 0) & (nr > 0), ql / nl + qr / nr, -1.0).reshape(len(sums), -1)
    top = score.max(axis=1)
    at = (score >= (top * (1 - TIE))[:, None]).argmax(axis=1)
    j, b = at // sums.shape[2], at % sums.shape[2]
    return top > (qt / n)[:, 0, 0] * (1 + TIE), j, b, left[np.arange(len(sums)), j, b]


@dataclass
class Branch:
    """Nodes of a branch, its top first: a row goes from an inner node to ``ref`` where its bin of ``feature`` is at
    most ``cut``, else to ``ref`` + 1.  Feature -1 is a leaf, ``ref`` its class or, from ``classes`` on, a row of ``shares``."""

    feature: np.ndarray
    cut: np.ndarray
    ref: np.ndarray
    shares: np.ndarray

    def packed(self) -> tuple:
        return (bytearray(self.feature.astype(np.int32).tobytes()), bytearray(self.cut.astype(np.uint8).tobytes()),
                bytearray(self.ref.astype(np.int32).tobytes()), bytearray(self.shares.astype(np.int64).tobytes()))

    @classmethod
    def opened(cls, feature, cut, ref, shares, classes: int) -> Branch:
        return cls(np.frombuffer(feature, np.int32), np.frombuffer(cut, np.uint8), np.frombuffer(ref, np.int32),
                   np.frombuffer(shares, np.int64).reshape(-1, classes))


def reached(feature: np.ndarray, cut: np.ndarray, ref: np.ndarray, bins: np.ndarray, start: int = 0) -> np.ndarray:
    """The node where each row ends that begins at ``start``."""
    at = np.full(len(bins), start, np.int64)
    on = np.arange(len(bins))
    while len(on):
        f = feature[at[on]]
        on, f = on[f >= 0], f[f >= 0]
        at[on] = ref[at[on]] + (bins[on, f] > cut[at[on]])
    return at


def shares(counts: np.ndarray) -> np.ndarray:
    """Class weights as shares of a whole vote."""
    return np.rint(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * VOTE).astype(np.int64)


def pure(counts: np.ndarray) -> np.ndarray:
    return (counts > 0).sum(axis=1) <= 1


def grow(bins: np.ndarray, ys: np.ndarray, ws: np.ndarray, tree: int, path: int, depth: int, s: Settings) -> Branch:
    """The branch of the node ``path`` (heap order) at ``depth`` over its rows, level by level."""
    counts = [np.bincount(ys, ws, s.classes)[None, :]]
    feature, cut, ref = [np.array([-1])], [np.array([0])], [np.array([0])]
    size, levels = 1, []
    ids, paths = np.array([0]), np.array([path], np.int64)
    if pure(counts[0])[0] or depth >= s.depth:
        ids, paths = ids[:0], paths[:0]
    at = np.zeros(len(ys), np.int64)  # a row's place in ids
    while len(ids):
        total = counts[-1][ids - (size - len(counts[-1]))]
        feats = s.features(tree, paths)
        step = max(1, MOST_CELLS // (s.subset * s.bins * s.classes))
        found = []
        for a in range(0, len(ids), step):
            rows = np.flatnonzero((at >= a) & (at < a + step)) if len(ids) > step else slice(None)
            f = feats[a:a + step]
            found.append(best_splits(counted(bins[rows], ys[rows], ws[rows], at[rows] - a, f, s), total[a:a + step]))
        split, j, b, left = (np.concatenate(p) for p in zip(*found, strict=True))
        chosen = feats[np.arange(len(ids)), j]
        own = ids[split] - (size - len(counts[-1]))
        feature[-1][own], cut[-1][own] = chosen[split], b[split]
        ref[-1][own] = size + 2 * np.arange(len(own))
        if not len(own):
            break
        levels.append(ids[split])
        below = np.stack([left[split], total[split] - left[split]], axis=1).reshape(-1, s.classes)
        below_paths = (2 * paths[split][:, None] + np.array([1, 2])).ravel()
        counts.append(below)
        for part, value in ((feature, -1), (cut, 0), (ref, 0)):
            part.append(np.full(len(below), value))
        # rows move to the children; those of nodes that end are left behind
        first = np.where(split, 2 * (np.cumsum(split) - 1), -1)[at]
        to = first + (bins[np.arange(len(at)), chosen[at]] > b[at])
        depth += 1
        more = ~pure(below) & (depth < s.depth)
        place = np.where(more, np.cumsum(more) - 1, -1)
        at = np.where(first >= 0, place[to], -1)
        stay = at >= 0
        at, bins, ys, ws = at[stay], bins[stay], ys[stay], ws[stay]
        ids, paths = size + np.flatnonzero(more), below_paths[more]
        size += len(below)
    return _finished(*(np.concatenate(p) for p in (feature, cut, ref, counts)), levels, s.classes)


def _finished(feature, cut, ref, counts, levels: list[np.ndarray], classes: int) -> Branch:
    """The branch without siblings that end with the same class, its leaves with their class or shares."""
    best = counts.argmax(axis=1)
    for ids in reversed(levels):
        lower = ref[ids]
        one = (feature[lower] < 0) & (feature[lower + 1] < 0) & (best[lower] == best[lower + 1])
        feature[ids[one]] = -1
    keep = np.zeros(len(feature), bool)
    keep[0] = True
    for ids in levels:
        inner = ids[keep[ids] & (feature[ids] >= 0)]
        keep[ref[inner]] = keep[ref[inner] + 1] = True
    place = np.cumsum(keep) - 1
    ref = np.where(feature >= 0, place[ref], best)
    several = (feature < 0) & ~pure(counts) & keep
    ref[several] = classes + np.arange(several.sum())
    return Branch(feature[keep], cut[keep], ref[keep], shares(counts[several]))


@dataclass
class Top:
    """The nodes of all trees above the branches, as in ``Branch``; the first nodes are the roots.  Where a row
    ends, ``branch`` is the number of the branch below, or -1 at a leaf, whose class weights are in ``counts``."""

    feature: np.ndarray
    cut: np.ndarray
    ref: np.ndarray
    branch: np.ndarray
    tree: np.ndarray
    path: np.ndarray
    depth: np.ndarray
    counts: np.ndarray

    @classmethod
    def roots(cls, trees: int, counts: np.ndarray) -> Top:
        zero = np.zeros(trees, np.int64)
        return cls(zero - 1, zero.copy(), zero.copy(), zero - 1, np.arange(trees), zero.copy(), zero.copy(), np.tile(counts, (trees, 1)))

    def add(self, parent: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Splits ``parent`` nodes; gives the children's numbers."""
        size, two = len(self.feature), np.repeat(parent, 2)
        self.feature[parent], self.cut[parent], self.ref[parent] = feature, cut, size + 2 * np.arange(len(parent))
        below = np.stack([left, self.counts[parent] - left], axis=1).reshape(len(two), -1)
        none = np.full(len(two), -1)
        for name, more in (("feature", none), ("cut", none * 0), ("ref", none * 0), ("branch", none), ("tree", self.tree[two]),
                           ("path", 2 * self.path[two] + np.tile([1, 2], len(parent))), ("depth", self.depth[two] + 1),
                           ("counts", below)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        return size + np.arange(len(two))

    def ends(self, bins: np.ndarray, tree: int) -> np.ndarray:
        return reached(self.feature, self.cut, self.ref, bins, tree)

    def merge(self, single: list[int]) -> None:
        """Makes siblings that end with the same class one leaf; ``single`` are the branches that are a leaf."""
        alone = np.zeros(int(self.branch.max(initial=-1)) + 2, bool)  # the last for nodes without a branch
        alone[[*single, -1]] = True
        end, best = (self.feature < 0) & alone[self.branch], self.counts.argmax(axis=1)
        for depth in range(int(self.depth.max()), -1, -1):
            ids = np.flatnonzero((self.depth == depth) & (self.feature >= 0))
            lower = self.ref[ids]
            one = ids[end[lower] & end[lower + 1] & (best[lower] == best[lower + 1])]
            self.feature[one], end[one] = -1, True

    def to_dict(self) -> dict:
        return {k: v.tolist() for k, v in vars(self).items()}

    @classmethod
    def from_dict(cls, d: dict) -> Top:
        return cls(**{k: np.array(v) for k, v in d.items()})


def borders(rows: DataFrame, dims: int, bins: int) -> list[np.ndarray]:
    """Cuts by feature: between all values of a feature with at most ``bins`` of them, else at approximate quantiles."""
    values = rows.select(F.posexplode("features").alias("j", "x")).distinct()
    few = values.groupBy("j").count().where(F.col("count") <= bins).select("j")
    found = values.join(F.broadcast(few), "j").groupBy("j").agg(F.sort_array(F.collect_list("x")).alias("v")).collect()
    out = boosting.borders(rows, dims, bins) if len(found) < dims else [np.zeros(0)] * dims
    for r in found:
        v = np.array(r["v"])
        out[r["j"]] = v[:-1] + (v[1:] - v[:-1]) / 2
    return out


def binned(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """A value's bin is the number of cuts below it; NaN is above all."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def _sliced(f, rows: np.ndarray) -> np.ndarray:
    return np.concatenate([f(rows[a:a + 4096]) for a in range(0, max(1, len(rows)), 4096)])


def squeezed(bins: np.ndarray, most: int) -> np.ndarray:
    """Rows of bins below ``most`` in as few bits as they need: each row is sent once a tree."""
    bits = (most - 1).bit_length()
    return _sliced(lambda r: np.packbits(np.unpackbits(r[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(r), -1), axis=1), bins)


def spread(packed: np.ndarray, dims: int, most: int) -> np.ndarray:
    """The bins again."""
    bits = (most - 1).bit_length()

    def wide(r):
        out = np.zeros((len(r), dims, 8), np.uint8)
        out[:, :, 8 - bits:] = np.unpackbits(r, axis=1, count=dims * bits).reshape(len(r), dims, bits)
        return np.packbits(out, axis=2)[:, :, 0]

    return _sliced(wide, packed)


def _blocks(data: DataFrame, cuts: list[np.ndarray], rows: int) -> RDD:
    """``data(key, y, features)`` as (block, (keys, classes, bins)), a block a partition; block numbers and rows are kept in files."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-rows // FEW_ROWS)), -(-rows // MANY_ROWS))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(f["key"].to_numpy(np.int64), f["y"].to_numpy(np.int32), binned(cuts, np.array(f["features"].tolist(), np.float64)))
                 for f in frames if len(f)]
        if parts:
            keys, ys, bins = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "keys": [keys.tobytes()], "ys": [ys.tobytes()],
                                "bins": [bins.tobytes()]})

    def opened(p):
        return p.block, (np.frombuffer(p.keys, np.int64), np.frombuffer(p.ys, np.int32),
                         np.frombuffer(p.bins, np.uint8).reshape(-1, len(cuts)))

    packed = data.repartition(tasks).mapInPandas(pack, "block int, keys binary, ys binary, bins binary")
    return cut_lineage(packed).rdd.map(opened)


def _same(key: int) -> int:
    return key


def _split(blocks: RDD, top: Top, nodes: np.ndarray, s: Settings, tasks: int) -> list:
    """For the open ``nodes``: (node, feature, bin, class weights left) of those that split."""
    slot = np.full(len(top.feature), -1)
    own = {int(t): nodes[top.tree[nodes] == t] for t in np.unique(top.tree[nodes])}
    for n in own.values():
        slot[n] = np.arange(len(n))

    def sums(block):
        keys, ys, bins = block[1]
        for t, n in own.items():
            ws, at = s.weights(keys.view(np.uint64), t), slot[top.ends(bins, t)]
            on = np.flatnonzero((at >= 0) & (ws > 0))
            yield t, counted(bins[on], ys[on], ws[on], at[on], s.features(t, top.path[n]), s).astype(np.int32)

    def choose(parts):
        total: dict = {}
        for t, v in parts:
            total[t] = total[t] + v if t in total else v.astype(np.int64)
        for t, v in total.items():
            n = own[t]
            split, j, b, left = best_splits(v.astype(np.float64), top.counts[n] if top.depth[n[0]] else v[:, 0].sum(axis=1).astype(float))
            feats = s.features(t, top.path[n])[np.arange(len(n)), j]
            yield from ((int(n[i]), int(feats[i]) if split[i] else -1, int(b[i]), left[i], v[i, 0].sum(axis=0)) for i in range(len(n)))

    return blocks.flatMap(sums).partitionBy(min(len(own), tasks), _same).mapPartitions(choose).collect()


class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root, at most 30", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 2 to 256", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "auto, all, sqrt, log2, onethird, a number or a share",
                                  TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "a column that tells equal rows apart in the draws, if it is there", TypeConverters.toString)
    taskRows = Param(Params._dummy(), "taskRows", "rows of a node that one task may grow to its leaves", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                         rawPredictionCol="rawPrediction", seed=42, numTrees=20, maxDepth=5, maxBins=32, featureSubsetStrategy="auto",
                         idCol="id", taskRows=TASK_ROWS)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def _vector(self, dataset: DataFrame) -> Column:
        name = self.getOrDefault("featuresCol")
        col = dataset[name]
        return vector_to_array(col) if isinstance(dataset.schema[name].dataType, VectorUDT) else col.cast("array<double>")

    def _subset(self, dims: int) -> int:
        """Features a node may split on, as Spark ML counts them."""
        how, trees = self.getOrDefault("featureSubsetStrategy").lower(), self.getOrDefault("numTrees")
        if how == "auto":
            how = "all" if trees == 1 else "sqrt"
        named = {"all": dims, "sqrt": math.ceil(math.sqrt(dims)), "log2": max(1, math.ceil(math.log2(dims))), "onethird": math.ceil(dims / 3)}
        if how in named:
            return named[how]
        n = int(how) if how.isdigit() else math.ceil(float(how) * dims)
        if n < 1:
            raise ValueError(f"no features by the strategy {how}")
        return min(n, dims)


class Forest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on all rows.  As in Spark ML, labels are whole numbers from 0 on, below 100, and features finite; others raise."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                 rawPredictionCol="rawPrediction", seed=42, numTrees=20, maxDepth=5, maxBins=32, featureSubsetStrategy="auto",
                 idCol="id", taskRows=TASK_ROWS):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        trees, depth, bins = (self.getOrDefault(p) for p in ("numTrees", "maxDepth", "maxBins"))
        if not (trees >= 1 and 0 <= depth <= 30 and 2 <= bins <= 256):
            raise ValueError("numTrees is at least 1, maxDepth 0 to 30 and maxBins 2 to 256")
        ship_package(dataset.sparkSession)
        label, vector, own = F.col(self.getOrDefault("labelCol")).cast("double"), self._vector(dataset), self.getOrDefault("idCol")
        named = [dataset[own]] if own in dataset.columns else []
        data = cut_lineage(dataset.select(F.xxhash64(*named, label, vector).alias("key"), label.alias("label"), vector.alias("features")))
        wrong = F.col("label").isNull() | F.isnan("label") | (F.col("label") < 0) | (F.col("label") != F.floor("label")) | F.exists(
            "features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        seen = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(wrong | F.col("features").isNull(), F.lit(True))).alias("bad"),
                        F.max("label").alias("top"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).first()
        if not seen["n"]:
            raise ValueError("no rows to fit on")
        if seen["bad"] or seen["least"] != seen["most"] or not seen["most"]:
            raise ValueError(f"{seen['bad']} rows have a label that is no whole number from 0 on, or features that are not finite; "
                             f"features have {seen['least']} to {seen['most']} components")
        if seen["top"] >= MOST_CLASSES:
            raise ValueError(f"labels are below {MOST_CLASSES}")
        dims = seen["most"]
        s = Settings(depth, bins, int(seen["top"]) + 1, dims, self._subset(dims), self.getOrDefault("seed"))
        cuts = borders(data, dims, bins)
        rows = data.select("key", F.col("label").cast("int").alias("y"), "features")
        blocks = _blocks(rows, cuts, seen["n"]).persist(StorageLevel.MEMORY_AND_DISK)
        top = self._top(blocks, seen["n"], s)
        branches = _branches(blocks, top, s, seen["n"])
        blocks.unpersist()
        top.merge([r["branch"] for r in branches.where(F.octet_length("feature") == 4).select("branch").collect()])
        return self._copyValues(ForestModel(branches, top, cuts, s))

    def _top(self, blocks: RDD, rows: int, s: Settings) -> Top:
        """Grows the nodes with more than ``taskRows`` rows, all trees in one pass a level."""
        trees, most = self.getOrDefault("numTrees"), self.getOrDefault("taskRows")
        top = Top.roots(trees, np.zeros(s.classes))
        tasks = 4 * blocks.getNumPartitions()
        nodes = np.arange(trees)
        small = nodes if rows <= most else nodes[:0]
        nodes = nodes[len(small):]
        while len(nodes):
            got = sorted(_split(blocks, top, nodes, s, tasks), key=lambda g: g[0])
            if not top.depth[nodes[0]]:
                top.counts = np.zeros((trees, s.classes))
                for g in got:
                    top.counts[g[0]] = g[4]
            got = [g for g in got if g[1] >= 0 and s.depth]
            if not got:
                break
            below = top.add(*(np.array([g[i] for g in got]) for i in range(4)))
            live = below[~pure(top.counts[below]) & (top.depth[below] < s.depth)]
            large = top.counts[live].sum(axis=1) > most
            nodes, small = live[large], np.concatenate([small, live[~large]])
        top.branch[small] = np.arange(len(small))
        return top


def _dealt(rows: float, branches: float, cores: int) -> int:
    """Tasks that rows of ``branches`` are dealt to."""
    return max(1, min(branches, max(cores, math.ceil(rows / DEALT_ROWS))))


def _runs(branch: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each branch."""
    order = rows[np.argsort(branch[rows], kind="stable")]
    edges = np.flatnonzero(np.diff(branch[order])) + 1
    return ((int(branch[r[0]]), r) for r in np.split(order, edges) if len(r))


def _branches(blocks: RDD, top: Top, s: Settings, rows: int) -> DataFrame:
    """``(branch, feature, cut, ref, shares)``: each branch grown in the task that its rows are dealt to."""
    heads = np.flatnonzero(top.branch >= 0)
    trees = np.unique(top.tree[heads])
    spark = blocks.ctx
    tasks = _dealt(float(rows) * len(trees), len(heads), spark.defaultParallelism)

    def deal(block):
        keys, ys, bins = block[1]
        sent = squeezed(bins, s.bins)
        for t in trees:
            ws, branch = s.weights(keys.view(np.uint64), int(t)), top.branch[top.ends(bins, int(t))]
            for b, r in _runs(branch, np.flatnonzero((branch >= 0) & (ws > 0))):
                yield b, (sent[r], ys[r].astype(np.int8), ws[r].astype(np.int8))

    def all_grown(parts):
        held = defaultdict(list)
        for b, part in parts:
            held[b].append(part)
        while held:
            b, own = held.popitem()
            sent, ys, ws = (np.concatenate(p) for p in zip(*own, strict=True))
            n, bins = heads[b], spread(sent, s.dims, s.bins)
            yield b, *grow(bins, ys.astype(np.int64), ws.astype(np.float64), int(top.tree[n]), int(top.path[n]), int(top.depth[n]), s).packed()

    grown = blocks.flatMap(deal).partitionBy(tasks, _same).mapPartitions(all_grown)
    return cut_lineage(grown.toDF("branch long, feature binary, cut binary, ref binary, shares binary"))


class ForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """``branches``, the trees' tops, the cuts of the bins and the settings of the fit.  ``transform`` adds the sums of the
    trees' class shares, these as probabilities, and the likeliest class (of equal ones the smallest)."""

    def __init__(self, branches: DataFrame | None = None, top: Top | None = None, cuts: list[np.ndarray] | None = None,
                 settings: Settings | None = None):
        super().__init__()
        self._defaults()
        self.branches, self.top, self.cuts, self.settings = branches, top, cuts, settings

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        names, own = dataset.columns, "_forest_row"
        while own in names:
            own += "_"
        # numbered once: the rows go to the branches and their votes come back to their numbers
        data = cut_lineage(dataset.withColumn(own, F.monotonically_increasing_id()))
        vector = self._vector(data)
        whole = (F.size(vector) == len(self.cuts)) & ~F.exists(vector, lambda x: x.isNull())
        vector = F.when(whole, vector).otherwise(F.raise_error(F.lit(f"features are not {len(self.cuts)} numbers")))
        asked = data.select(F.col(own).alias("key"), F.lit(0).alias("y"), vector.alias("features"))
        votes = self._votes(asked, own, data.count())
        raw, total = F.col("raw"), F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
        out = data.join(votes, own).withColumn(self.getOrDefault("rawPredictionCol"), array_to_vector(raw)).withColumn(
            self.getOrDefault("probabilityCol"), array_to_vector(F.transform(raw, lambda x: F.when(total > 0, x / total).otherwise(0.0))))
        return out.withColumn(self.getOrDefault("predictionCol"), (F.array_position(raw, F.array_max(raw)) - 1).cast("double")).drop(
            own, "raw")

    def _votes(self, asked: DataFrame, own: str, rows: int) -> DataFrame:
        """``(own, raw)``: each row's sums of the trees' class shares."""
        top, s, size = self.top, self.settings, int(self.top.tree.max()) + 1
        k, heads = s.classes, max(1, int(top.branch.max()) + 1)
        blocks = _blocks(asked, self.cuts, rows)
        tasks = _dealt(float(rows) * size, float("inf"), blocks.ctx.defaultParallelism)
        copies = math.ceil(max(1.0, float(rows) * size / heads / DEALT_ROWS))  # of each branch, if many more rows come than it grew on
        leaf_votes = shares(top.counts)

        def deal(block):
            number, (_, _, bins) = block
            sent = squeezed(bins, s.bins)
            for t in range(size):
                branch = top.branch[top.ends(bins, t)]
                for b, r in _runs(branch, np.flatnonzero(branch >= 0)):
                    yield b * copies + number % copies, (number, len(bins), r.astype(np.int32), sent[r])

        def vote(parts):
            trees, waiting = {}, defaultdict(list)
            for b, part in parts:
                if isinstance(part, Branch):
                    trees[b] = part
                else:
                    waiting[b].append(part)
            while waiting:
                b, dealt = waiting.popitem()
                if b not in trees:  # a tree that no row was drawn for
                    continue
                tree = trees[b]
                for number, n, r, sent in dealt:
                    ref = tree.ref[reached(tree.feature, tree.cut, tree.ref, spread(sent, s.dims, s.bins))]
                    one = ref < k
                    yield number, (n, r[one], ref[one].astype(np.uint8), r[~one], tree.shares[ref[~one] - k])

        def total(parts):
            ids, sums = {}, {}
            for number, part in parts:
                n = len(part[0]) if len(part) == 3 else part[0]
                out = sums.setdefault(number, np.zeros((n, k), np.int64))
                if len(part) == 3:
                    ids[number], _, bins = part
                    for t in range(size):
                        at = top.ends(bins, t)
                        out += np.where((top.branch[at] < 0)[:, None], leaf_votes[at], 0)
                else:  # a row comes once a branch
                    out[part[1], part[2]] += VOTE
                    out[part[3]] += part[4]
            for number, out in sums.items():
                yield from zip(ids[number].tolist(), (out / VOTE).tolist(), strict=True)

        trees = self.branches.rdd.flatMap(lambda r: [(r.branch * copies + c, Branch.opened(r.feature, r.cut, r.ref, r.shares, k))
                                                     for c in range(copies)])
        votes = trees.union(blocks.flatMap(deal)).partitionBy(tasks, _same).mapPartitions(vote)
        sums = votes.union(blocks).partitionBy(blocks.getNumPartitions(), _same).mapPartitions(total)
        return cut_lineage(sums.toDF(f"`{own}` long, raw array<double>"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark)
        m.branches.write.mode("overwrite").parquet(f"{path}/branches")
        head = json.dumps({"top": m.top.to_dict(), "cuts": [c.tolist() for c in m.cuts], "settings": asdict(m.settings)})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/top")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        head = json.loads(spark.read.text(f"{path}/top").first()[0])
        model = ForestModel(spark.read.parquet(f"{path}/branches"), Top.from_dict(head["top"]), [np.array(c) for c in head["cuts"]],
                            Settings(**head["settings"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
