"""Boosted trees with a softmax objective, second order, on histograms (M-7, M-8).

Each round grows one tree a class.  For a row of class y with scores F the
gradient is ``p_c - [c = y]`` and the hessian ``p_c (1 - p_c)``, p the softmax of
F.  A leaf's value is ``-G / (H + l2)``, a split's gain is the rise of
``G^2 / (H + l2)``, and both children need a hessian sum of ``min_child_weight``.

Features are binned once, at quantiles, and a row lives in the partition it was
written to: its bins, class, fold and scores are one block of arrays.  A level of
all trees of a round is one pass over the blocks, which makes sums of gradient
and hessian by (class, node, feature, bin).  A tree's sums are added and its splits
picked in one task per tree, so the driver gets a few numbers a node and no
histogram; children take their sums from the split, so ``depth`` passes make a
round.  Cross-validation grows the models of all folds in the same passes: a
fold's rows have no part in its own model's sums.  A round's trees are added to
the rows' scores once, in the pass that follows; the scored blocks are kept by
Spark and checkpointed every ``checkpoint_every`` rounds, so a lost executor costs
a few rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.session import cut_lineage, ship_package


@dataclass(frozen=True)
class Settings:
    rounds: int
    rate: float
    depth: int = 4
    l2: float = 1.0
    min_child_weight: float = 1.0
    bins: int = 64
    checkpoint_every: int = 20


#: The presets of the source: rounds, learning rate, depth, child weight, L2.
PRESET_A = Settings(rounds=320, rate=0.05, depth=4, l2=1.0, min_child_weight=4.0)
PRESET_B = Settings(rounds=80, rate=0.1, depth=4, l2=0.1, min_child_weight=1.0)

#: Relative difference under which two gains are equal.
TIE = 1e-10

#: Cells of the histogram that a task may hold, and rows of a block.
MOST_CELLS = 1 << 24
BLOCK_ROWS = 16384
#: Rows a task should have at least, and at most if there are more tasks than cores.
FEW_ROWS, MANY_ROWS = 2048, 65536


@dataclass
class Tree:
    """A full binary tree in heap order: node i has children 2i + 1 and 2i + 2; a
    row goes left where its bin of ``feature`` is at most ``cut``; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class Model:
    """Trees by round and class, over bins cut at ``borders`` (per feature, ascending)."""

    classes: list[int]
    borders: list[np.ndarray]
    base: np.ndarray
    rate: float
    trees: list[list[Tree]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "borders": [b.tolist() for b in self.borders], "base": self.base.tolist(),
                           "rate": self.rate, "trees": [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in r]
                                                        for r in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        trees = [[Tree(np.array(f), np.array(c), np.array(v)) for f, c, v in r] for r in d["trees"]]
        return cls(d["classes"], [np.array(b) for b in d["borders"]], np.array(d["base"]), d["rate"], trees)

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Bins of the rows of ``x``; NaN goes to the first bin."""
        out = np.zeros(x.shape, np.uint8)
        for j, b in enumerate(self.borders):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(b, x[:, j], side="left"))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.bin(x)
        return self.base + tree_scores(self.trees, bins, self.rate, len(self.classes))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.classes)[self.scores(x).argmax(axis=1)]


def tree_scores(rounds: list[list[Tree]], bins: np.ndarray, rate: float, width: int) -> np.ndarray:
    """Sum of the trees of ``rounds``, (rows, ``width``)."""
    out = np.zeros((len(bins), width))
    for r in rounds:
        for c, t in enumerate(r):
            out[:, c] += rate * t.value[leaves(t, bins)]
    return out


def leaves(t: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf each row ends in (or the node it has reached in a tree still growing)."""
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(len(t.feature).bit_length()):
        f = t.feature[at]
        inner = f >= 0
        if not inner.any():
            break
        right = bins[rows, np.maximum(f, 0)] > t.cut[at]
        at = np.where(inner, 2 * at + 1 + right, at)
    return at


def softmax(f: np.ndarray) -> np.ndarray:
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histogram(bins, y, fold, scores, models: int, growing: list[Tree], nodes: list[list[int]], n_bins: int) -> np.ndarray:
    """(2, models * classes, nodes, features, bins): sums of gradient and hessian over
    the rows in the open ``nodes`` of each growing tree; model m leaves out fold m."""
    k, width, dims = scores.shape[1] // models, max(len(n) for n in nodes), bins.shape[1]
    out = np.zeros((2, models * k, width, dims, n_bins))
    for m in range(models):
        p = softmax(scores[:, m * k:(m + 1) * k])
        for c in range(k):
            t = m * k + c
            if not nodes[t]:
                continue
            slot = np.full(len(growing[t].feature), -1)
            slot[nodes[t]] = np.arange(len(nodes[t]))
            at = slot[leaves(growing[t], bins)]
            on = np.flatnonzero((at >= 0) & (fold != m))
            g, h = p[on, c] - (y[on] == c), p[on, c] * (1 - p[on, c])
            for j in range(dims):
                cell = at[on] * n_bins + bins[on, j]
                for s, v in enumerate((g, h)):
                    out[s, t, :, j, :] += np.bincount(cell, weights=v, minlength=width * n_bins).reshape(width, n_bins)
    return out


def best_split(g: np.ndarray, h: np.ndarray, s: Settings):
    """(feature, cut, sums left, sums right) of one node from its (features, bins) sums, or None if none gains.
    Among gains that are equal up to rounding the first counts, whatever order the sums were added in."""
    gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
    gt, ht = gl[:, -1:], hl[:, -1:]
    gr, hr = gt - gl, ht - hl
    gain = gl ** 2 / (hl + s.l2) + gr ** 2 / (hr + s.l2) - gt ** 2 / (ht + s.l2)
    gain = np.where((hl >= s.min_child_weight) & (hr >= s.min_child_weight), gain, -np.inf)
    top = gain.max()
    if top <= 1e-9:
        return None
    j, b = np.unravel_index(np.argmax(gain >= top - TIE * max(1.0, top)), gain.shape)
    return int(j), int(b), (gl[j, b], hl[j, b]), (gr[j, b], hr[j, b])


def grow(ask, width: int, s: Settings) -> list[Tree]:
    """One round: ``ask(trees, nodes)`` gives, by tree, for each of a level's open nodes its sums and split."""
    size = 2 ** (s.depth + 1) - 1
    trees = [Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size)) for _ in range(width)]
    nodes = [[0] for _ in range(width)]
    for level in range(max(1, s.depth)):
        if not any(nodes):
            break
        found = ask(trees, nodes)
        below: list[list[int]] = [[] for _ in range(width)]
        for c in range(width):
            for node, (g, h, split) in zip(nodes[c], found[c] if nodes[c] else [], strict=True):
                if level == 0:
                    trees[c].value[0] = -g / (h + s.l2)
                if split:
                    trees[c].feature[node], trees[c].cut[node] = split[:2]
                    for child, (gs, hs) in zip((2 * node + 1, 2 * node + 2), split[2:], strict=True):
                        trees[c].value[child] = -gs / (hs + s.l2)
                        below[c].append(child)
        nodes = below
    return trees


BLOCK = "n int, bins binary, ys binary, folds binary, base binary"


def _blocks(data: DataFrame, model: Model, base: np.ndarray) -> DataFrame:
    """The rows of ``data(features, label, fold)`` as blocks of bins, class numbers, folds and scores."""
    number = {c: i for i, c in enumerate(model.classes)}

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), BLOCK_ROWS):
                part = f.iloc[a:a + BLOCK_ROWS]
                bins = model.bin(np.array(part["features"].tolist(), np.float64).reshape(len(part), -1))
                ys, folds = part["label"].map(number).to_numpy(np.int32), part["fold"].to_numpy(np.int32)
                yield pd.DataFrame({"n": [len(part)], "bins": [bins.tobytes()], "ys": [ys.tobytes()], "folds": [folds.tobytes()],
                                    "base": [np.tile(base, (len(part), 1)).tobytes()]})

    return cut_lineage(data.mapInPandas(pack, BLOCK))


def _opened(p):
    return (np.frombuffer(p.bins, np.uint8).reshape(p.n, -1), np.frombuffer(p.ys, np.int32), np.frombuffer(p.folds, np.int32),
            np.frombuffer(p.base).reshape(p.n, -1))


def borders(data: DataFrame, dims: int, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` cuts a feature, at approximate quantiles of its values (NaN and null aside)."""
    share = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = data.select(F.posexplode("features").alias("j", "x")).where(~F.isnan("x") & F.col("x").isNotNull()).groupBy("j").agg(
        F.percentile_approx("x", share, 20 * bins).alias("cuts"), F.max("x").alias("top")).collect()
    found = {r["j"]: np.array([c for c in sorted(set(r["cuts"])) if c < r["top"]]) for r in rows}
    return [found.get(j, np.zeros(0)) for j in range(dims)]


def fit(matrix: DataFrame, s: Settings, features: str = "features", label: str = "target") -> Model:
    """Fit on all rows of ``matrix`` with a label; null features count as NaN and go left."""
    return _fit(matrix, s, 1, F.lit(-1), features, label)[0]


def fit_folds(matrix: DataFrame, s: Settings, folds: int, fold: str = "fold", features: str = "features",
              label: str = "target") -> list[Model]:
    """A model for each fold 0, 1, ..., fitted on the rows of the other folds.  The
    bins are cut over all rows; labels of a fold never reach its model."""
    return _fit(matrix, s, folds, F.col(fold), features, label)


def _fit(matrix: DataFrame, s: Settings, models: int, fold, features: str, label: str) -> list[Model]:
    ship_package(matrix.sparkSession)
    data = cut_lineage(matrix.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("features"),
        F.col(label).cast("long").alias("label"), F.coalesce(fold.cast("int"), F.lit(-1)).alias("fold")))
    counts = {(r["label"], r["fold"]): r["count"] for r in data.groupBy("label", "fold").count().collect()}
    if not counts:
        raise ValueError("no rows to fit on")
    dims = data.agg(F.max(F.size("features"))).first()[0]
    classes = sorted({c for c, _ in counts})
    k, width = len(classes), models * len(classes)
    if width * 2 ** s.depth * dims * s.bins > MOST_CELLS:
        raise ValueError("classes x nodes x features x bins is over the bound of the histogram")
    n = np.array([[sum(v for (c, f), v in counts.items() if c == own and f != m) for own in classes] for m in range(models)], float)
    base = np.log(np.maximum(n / np.maximum(n.sum(axis=1, keepdims=True), 1), 1e-12))  # a class a fold never saw
    cuts = borders(data, dims, s.bins)
    out = [Model(classes, cuts, base[m], s.rate) for m in range(models)]
    tasks = _tasks(sum(counts.values()), matrix.sparkSession.sparkContext.defaultParallelism)
    now, before = _blocks(data.repartition(tasks), out[0], base.ravel()).rdd.map(_opened).persist(StorageLevel.MEMORY_AND_DISK), None
    for done in range(1, s.rounds + 1):
        trees = grow(lambda trees, nodes, now=now: _level(now, s, models, trees, nodes, tasks), width, s)
        for m in range(models):
            out[m].trees.append(trees[m * k:(m + 1) * k])
        if before is not None:
            before.unpersist()
        before, now = now, _rescored(now, trees, s.rate).persist(StorageLevel.MEMORY_AND_DISK)
        if done % s.checkpoint_every == 0:
            now.checkpoint()  # written by the next round's first pass
    if before is not None:
        before.unpersist()
    now.unpersist()
    return out


def _tasks(rows: int, cores: int) -> int:
    """Tasks of a pass: enough rows in each, all cores used, and no more tasks than memory asks for,
    since each makes a whole histogram."""
    return max(1, min(cores, -(-rows // FEW_ROWS)), -(-rows // MANY_ROWS))


def _level(blocks, s: Settings, models: int, trees, nodes, tasks: int) -> dict[int, list]:
    """By tree: sums of gradient and hessian and the best split of each of its open nodes."""
    width = len(trees)

    def run(part, rows):
        total = None
        for bins, y, fold, scores in rows:
            got = histogram(bins, y, fold, scores, models, trees, nodes, s.bins)
            total = got if total is None else total + got
        if total is not None:
            for t in range(width):
                if nodes[t]:
                    yield t, (part, total[:, t, :len(nodes[t])].copy())

    def choose(parts):
        sums = sum(v for _, v in sorted(parts, key=lambda p: p[0]))  # in one order, whatever came first
        return [(float(g[0].sum()), float(h[0].sum()), best_split(g, h, s) if s.depth else None) for g, h in zip(*sums, strict=True)]

    return blocks.mapPartitionsWithIndex(run).groupByKey(min(width, tasks)).mapValues(choose).collectAsMap()


def _rescored(blocks, trees: list[Tree], rate: float):
    """The blocks with a round's trees added to their scores."""
    def run(p):
        bins, y, fold, scores = p
        return bins, y, fold, scores + tree_scores([trees], bins, rate, scores.shape[1])
    return blocks.map(run)


def predict(model: Model, matrix: DataFrame, features: str = "features", kind: str = "int") -> DataFrame:
    """``matrix`` with ``prediction``, null where ``features`` is null; equal scores go to the smaller class."""
    ship_package(matrix.sparkSession)

    @F.pandas_udf(kind)
    def score(v: pd.Series) -> pd.Series:
        have = v.notna()
        out = pd.Series([None] * len(v), dtype="Int64")
        if have.any():
            x = np.array([[np.nan if c is None else c for c in r] for r in v[have]], np.float64)
            out[have.to_numpy()] = model.predict(x)
        return out

    return matrix.withColumn("prediction", score(F.transform(features, lambda x: x.cast("double"))))
