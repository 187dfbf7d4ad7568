"""Operator 2: n-gram Jaccard join by universe-partition pigeonhole.

Documents with equal shingle sets are one class.  Signatures of the classes
(see ``segments``) meet in buckets; classes that share one are candidates.  A
candidate pair is dropped when the L1 distance of two small histograms of the
shingle hashes, which their symmetric difference cannot be under, is already too
much, and else verified on whole sets.

Links are found component by component, and exactly.  First every class is
verified against one other that it meets most often, and what that links is
contracted, so that a group of copies costs a pair a member.  Then the classes of
every signature that still holds several components meet in cells, twice: first
with histograms only, which leaves the classes that some other one may link to,
and those with their whole sets.  A cell verifies the pairs in it that share a
signature and lie in different components, and returns a spanning forest of the
links it finds: fewer rows than it has members, however many pairs it compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import components, unused, written
from sigframe.llm.segments import signatures
from sigframe.llm.shingles import shingle_sets

#: Signatures that a map task gathers before it deals them out, and that a bucket holds, about.
FLUSH, BUCKET = 1 << 18, 1 << 20
#: Members of one signature in one flush from which they pass by the buckets.
FREQUENT = 64
#: Members and bytes of token hashes of one block of classes; a cell holds two at most.
BLOCK, BYTES = 2048, 1 << 24
#: Tokens that are looked up at a time, and pairs of histograms compared at a time.
LOOKUP, PAIRS = 1 << 21, 100_000
#: Ids that a broadcast may hold (8 bytes each).
SMALL = 200_000


def _print(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lanes(n: int) -> int:
    """Lanes of a histogram: a power of two, two to four tokens a lane."""
    return 1 << min(12, max(5, n.bit_length() - 2))


def _histogram(tokens: np.ndarray) -> bytes:
    lanes = _lanes(len(tokens))
    lane = (tokens >> np.uint64(65 - lanes.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(lane, minlength=lanes), 255).astype(np.uint8).tobytes()


class _Histograms:
    """Histograms of many sets; two are compared at the lanes of the coarser."""

    def __init__(self, n: np.ndarray, hist: Sequence[bytes]):
        self.n, self.lanes = n, np.array([len(h) for h in hist])
        self.row = np.zeros((2, len(n)), dtype=np.int64)  # at own lanes, and at half of them
        self.at: dict[int, np.ndarray] = {}
        for lanes in np.unique(self.lanes).tolist():
            own = np.flatnonzero(self.lanes == lanes)
            m = np.frombuffer(b"".join(hist[k] for k in own), np.uint8).reshape(-1, lanes).astype(np.int16)
            for halved, x in ((0, m), (1, m.reshape(len(own), -1, 2).sum(axis=2, dtype=np.int16))):
                have = self.at.get(x.shape[1], np.zeros((0, x.shape[1]), np.int16))
                self.row[halved, own] = np.arange(len(own)) + len(have)
                self.at[x.shape[1]] = np.concatenate([have, x])

    def near(self, i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
        """Whether sizes and histograms allow a link of rows i and j."""
        ok = q * np.minimum(self.n[i], self.n[j]) >= p * np.maximum(self.n[i], self.n[j])
        low = np.minimum(self.lanes[i], self.lanes[j])
        ok &= np.maximum(self.lanes[i], self.lanes[j]) <= 2 * low  # sizes within the ratio differ by one level
        for lanes in np.unique(low[ok]).tolist():
            k = np.flatnonzero(ok & (low == lanes))
            m, a, b = self.at[lanes], i[k], j[k]
            gap = np.abs(m[self.row[(self.lanes[a] > lanes).astype(int), a]]
                         - m[self.row[(self.lanes[b] > lanes).astype(int), b]]).sum(axis=1, dtype=np.int64)
            ok[k] = (q + p) * gap <= (q - p) * (self.n[a] + self.n[b])
        return ok


def _described(docs: DataFrame, k: int) -> DataFrame:
    """``(id, th, n, fp, hist)``: id and text hash, and the set's size, fingerprint
    and histogram (null without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, fp, hist = [], [], []
            for s in shingle_sets(b["text"].tolist(), k):
                n.append(len(s))
                fp.append(_print(s) if len(s) else None)
                hist.append(_histogram(s) if len(s) else None)
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "n": n, "fp": pd.array(fp, "Int64"), "hist": hist})

    return docs.mapInPandas(run, "id long, th long, n long, fp long, hist binary")


def _memberships(docs: DataFrame, total: int, k: int, p: int, q: int) -> DataFrame:
    """``(sig, fp)`` for every signature that two classes or more have.

    A map task deals its signatures to buckets as packed arrays; a bucket holds
    about a million, however many there are in all.  Members of a signature that
    is frequent within a task go out directly, one of them standing for the rest
    in the bucket, so a signature that a third of the documents share adds at
    most ``FREQUENT`` entries a flush to its bucket."""
    buckets = max(1, math.ceil(0.35 * total / BUCKET))
    entry = np.dtype([("sig", "<u4"), ("fp", "<i8")])

    def deal(sigs: list[np.ndarray], fps: list[int], salt: int) -> pd.DataFrame:
        sig = np.concatenate(sigs)
        fp = np.repeat(np.array(fps, dtype=np.int64), [len(s) for s in sigs])
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        low = (sig >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((fp, low, bucket))
        bucket, low, fp = bucket[order], low[order], fp[order]
        same = (bucket[1:] == bucket[:-1]) & (low[1:] == low[:-1])
        fresh = np.concatenate([[True], ~(same & (fp[1:] == fp[:-1]))])
        bucket, low, fp = bucket[fresh], low[fresh], fp[fresh]
        head = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])])
        first = np.flatnonzero(head)
        many = np.repeat(np.diff(first, append=len(fp)), np.diff(first, append=len(fp))) > FREQUENT
        meet = ~many | head
        rows: list[tuple[int, int, int, bytes]] = []
        for kind, which in ((0, meet), (1, many)):
            b, e = bucket[which], np.empty(int(which.sum()), dtype=entry)
            e["sig"], e["fp"] = low[which], fp[which]
            cut = [*np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])).tolist(), len(b)] if len(b) else []
            for x, y in pairwise(cut):
                to = int(b[x]) if kind == 0 else (int(b[x]) + salt) % buckets
                rows.append((to, kind, int(b[x]), e[x:y].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "kind", "own", "entries"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, fps, size, salt = [], [], 0, 0
        for b in batches:
            for s in shingle_sets(b["text"].tolist(), k):
                if not len(s):
                    continue
                sigs.append(signatures(s, p, q))
                fps.append(_print(s))
                size += len(sigs[-1])
                if size >= FLUSH:
                    yield deal(sigs, fps, salt)
                    sigs, fps, size, salt = [], [], 0, salt + 1
        if sigs:
            yield deal(sigs, fps, salt)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        here = rows[rows["kind"] == 0]
        if len(here):
            e = np.frombuffer(b"".join(here["entries"]), dtype=entry)
            e = e[np.lexsort((e["fp"], e["sig"]))]
            e = e[np.concatenate([[True], e[1:] != e[:-1]])]
            first = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]]))
            size = np.diff(first, append=len(e))
            e = e[np.repeat(size > 1, size)]
            parts.append((int(here["bucket"].iloc[0]), e))
        for r in rows[rows["kind"] == 1].itertuples(index=False):
            parts.append((int(r.own), np.frombuffer(r.entries, dtype=entry)))
        return pd.DataFrame({
            "sig": np.concatenate([np.zeros(0, np.int64), *[(own << 32) | e["sig"].astype(np.int64) for own, e in parts]]),
            "fp": np.concatenate([np.zeros(0, np.int64), *[e["fp"] for _, e in parts]])})

    dealt = docs.select("text").mapInPandas(run, "bucket long, kind int, own long, entries binary")
    return dealt.groupBy("bucket").applyInPandas(meet, "sig long, fp long").distinct()


def _sets(docs: DataFrame, classes: DataFrame, fps: DataFrame, k: int) -> DataFrame:
    """``(fp, tokens)`` of the classes ``fps``, from one text of each."""
    wanted = written(classes.join(fps, "fp").select("th", F.col("fp").alias("want")))
    small = wanted.count() <= SMALL
    texts = docs.select("th", "text").join(F.broadcast(wanted) if small else wanted, "th").dropDuplicates(["th"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"fp": b["want"], "tokens": [s.tobytes() for s in shingle_sets(b["text"].tolist(), k)]})

    return written(texts.mapInPandas(run, "fp long, tokens binary"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, on whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(q * both >= p * (len(u) + len(v) - both))
            yield b.loc[keep, ["a", "b"]]

    one = sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _allowed(pairs: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose histograms allow a link."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                both = _Histograms(np.concatenate([b["na"], b["nb"]]), [*b["ha"], *b["hb"]])
                i = np.arange(len(b))
                yield b.loc[both.near(i, i + len(b), p, q), ["a", "b"]]

    one = classes.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("hist").alias("ha"))
    two = classes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("hb"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def _blocks(many: str, weight: str) -> Column:
    """Blocks for ``many`` classes that have ``weight`` tokens in all."""
    return F.ceil(F.greatest(F.col(many) / BLOCK, F.col(weight) * 8 / BYTES))


def _apart(members: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """``(g, blocks, fp, comp, n, sigs)``: the classes of each group that has to be
    compared, with the signatures by which they are in it.

    Signatures of one component are done.  The others are grouped by the smallest
    class that is two signatures away at most, so that the many signatures of one
    family of texts are one group, and a class is sent there once.  Where a group
    is so large that cutting it into pairs of blocks would send more classes than
    its signatures have members, each signature is a group of its own."""
    m = members.join(comp, F.col("fp") == F.col("node"), "left").select(
        "sig", "fp", F.coalesce("component", "fp").alias("comp"))
    mixed = m.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    m = written(m.join(mixed, "sig").join(classes.select("fp", "n"), "fp"))
    sigs = m.groupBy("sig").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"), F.min("fp").alias("lead"))
    sigs = written(sigs.select("sig", "lead", "many", _blocks("many", "weight").alias("blocks")))
    near = m.join(sigs.select("sig", "lead"), "sig").groupBy("fp").agg(F.min("lead").alias("near"))
    labels = written(m.join(near, "fp").groupBy("sig").agg(F.min("near").alias("label")))
    whole = m.join(labels, "sig").groupBy("label", "fp").agg(F.first("n").alias("n")).groupBy("label").agg(
        F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"))
    whole = whole.select("label", "many", _blocks("many", "weight").alias("whole"))
    apart = labels.join(sigs, "sig").groupBy("label").agg(F.sum(F.col("many") * F.col("blocks")).alias("cost"))
    fits = whole.join(apart, "label").where("many * whole <= cost").select("label", "whole")
    group = labels.join(sigs, "sig").join(fits, "label", "left").select(
        "sig", F.when(F.col("whole").isNull(), F.col("sig")).otherwise(F.col("label")).alias("g"),
        F.coalesce("whole", "blocks").alias("blocks"))
    return m.join(group, "sig").groupBy("g", "blocks", "fp", "comp", "n").agg(F.collect_list("sig").alias("sigs"))


def _partners(label: np.ndarray, n: np.ndarray, block: np.ndarray, sigs: list[np.ndarray], whole: bool, p: int,
              q: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every row the later ones that share a signature with it, have another
    label (as it is at that time) and a size that can link; without ``whole`` only
    those of the other block."""
    row = np.repeat(np.arange(len(n)), [len(x) for x in sigs])
    sig = np.concatenate(sigs)
    order = np.lexsort((row, sig))
    end = np.searchsorted(sig[order], sig, side="right")  # of the signature's members, for each membership
    member, place = row[order], np.empty(len(row), dtype=np.int64)
    place[order] = np.arange(len(row))
    own = np.concatenate([[0], np.cumsum([len(x) for x in sigs])])
    for i in range(len(n)):
        meets = np.zeros(len(n), dtype=bool)
        for x, y in zip(place[own[i]:own[i + 1]].tolist(), end[own[i]:own[i + 1]].tolist(), strict=True):
            if x + 1 < y:
                meets[member[x + 1:y]] = True
        meets &= (label != label[i]) & (q * np.minimum(n, n[i]) >= p * np.maximum(n, n[i]))
        if not whole:
            meets &= block != block[i]
        others = np.flatnonzero(meets)
        if len(others):
            yield i, others


def _hopeful(n: np.ndarray, comp: np.ndarray, block: np.ndarray, sigs: list[np.ndarray], hist: list[bytes], whole: bool,
             p: int, q: int) -> np.ndarray:
    """Rows that the histograms allow a link with a row of another component."""
    hists, hope = _Histograms(n, hist), np.zeros(len(n), dtype=bool)
    ones: list[np.ndarray] = []
    twos: list[np.ndarray] = []
    held = 0

    def compare() -> None:
        i, j = np.concatenate(ones), np.concatenate(twos)
        ok = hists.near(i, j, p, q)
        hope[i[ok]] = hope[j[ok]] = True

    for i, others in _partners(comp, n, block, sigs, whole, p, q):
        ones.append(np.full(len(others), i))
        twos.append(others)
        held += len(others)
        if held >= PAIRS:
            compare()
            ones, twos, held = [], [], 0
    if held:
        compare()
    return hope


def _forest(fp: np.ndarray, comp: np.ndarray, block: np.ndarray, sigs: list[np.ndarray], sets: list[np.ndarray],
            whole: bool, p: int, q: int) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the links of classes that share a
    signature; without ``whole`` only of those between two blocks."""
    n = np.array([len(x) for x in sets])
    word = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(n)])
    seen = np.zeros(int(word.max()) + 1, dtype=bool)
    label = np.unique(comp, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    for i, others in _partners(label, n, block, sigs, whole, p, q):
        seen[word[start[i]:start[i + 1]]] = True
        batch = np.cumsum(n[others]) // LOOKUP
        for some in np.split(others, np.flatnonzero(np.diff(batch)) + 1):
            first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            at = np.repeat(start[some] - first, n[some]) + np.arange(int(n[some].sum()))
            both = np.add.reduceat(seen[word[at]].astype(np.int64), first)
            for j in some[q * both >= p * (n[i] + n[some] - both)].tolist():
                if label[i] != label[j]:
                    links.append((int(fp[i]), int(fp[j])))
                    label[label == label[j]] = label[i]
        seen[word[start[i]:start[i + 1]]] = False
    return links


def _cells(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows`` (g, blocks, fp, ...) with the cell ``s, packed, i, j`` and the
    ``block``: groups of one block go to ``tasks`` cells, many to each; of others
    every two blocks are a cell of their own."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    packed = F.col("blocks") <= 1
    return rows.select("*", F.when(packed, F.pmod(F.xxhash64("g"), F.lit(tasks))).otherwise(F.col("g")).alias("s"),
                       packed.alias("packed"), F.explode(cells).alias("cell")).select(
        "*", "cell.i", "cell.j").drop("cell", "blocks")


def _groups(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The groups of a cell, each in the order of its classes."""
    rows = rows.sort_values(["g", "fp"], kind="stable")
    g = rows["g"].to_numpy()
    for x, y in pairwise([0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]):
        yield rows.iloc[x:y]


def _tasks(apart: DataFrame) -> int:
    return math.ceil(8 * (apart.agg(F.sum("n")).first()[0] or 0) / BYTES) + 1


def _candidates(apart: DataFrame, classes: DataFrame, p: int, q: int) -> DataFrame:
    """The rows of ``apart`` that the histograms allow a link, in blocks anew."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in _groups(rows):
            hope = _hopeful(part["n"].to_numpy(), part["comp"].to_numpy(), part["block"].to_numpy(), list(part["sigs"]),
                            list(part["hist"]), key[2] == key[3], p, q)
            out.append(part.loc[hope, ["g", "fp"]])
        return pd.concat(out)

    cells = _cells(apart.join(classes.select("fp", "hist"), "fp"), _tasks(apart))
    hope = cells.groupBy("s", "packed", "i", "j").applyInPandas(run, "g long, fp long").distinct()
    kept = written(apart.drop("blocks").join(hope, ["g", "fp"]))
    blocks = kept.groupBy("g").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"))
    return kept.join(blocks.select("g", _blocks("many", "weight").alias("blocks")), "g")


def _joined(apart: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Links ``(a, b)`` that connect the components in the groups ``apart``."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for part in _groups(rows):
            out += _forest(part["fp"].to_numpy(), part["comp"].to_numpy(), part["block"].to_numpy(), list(part["sigs"]),
                           [np.frombuffer(v, np.uint64) for v in part["tokens"]], key[2] == key[3], p, q)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    cells = _cells(apart.join(sets, "fp"), _tasks(apart))
    return cells.groupBy("s", "packed", "i", "j").applyInPandas(run, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``(id, th, n, fp, component)``, a row per row of ``docs``: its id, a hash
    of its text, the size and fingerprint of its shingle set, and the smallest
    fingerprint that links reach from it (null without words)."""
    p, q = percent, 100
    if not 50 <= p <= q:  # sets of two bands meet, so sizes may differ by a factor of two
        raise ValueError("percent is at least 50 and at most 100")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    seen = written(_described(rows, k))
    classes = written(seen.where("fp is not null").groupBy("fp").agg(
        F.min("th").alias("th"), F.first("n").alias("n"), F.first("hist").alias("hist")))
    total = seen.agg(F.sum("n")).first()[0] or 0
    members = written(_memberships(rows, total, k, p, q))
    leaders = members.groupBy("sig").agg(F.min("fp").alias("leader"))
    met = members.join(leaders, "sig").where("fp != leader").groupBy("fp", "leader").count()
    first = met.groupBy("fp").agg(F.max(F.struct("count", -F.col("leader"), "leader")).alias("best"))
    first = written(_allowed(first.select(F.col("fp").alias("a"), F.col("best.leader").alias("b")), classes, p, q))
    links = written(_verified(first, _sets(rows, classes, _ends(first), k), p, q))
    comp = written(components(links))
    apart = written(_candidates(written(_apart(members, comp, classes)), classes, p, q))
    found = written(_joined(apart, _sets(rows, classes, apart.select("fp").distinct(), k), p, q))
    if not found.isEmpty():
        comp = written(components(links.union(found)))
    return seen.join(comp, F.col("fp") == F.col("node"), "left").select(
        "id", "th", "n", "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """Documents linked by the Jaccard similarity of their word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z in lower case;
    a document's set is its distinct ``k``-word shingles, or with fewer words the
    whole sequence.  Two documents link when 100 * intersection >= ``percent`` *
    union.  Shingles and sets are compared as 64-bit hashes.

    Null texts and texts without words have an empty set, link with nothing, and
    are a component of their own.  Very long texts are hashed whole.  Repeated
    rows are documents of their own with equal sets.  Null ids link, but give no
    component its name (a component of null ids only has a null one).  An empty
    table gives no rows; other columns are not read.

    Returns ``(<id_col>, n_shingles, component_id)``, a row per row of ``docs``;
    ``component_id`` is the smallest id that links reach.
    """
    linked = written(link(docs, id_col, text_col, k, percent))
    names = linked.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    out = linked.join(names, "component", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id"))
                      .alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each linked group: that of the smallest id
    (nulls last), of equal ids that of the smallest text hash, of fully repeated
    ones any.  Documents without words are in no group and all stay.  All columns
    stay as they are, whatever their names."""
    linked = written(link(docs, id_col, text_col, k, percent)).where("component is not null")
    order = F.struct(F.col("id").isNull(), "id", "th")
    chosen = linked.groupBy("component").agg(F.min(order).alias("best")).select("best.id", "best.th")
    keys = [unused(docs, c) for c in ("_ng_id", "_ng_no", "_ng_th")]
    known = chosen.select(F.coalesce(F.col("id"), F.lit(-1)).alias(keys[0]), F.col("id").isNull().alias(keys[1]),
                          F.col("th").alias(keys[2]))
    own = docs.withColumns({keys[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), keys[1]: F.col(id_col).isNull(),
                            keys[2]: F.xxhash64(F.col(text_col).cast("string"))})
    has = F.coalesce(F.regexp_like(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = own.where(has).join(known, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*docs.columns).unionByName(docs.where(~has))
