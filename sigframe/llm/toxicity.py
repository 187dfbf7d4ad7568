"""Operator 9: toxicity severity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all ordered
thresholds theta_1 <= theta_2 <= ...; the expected severity is the sum of these
probabilities over k.  x counts, for hashed features (a word, its first five
letters), the distinct words of the text that have them, so a text's score is a
sum of word scores.  Only features that speak for severity are kept: a long
clean text then gathers nothing, and a toxic passage is not outweighed by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import unused
from sigframe.session import ship_package

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray


def features(word: str, bits: int, prefix: int = 5) -> list[int]:
    """Hashed features of one word."""
    mask = (1 << bits) - 1
    own = zlib.crc32(b"w" + word.encode()) & mask
    return [own, zlib.crc32(b"p" + word[:prefix].encode()) & mask] if len(word) > prefix else [own]


def words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def _above(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade >= k) for every row and threshold."""
    return 1.0 / (1.0 + np.exp(-np.clip(z[:, None] - theta[None, :], -30, 30)))


def word_hashes(text: str | None) -> np.ndarray:
    """(distinct words, 2): the hashes of a text's words and of their first letters
    (the word's own again where it is not longer), in the order of the words."""
    return _hashes(words(text))


def _hashes(ws: set[str]) -> np.ndarray:
    pairs = [(f[0], f[-1]) for f in (features(w, 32) for w in sorted(ws))]
    return np.array(pairs, dtype=np.uint32).reshape(-1, 2)


def fit_rows(rows: list[tuple[set[str], int]], **settings) -> Model:
    """``fit_hashes`` on word sets."""
    return fit_hashes([_hashes(ws) for ws, _ in rows], np.array([g for _, g in rows], dtype=int), **settings)


def fit_hashes(rows: list[np.ndarray], grade: np.ndarray, bits: int = 20, keep: int = 8192, least: float = 10.8,
               ratio: float = 8.0, steps: int = 400, lasso: float = 1e-3, rate: float = 0.1) -> Model:
    """Fit on texts as ``word_hashes`` gives them, with grades 0, 1, 2, ...: features that are more frequent
    above grade 0, ``ratio`` times or more, are screened by their likelihood ratio
    (G squared of at least ``least``, the ``keep`` highest; no threshold under
    0.5, so that a text without such a feature is grade 0), then the shared weights, none negative, and
    the thresholds follow the likelihood of the cumulative links (Adam; ``lasso``
    drops words that only repeat what others already tell).  Without rows, or with one grade only,
    every weight is 0 and every text has grade 0."""
    top = int(grade.max(initial=0))
    if top == 0 or grade.min() > 0:
        return Model(np.zeros(1 << bits), np.full(max(1, top), 30.0))
    pairs = np.concatenate(rows)
    own_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    longer = pairs[:, 0] != pairs[:, 1]
    at_a = np.concatenate([own_row, own_row[longer]])
    cols = np.concatenate([pairs[:, 0], pairs[longer, 1]]).astype(np.int64) & ((1 << bits) - 1)
    del pairs, own_row, longer
    # counted over the features that occur, in their order
    own, cols_a = np.unique(cols, return_inverse=True)
    bad = grade > 0
    has = np.unique(at_a << bits | cols_a)
    has_row, has_col = has >> bits, has & ((1 << bits) - 1)
    n_bad = np.bincount(has_col[bad[has_row]], minlength=len(own))
    n_all = np.bincount(has_col, minlength=len(own))
    del has, has_row, has_col
    n_good = n_all - n_bad
    r_bad, r_all = n_bad / bad.sum(), n_all / len(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(n_bad > 0, n_bad * np.log(r_bad / r_all), 0)
                  + np.where(n_good > 0, n_good * np.log(n_good / (~bad).sum() / r_all), 0))
    g2 = np.where((n_bad >= 3) & (r_bad >= ratio * n_good / (~bad).sum()), g2, 0)
    chosen = np.argsort(-g2, kind="stable")[:keep]
    chosen = chosen[g2[chosen] >= least]
    slot = np.full(len(own), -1)
    slot[chosen] = np.arange(len(chosen))
    held = slot[cols_a] >= 0
    r, c = at_a[held], slot[cols_a[held]]
    w, theta = np.zeros(len(chosen)), np.linspace(0.5, 1.5, top)
    above = (grade[:, None] >= np.arange(1, top + 1)[None, :]).astype(float)
    # every grade's rows weigh alike, whatever their number
    share = np.bincount(grade, minlength=top + 1)
    weigh = (len(grade) / (np.count_nonzero(share) * share[grade]))[:, None]
    m, v = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for step in range(1, steps + 1):
        z = np.bincount(r, weights=w[c], minlength=len(rows))
        err = weigh * (_above(z, theta) - above) / len(rows)
        grad = np.concatenate([np.bincount(c, weights=err.sum(axis=1)[r], minlength=len(w)) + lasso,
                               -err.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w, theta = np.maximum(w - move[:len(w)], 0), np.sort(np.maximum(theta - move[len(w):], 0.5))
    full = np.zeros(1 << bits)
    full[own[chosen]] = w
    return Model(full, theta)


def dose_grades(rows: list[np.ndarray], toxic: np.ndarray, grades: int) -> np.ndarray:
    """Severity grades from binary labels: 0 if not toxic, else 1 to ``grades``
    by the number of distinct words the text has that stand out in toxic texts,
    cut at the quantiles of that number."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known, word = np.unique(np.concatenate([r[:, 0] for r in rows]), return_inverse=True)
    bad = np.bincount(word, weights=toxic[at], minlength=len(known))
    good = np.bincount(word, minlength=len(known)) - bad
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    mark = (bad >= 3) & (bad / n_bad >= 8 * (good + 0.5) / n_good)
    dose = np.bincount(at, weights=mark[word], minlength=len(rows))
    out = np.zeros(len(rows), dtype=int)
    if toxic.any():
        cuts = np.quantile(dose[toxic], np.arange(1, grades) / grades)
        out[toxic] = 1 + np.searchsorted(cuts, dose[toxic], side="left")
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        toxic_rows: int = 1500, clean_rows: int = 4500, grades: int = 3, bits: int = 20, max_row_bytes: int = 65_536) -> Model:
    """Fit on a bounded sample of labelled documents.

    Bounds: about ``toxic_rows`` and ``clean_rows`` documents of either label,
    at most twice as many together, none over ``max_row_bytes``, taken in the
    order of a hash of the id, so reruns agree.
    Documents labelled both ways count as toxic; null ids, labels and texts are
    left out.  Labels above 1 are severity grades as they are; binary labels get
    theirs from ``dose_grades``.
    """
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = {r["bad"]: r["count"] for r in lab.groupBy((F.col("y") > 0).alias("bad")).count().collect()}
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    cut = F.when(F.col("y") > 0, F.lit(_cut(toxic_rows, n.get(True, 0)))).otherwise(
        F.lit(_cut(clean_rows, n.get(False, 0))))
    most = 2 * (toxic_rows + clean_rows)
    picked = lab.withColumn("h", h).where(F.col("h") < cut).orderBy("h", "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull() & (F.octet_length("text") <= max_row_bytes))
    # at most ``most`` ids go to the texts, which then need no shuffle; hashes of words come back, not texts

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "words": [word_hashes(t).tobytes() for t in b["text"]]})

    ship_package(docs.sparkSession)
    got = texts.join(F.broadcast(picked), "id").select("h", "y", "text").mapInPandas(hashed, "h long, y int, words binary").orderBy(
        "h", "words").limit(most).collect()
    sample = [np.frombuffer(r["words"], np.uint32).reshape(-1, 2) for r in got]
    y = np.array([r["y"] for r in got], dtype=int)
    del got
    if len(y) and y.max() == 1:
        y = dose_grades(sample, y > 0, grades)
    return fit_hashes(sample, y, bits=bits)


def _cut(rows: int, n: int) -> int:
    return int(min(1.0, rows / max(1, n)) * (1 << 40))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``severity`` (expected grade, double), ``grade`` (the number
    of thresholds passed with probability above one half) and ``toxic_prob``
    (of grade 1 or more); ``toxic`` is whether that is at least ``threshold``.

    One map over the rows, no shuffle; the model is 2^bits numbers.  Null and
    empty texts, and texts without letters, have no feature, severity 0, grade
    0, and are not toxic.  Whole texts are read.  Input columns of the four
    names are replaced, all others and repeated rows are kept.
    """
    docs = docs.drop("severity", "grade", "toxic_prob", "toxic")
    schema, work = docs.schema, unused(docs, "_tox_text")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = len(model.weights).bit_length() - 1
        known: dict[str, float] = {}
        for b in batches:
            z = np.zeros(len(b))
            none = np.zeros(len(b), dtype=bool)
            for k, text in enumerate(b[work]):
                ws = words(text)
                none[k] = not ws
                total = 0.0
                for w in sorted(ws):
                    s = known.get(w)
                    if s is None:
                        s = float(model.weights[features(w, bits)].sum())
                        if len(known) >= 300_000:
                            known.clear()
                        known[w] = s
                    total += s
                z[k] = total
            p = _above(z, model.thresholds)
            p[none] = 0.0
            b["severity"], b["grade"], b["toxic_prob"] = p.sum(axis=1), (p > 0.5).sum(axis=1).astype(np.int32), p[:, 0]
            yield b.drop(columns=work)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = docs.withColumn(work, docs[text_col].cast("string")).mapInPandas(
        run, f"{fields}, severity double, grade int, toxic_prob double")
    return out.withColumn("toxic", F.col("toxic_prob") >= threshold)
