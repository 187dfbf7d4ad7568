"""Operator 7: order-preserving packing of documents into token windows.

The documents of a partition are one stream of ids, each document closed by an
end id.  A stream is cut into windows of at most ``window`` ids; where to cut is
a shortest path over candidate positions, found by dynamic programming:

    cost(j) = min over i with p_j - p_i <= window of
              cost(i) + (window - (p_j - p_i)) + penalty(j)

that is padding plus a truncation penalty: none at a document's end, a small
one at a sentence's end, a larger one inside a sentence (where candidates stand
every ``grid`` ids, so that any text can be cut).  With G(j) = cost(j) + p_j the
transition is G(j) = window + penalty(j) + min G(i), a sliding-window minimum
kept in a monotone queue: each candidate enters and leaves it once.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.bpe import encoder

SCHEMA = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids array<long>")


def cut_points(length: int, document_ends: np.ndarray, sentence_ends: np.ndarray, window: int = 2048,
               sentence_penalty: int = 8, token_penalty: int = 24, grid: int = 32, last: bool = True) -> list[int]:
    """Window ends of least padding and truncation for a stream of ``length``
    ids; if the stream goes on (not ``last``), the end of the cheapest path that
    leaves less than a window open."""
    if length == 0:
        return []
    own = np.union1d(np.union1d(document_ends, sentence_ends), [length])
    own = own[(own > 0) & (own <= length)]
    gaps = np.diff(own, prepend=0)
    wide = np.flatnonzero(gaps > grid)
    extra = [np.arange(own[k] - gaps[k] + grid, own[k], grid) for k in wide]
    at = np.unique(np.concatenate([own, *extra]))
    penalty = np.full(len(at), token_penalty)
    penalty[np.isin(at, sentence_ends)] = sentence_penalty
    penalty[np.isin(at, document_ends)] = 0
    penalty[-1] = 0
    p, g, back = [0, *at.tolist()], [0], [0]
    queue = deque([0])
    for j, own_penalty in enumerate(penalty.tolist(), 1):
        low = p[j] - window
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        total = g[i] + window + own_penalty
        g.append(total)
        back.append(i)
        while queue and g[queue[-1]] > total:
            queue.pop()
        queue.append(j)
    ends, j = [], len(p) - 1
    if not last:
        j = min((k for k in range(len(p)) if p[k] > length - window), key=lambda k: (g[k] - p[k], -k))
    while j:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


class _Stream:
    """Documents of one partition, in order; ``flush`` cuts what has gathered."""

    def __init__(self, ends_sentence: np.ndarray, first_id: int, plan: dict, with_ids: bool):
        self.ends_sentence, self.plan, self.with_ids = ends_sentence, plan, with_ids
        self.next_id = first_id
        self.docs: list[tuple[object, int, int, np.ndarray]] = []  # id, ids already out, all ids, ids left
        self.size = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)

    def flush(self, last: bool) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                 "offset", "ids")}
        ids = np.concatenate([d[3] for d in self.docs]) if self.docs else np.zeros(0, np.uint32)
        bounds = np.cumsum([len(d[3]) for d in self.docs])
        ends = cut_points(len(ids), bounds, np.flatnonzero(self.ends_sentence[ids]) + 1, last=last,
                          **self.plan)
        k, at = 0, 0
        for end in ends:
            offset = 0
            while at < end:
                doc_id, out_before, total, own = self.docs[k]
                begin = int(bounds[k]) - len(own)
                stop = min(end, int(bounds[k]))
                piece = own[at - begin:stop - begin]
                row = (doc_id, out_before + at - begin, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total,
                       self.next_id, offset, piece.tolist() if self.with_ids else None)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
                offset += len(piece)
                at = stop
                if stop == bounds[k]:
                    k += 1
            self.next_id += 1
        left = self.docs[k:]
        if left:
            doc_id, out_before, total, own = left[0]
            done = at - (int(bounds[k]) - len(own))
            left[0] = (doc_id, out_before + done, total, own[done:])
        self.docs, self.size = left, sum(len(d[3]) for d in left)
        return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
         end_id: int = 1, order_by: Sequence[str | Column] = (), block_tokens: int = 1 << 20, with_ids: bool = True,
         sentence_penalty: int = 8, token_penalty: int = 24, grid: int = 32) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids.

    Order is that of the stored rows, or with ``order_by`` a global one (range
    partitions, sorted inside).  Every partition is one stream, cut block by
    block: only ``block_tokens`` ids and one document are in memory, the open
    window is carried on, and only a partition's last window may be left short.
    Without ``order_by`` there is no shuffle.  Sequence ids are the partition's
    number shifted by 33 bits plus a counter.

    A null or empty text is the end id alone.  Repeated rows and null ids are
    packed like any other row, very long texts over many windows; an empty
    table gives no rows; other columns are only read if ``order_by`` names them.

    Returns one row per piece: ``(<id_col>, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, ids)``, ``ids`` null unless ``with_ids``.
    """
    plan = {"window": window, "sentence_penalty": sentence_penalty, "token_penalty": token_penalty, "grid": grid}

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        size = 1 + max([end_id, *enc.vocab.values(), *enc.special.values()])
        closes = np.zeros(size, dtype=bool)
        closes[[i for n, i in enc.vocab.items() if enc.bytes_of[n][-1:] in (b".", b"!", b"?", b"\n")]] = True
        s = _Stream(closes, TaskContext.get().partitionId() << 33, plan, with_ids)
        for b in batches:
            for doc_id, text in zip(b["id"], b["text"], strict=True):
                s.add(doc_id, np.append(enc.ids(text), np.uint32(end_id)))
                if s.size >= block_tokens and (out := s.flush(last=False))["id"]:
                    yield pd.DataFrame(out)
        if (out := s.flush(last=True))["id"]:
            yield pd.DataFrame(out)

    rows = docs
    if order_by:
        rows = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(stream, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
