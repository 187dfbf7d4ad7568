"""Signatures of the universe-partition pigeonhole.

Two sets of sizes a and b have Jaccard p/q or more exactly if their symmetric
difference is at most H = floor((q - p)(a + b) / (q + p)).  The universe of
tokens is hashed into m segments (a scheme per size band), and a difference
spoils at most one segment.  So of any H + 1 segments at least one is equal in
both sets.

Allocation.  An empty segment equals too many others, so it gets nothing, and a
set takes its first H + 1 segments that are not empty, H for its largest
possible partner in the scheme.  Of two sets, that with the shorter prefix has
an equal segment in it that the other takes as well.  A set with too few
non-empty segments takes them all, and if the partner does too, they still meet:
both also index the one-deletion neighbourhoods (the segment without any one of
its tokens), which makes a segment of two tokens or more worth two differences;
and if that does not add up to H + 1, both index their empty segments too.  The
number of segments is the cheapest that leaves such sets rare: each segment
fewer makes the taken ones longer, and so rarer among unlinked sets.
"""

from __future__ import annotations

import numpy as np

from sigframe.llm.shingles import mix


def schemes(size: int, p: int, q: int) -> list[int]:
    """Bands (powers of two) in which a set of ``size`` can meet a partner: its
    own, and the next if a larger partner can be there."""
    own = size.bit_length() - 1
    return [own, own + 1] if size * q // p >= 2 << own else [own]


def need(size: int, band: int, p: int, q: int) -> int:
    """H + 1 for the largest partner of a set of ``size`` in ``band``."""
    largest = min(size * q // p, (2 << band) - 1)
    return (q - p) * (size + largest) // (q + p) + 1


def segments(band: int, p: int, q: int) -> int:
    top = (2 << band) - 1
    return int(1.1 * need(top, band, p, q)) + 3


def signatures(tokens: np.ndarray, p: int, q: int) -> np.ndarray:
    """Signatures (64-bit) of one sorted set of token hashes."""
    size = len(tokens)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    return np.concatenate([_of_scheme(tokens, b, p, q) for b in schemes(size, p, q)])


def _of_scheme(tokens: np.ndarray, band: int, p: int, q: int) -> np.ndarray:
    m, wanted = segments(band, p, q), need(len(tokens), band, p, q)
    h = mix(tokens + np.uint64(band + 1))
    seg = (h >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], mix(tokens[order] ^ np.uint64(0x5DEECE66D))
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    own, sums = seg[first], np.add.reduceat(value, first)
    tag = np.uint64(band) << np.uint64(32)

    def signed(which: np.ndarray, total: np.ndarray) -> np.ndarray:
        return mix(total + mix(tag | which))

    if len(own) >= wanted:
        return signed(own[:wanted], sums[:wanted])
    counts = np.diff(first, append=len(seg))
    less = np.repeat(sums, counts) - value
    out = [signed(own, sums), signed(seg, less)[np.repeat(counts, counts) > 1]]
    if 2 * int((counts > 1).sum()) + int((counts == 1).sum()) < wanted:
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), own)
        out.append(signed(empty, np.zeros(len(empty), dtype=np.uint64)))
    return np.concatenate(out)
