"""Word shingles of whole texts as sorted sets of 64-bit hashes, by numpy.

Two different shingles share a hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: White space of the word pattern: space, tab, LF, VT, FF, CR.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, at least ``n`` of them."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * _CHUNK)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 2 * _CHUNK:
            _powers[name] = have
    return have


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of the words of ``data``, which ends with a blank."""
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * _power(len(data), _BASE, "up")[:len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * _power(len(data), _BACK, "down")[start]
    return start, mix(h + (end - start).astype(np.uint64))


def shingle_sets(texts: Sequence[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """For every text, the sorted distinct hashes of its ``k``-word shingles:
    the whole sequence as one shingle if it has fewer words, none without words.
    Texts are hashed together in chunks; a long text is a chunk of its own."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        chunk.append(b)
        size += len(b) + 1
        if size >= _CHUNK:
            yield from _sets(chunk, k)
            chunk, size = [], 0
    yield from _sets(chunk, k)


def _sets(chunk: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not chunk:
        return
    start, h = _words(np.frombuffer(b"\n".join(chunk) + b"\n", dtype=np.uint8))
    ends = np.cumsum([len(b) + 1 for b in chunk])
    upto = np.searchsorted(start, ends)  # words before the end of each text
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        s = s * _STEP + h[j:j + n]
    s = mix(s)
    lo = 0
    for hi in upto.tolist():
        if hi - lo >= k:
            yield np.unique(s[lo:hi - k + 1])
        elif hi > lo:
            one = np.full(1, hi - lo, dtype=np.uint64)
            for x in h[lo:hi]:
                one = one * _STEP + x
            yield mix(one)
        else:
            yield np.zeros(0, dtype=np.uint64)
        lo = hi
