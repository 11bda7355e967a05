"""Vectorised words and shingles: hashes of all words of many texts at once, in numpy.

Words are the runs between ASCII white space after A-Z are lower-cased. A word's hash is a polynomial of
random byte values modulo 2^64, made independent of its place by the inverse power, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        base = np.full(n, _R, np.uint64)
        base[0] = 1
        back = np.full(n, _RINV, np.uint64)
        back[0] = 1
        _pow, _inv = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[bytes], size: int = 500_000) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive texts of about ``size`` bytes together."""
    first = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[bytes], separators: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(hash, start, end, counts, prefix hashes): the words of all texts in order, and the number of words of each text.

    start and end are bytes of the texts joined by one byte, from 1. A prefix hash is 0 for shorter words.
    """
    buf = b"\n" + b"\n".join(texts).lower() + b"\n"
    a = np.frombuffer(buf, np.uint8)
    space = separators[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    p, q = _powers(len(a))
    heads = []
    if len(start):
        sums = np.cumsum(_BYTE[a] * p[: len(a)], dtype=np.uint64)
        before = sums[start - 1]
        h = mix((sums[end - 1] - before) * q[start])
        for k in prefixes:
            x = mix((sums[np.minimum(start + k, end) - 1] - before) * q[start] + np.uint64(k))
            x[end - start < k] = 0
            heads.append(x)
    else:
        h = np.zeros(0, np.uint64)
        heads = [h for _ in prefixes]
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = np.searchsorted(start, ends + 1)
    counts = np.diff(np.concatenate([[0], at]))
    return h, start, end, counts, heads


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of fewer words the whole sequence; without words none."""
    h, _, _, counts, _ = words(texts)
    s = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        s = mix(s * np.uint64(_R) + h[j : len(h) - n + 1 + j] + np.uint64(j)) if len(s) else s
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            x = np.sort(s[at : at + c - n + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        elif c:
            whole = np.uint64(c)
            for v in h[at : at + c]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(_R) + v)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
