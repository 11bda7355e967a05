"""The string kernels over many pairs at once, in numpy: the same scores as those of ``kernels``, operation by operation.

Pairs of ASCII texts of at most 64 characters go through numpy, a character's places in the other text being bits of
one word; longer ones and those with other characters go through the plain kernels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from concord.functions import kernels

#: characters that fit the bits of a word
WIDTH = 64
#: pairs worked on at a time, so that the matrices of one block stay in the cache
BLOCK = 4096
_BELOW = np.array([(1 << n) - 1 for n in range(WIDTH + 1)], dtype=np.uint64)
_NO_ABBREVIATION = frozenset(kernels.ABBREVIATIONS).isdisjoint


def _plain(s: str) -> bool:
    return len(s) <= WIDTH and s.isascii() and "\0" not in s


class _Texts:
    """Distinct texts as rows of a matrix of bytes."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.chars = np.array(texts, dtype=f"S{WIDTH}").view(np.uint8).reshape(len(texts), WIDTH)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))


def _pairwise(a: Sequence[str], b: Sequence[str], many: Callable, one: Callable[[str, str], float], fits: Callable[[str], bool] = _plain) -> np.ndarray:
    """``many`` over blocks of the pairs of which both texts fit, ``one`` for each other pair."""
    out = np.zeros(len(a))
    place: dict[str, int] = {}
    x, y, at = [], [], []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        if fits(s) and fits(t):
            x.append(place.setdefault(s, len(place)))
            y.append(place.setdefault(t, len(place)))
            at.append(i)
        else:
            out[i] = one(s, t)
    if at:
        texts, x, y, at = _Texts(list(place)), np.array(x), np.array(y), np.array(at)
        for k in range(0, len(at), BLOCK):
            out[at[k : k + BLOCK]] = many(texts, x[k : k + BLOCK], y[k : k + BLOCK])
    return out


def _jaro_winkler(texts: _Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n, m = texts.sizes[x], texts.sizes[y]
    wide, tall = int(n.max(initial=0)), int(m.max(initial=0))
    # a multiple of eight columns, to be packed into bytes
    a, b = texts.chars[x, : max(wide, 1)], texts.chars[y]
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    taken, left = np.zeros(len(x), np.uint64), np.zeros(a.shape, bool)
    for i in range(wide):
        found = np.packbits(b == a[:, i : i + 1], axis=1, bitorder="little").view("<u8")[:, 0]
        lo, hi = np.clip(i - reach, 0, WIDTH), np.clip(np.minimum(m, i + reach + 1), 0, WIDTH)
        found = found & _BELOW[hi] & ~_BELOW[lo] & ~taken
        found[n <= i] = 0
        first = found & (~found + np.uint64(1))
        taken |= first
        left[:, i] = first != 0
    right = np.unpackbits(taken.astype("<u8").view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little").astype(bool)
    same = left.sum(axis=1)
    row = np.repeat(np.arange(len(x)), same)
    moved = np.bincount(row[a[left] != b[right]], minlength=len(x)) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(same > 0, (same / n + same / m + (same - moved) / same) / 3, 0.0)
    head = (a[:, :4] == b[:, : min(4, a.shape[1])]) & (np.arange(min(4, a.shape[1])) < np.minimum(n, m)[:, None])
    bonus = np.where(jaro <= 0.7, 0.0, np.cumprod(head, axis=1).sum(axis=1) * 0.1 * (1 - jaro))
    return np.where((x == y) & (n > 0), 1.0, jaro + bonus)


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _pairwise(a, b, _jaro_winkler, kernels.jaro_winkler)


def _grams(texts: _Texts, rows: np.ndarray, none: int) -> np.ndarray:
    c, n = texts.chars[rows].astype(np.int32), texts.sizes[rows]
    c = c[:, : int(n.max(initial=3))]
    g = c[:, :-2] << 16 | c[:, 1:-1] << 8 | c[:, 2:]
    g[np.arange(g.shape[1]) >= (n - 2)[:, None]] = none
    return g


def _shared(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many places of ``g`` and of ``h`` hold the same gram: the scalar product of the counts."""
    out = np.zeros(len(g), np.int64)
    for i in range(g.shape[1]):
        out += np.count_nonzero(h == g[:, i : i + 1], axis=1)
    return out


def _trigram_cosine(texts: _Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    g, h = _grams(texts, x, -1), _grams(texts, y, -2)
    used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    norms = np.sqrt(_shared(_grams(texts, used, -1), _grams(texts, used, -2)))[back]
    return _shared(g, h) / (norms[: len(x)] * norms[len(x) :])


def trigram_cosine(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return _pairwise([s.upper() for s in a], [s.upper() for s in b], _trigram_cosine, kernels.trigram_cosine, lambda s: len(s) > 2 and _plain(s))


def _rounded(values: np.ndarray) -> list[float]:
    """To four digits as Python rounds, which numpy does not quite."""
    return [round(v, 4) for v in values.tolist()]


def route_names(a: Sequence[str], b: Sequence[str]) -> list[tuple[float, str, tuple[str, ...]]]:
    """``kernels.route_name`` and ``kernels.select_name`` of many pairs of names."""
    out: list = [None] * len(a)
    once: dict = {}
    texts: dict[str, tuple[str, bool]] = {}
    todo: dict[tuple[str, str], list[int]] = {}
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        for v in (s, t):
            if v not in texts:
                u = v.upper().strip()
                texts[v] = u, _NO_ABBREVIATION(u.split())
        (x, bare), (y, plain) = texts[s], texts[t]
        n, m = len(x), len(y)
        longest = max(n, m)
        if bare and plain and longest > 20 and min(n, m) / longest >= 0.6:
            if x == y:
                out[i] = 1.0, "NAME_JW", ("NAME_JW", "NAME_NGR")
            else:
                todo.setdefault((x, y), []).append(i)
        else:
            if (s, t) not in once:
                once[s, t] = (*kernels.route_name(s, t), kernels.select_name(s, t))
            out[i] = once[s, t]
    if todo:
        x, y = zip(*todo, strict=True)
        for rows, jw, ngr in zip(todo.values(), _rounded(jaro_winkler(x, y)), _rounded(trigram_cosine(x, y)), strict=True):
            for i in rows:
                out[i] = (jw, "NAME_JW", ("NAME_JW", "NAME_NGR")) if jw >= ngr else (ngr, "NAME_NGR", ("NAME_JW", "NAME_NGR"))
    return out


def route_addresses(a: Sequence[str], b: Sequence[str]) -> list[tuple[float, str, tuple[str, ...]]]:
    """``kernels.route_address`` and ``kernels.select_address`` of many pairs of addresses."""
    out: list = [None] * len(a)
    numbered: dict[str, bool] = {}
    todo: dict[tuple[str, str], list[int]] = {}
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        for v in (s, t):
            if v not in numbered:
                numbered[v] = any(c.isdigit() for c in v[:10])
        if numbered[s] and numbered[t]:
            todo.setdefault((s, t), []).append(i)
        else:
            out[i] = (*kernels.route_address(s, t), kernels.select_address(s, t))
    if todo:
        used = {v for pair in todo for v in pair}
        parts, whole = {v: kernels._parts(v) for v in used}, {v: kernels.postal(v) for v in used}
        ends = [[[parts[p[k]][j] for p in todo] for k in (0, 1)] for j in (0, 1)]
        number, street = (jaro_winkler(*e) for e in ends)
        both = [np.array([bool(s and t) for s, t in zip(*e, strict=True)]) for e in ends]
        weight = [np.where(x, 0.3, 0.0) for x in both]
        total = weight[0] + weight[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            cmp = np.where(total > 0, (np.where(both[0], 0.3 * number, 0.0) + np.where(both[1], 0.3 * street, 0.0)) / total, 0.0)
        x, y = ([whole[p[k]] for p in todo] for k in (0, 1))
        nrm = np.where([s == t for s, t in zip(x, y, strict=True)], 1.0, jaro_winkler(x, y))
        for rows, c, n in zip(todo.values(), _rounded(cmp), _rounded(nrm), strict=True):
            for i in rows:
                out[i] = (c, "ADDR_CMP", ("ADDR_CMP", "ADDR_NRM")) if c >= n else (n, "ADDR_NRM", ("ADDR_CMP", "ADDR_NRM"))
    return out
