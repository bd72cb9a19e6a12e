"""The similarities of similarity.py for many pairs at once, on numpy arrays; the results are the same to the last bit.

Texts are rows of dense character codes, 0 behind their ends, which matches nothing. Pairs are row numbers of both texts.
"""

from __future__ import annotations

import numpy as np

LONGEST = 256  # of texts that are compared here
CELLS = 1 << 21  # of a table of bit masks, 16 MB
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes, lengths, and the code of a blank (0 if there is none)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(lengths.max(initial=0)))
    points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    inside = np.arange(width) < lengths[:, None]
    lut = np.zeros(max(33, int(points.max(initial=0)) + 1), np.int32)
    lut[points[inside]] = 1
    lut[lut > 0] = np.arange(1, int(lut.sum()) + 1)
    return np.where(inside, lut[points], 0), lengths, int(lut[32])


def _table(codes: np.ndarray, size: int) -> np.ndarray:
    """For each 64 characters, text and code: the bits of the positions with that code."""
    words = -(-codes.shape[1] // 64)
    table = np.zeros((words, len(codes) * size), np.uint64)
    first = np.arange(len(codes)) * size
    for i in range(codes.shape[1]):
        table[i >> 6, first + codes[:, i]] |= np.uint64(1 << (i & 63))
    table[:, first] = 0
    return table


def common_lengths(codes: np.ndarray, a: np.ndarray, other: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of codes[a] and the rows of other, which end at `ends` (Hyyro, 2004). keep:
    bits of the positions of codes[a] that count."""
    words, size = -(-codes.shape[1] // 64), int(max(codes.max(initial=0), other.max(initial=0))) + 1
    out = np.zeros(len(a), np.int64)
    order = np.argsort(-ends, kind="stable")
    step = max(1, CELLS // (size * words))
    for at in range(0, len(a), step):
        rows = order[at : at + step]
        own, place = np.unique(a[rows], return_inverse=True)
        table = _table(codes[own], size)
        first, theirs, kept = place * size, np.ascontiguousarray(other[rows].T), None if keep is None else keep[rows].T.copy()
        active = np.searchsorted(-ends[rows], -np.arange(len(theirs)), side="left")  # rows whose text is longer than j
        v = np.full((words, len(rows)), ONES)
        for j, n in enumerate(active):
            if n == 0:
                break
            here, carry = first[:n] + theirs[j, :n], None
            for w in range(words):
                held = v[w, :n]
                u = held & table[w].take(here)
                if kept is not None:
                    u &= kept[w, :n]
                s = held + u
                if words > 1:
                    over = s < u
                    if carry is not None:
                        s += carry
                        over |= s < carry
                    carry = over.astype(np.uint64)
                s |= held - u
                v[w, :n] = s
        out[rows] = 64 * words - np.bitwise_count(v).sum(axis=0, dtype=np.int64)
    return out


def _share(common: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.divide(200.0 * common, length, out=np.full(len(length), 100.0), where=length > 0)


def ratios(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    codes, n, _ = encode(texts)
    a, b = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
    out = np.empty(len(a))
    for low in range(0, LONGEST, 64):  # texts of as many words of 64 bits together
        rows = np.flatnonzero((n[a] > low if low else True) & (n[a] <= low + 64))
        if len(rows):
            out[rows] = _share(common_lengths(codes[:, : low + 64], a[rows], codes[b[rows]], n[b[rows]]), n[a[rows]] + n[b[rows]])
    return out


def token_sorts(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ratios([" ".join(sorted(t.split())) for t in texts], a, b)


def token_sets(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A text's words are followed by a blank each; words that both have are masked, and counted as a common beginning."""
    words = [sorted(set(t.split())) for t in texts]
    codes, _, blank = encode([" ".join([*w, ""]) for w in words])
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 64)))
    most = max(1, *map(len, words))
    ids, sizes = {}, np.zeros((len(texts), most), np.int64)
    numbers = np.zeros((len(texts), most), np.int64)
    for i, w in enumerate(words):
        numbers[i, : len(w)] = [ids.setdefault(t, len(ids) + 1) for t in w]
        sizes[i, : len(w)] = list(map(len, w))
    n = np.fromiter(map(len, words), np.int64, len(words))
    length = sizes.sum(axis=1) + np.maximum(n - 1, 0)
    of = np.minimum(np.cumsum(codes == blank, axis=1) - (codes == blank), most - 1)  # the word that a character belongs to
    out = np.empty(len(a))
    for at in range(0, len(a), 4096):
        i, j = a[at : at + 4096], b[at : at + 4096]
        x, y = numbers[i], numbers[j]
        in_x, in_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for k in range(int(n[j].max())):
            same = (x == y[:, k : k + 1]) & (y[:, k : k + 1] > 0)
            in_x |= same
            in_y[:, k] = same.any(axis=1)
        shared = in_x.sum(axis=1)
        both = (sizes[i] * in_x).sum(axis=1) + np.maximum(shared - 1, 0)
        mine = ~np.take_along_axis(in_x, of[i], axis=1)
        theirs = np.where(np.take_along_axis(in_y, of[j], axis=1), 0, codes[j])
        keep = np.packbits(mine, axis=1, bitorder="little").view(np.uint64)
        rest = common_lengths(codes, i, theirs, length[j] + 1, keep) - 1
        value = _share(np.maximum(rest, 0) + np.where(shared > 0, both + 1, 0), length[i] + length[j])
        for side in (i, j):
            value = np.where(shared > 0, np.maximum(value, _share(both, both + length[side])), value)
        value[(shared > 0) & ((shared == n[i]) | (shared == n[j]))] = 100.0
        value[(n[i] == 0) | (n[j] == 0)] = 0.0
        out[at : at + 4096] = value
    return out


def partials(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One pass over the cells of a pair gives, for each position of the longer text, where a window must begin at the
    latest not to count it; the common length of any window is then a count (Alves, Caceres and Song, 2008)."""
    codes, n, _ = encode(texts)
    a, b = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
    small = np.uint8 if max(int(codes.max(initial=0)) + 1, int(n.max(initial=0))) < 256 else np.uint16 if codes.max(initial=0) < 65535 else np.uint32
    out = np.where(n[a] > 0, 0.0, np.where(n[b] > 0, 0.0, 100.0))
    some = np.flatnonzero(n[a] > 0)
    some = some[np.lexsort((n[a][some], n[b][some]))]
    for at in range(0, len(some), 4096):
        rows = some[at : at + 4096]
        rows = rows[np.argsort(-n[a[rows]], kind="stable")]
        la, lb = n[a[rows]], n[b[rows]]
        m, width = int(la[0]), int(lb.max())
        longer = np.searchsorted(-la, -np.arange(m + 1), side="left")  # rows with la > i
        x, y = codes[a[rows], :m].T.astype(small, order="C"), codes[b[rows], :width].T.astype(small, order="C")
        x[x == 0] = np.iinfo(small).max  # ends of both texts differ
        h = np.repeat(np.arange(1, width + 1, dtype=small)[:, None], len(rows), axis=1)
        v, y, differ, top = np.zeros_like(x), y[::-1].copy(), np.empty(x.shape, bool), np.empty_like(x)
        h = h[::-1].copy()  # so that the cells of a diagonal are in the same order in both
        for d in range(m + width - 1):
            i0, i1 = max(0, d - width + 1), min(m, d + 1)
            j0 = width - 1 - d + i0
            own, cell, t, e = v[i0:i1], h[j0 : j0 + i1 - i0], top[: i1 - i0], differ[: i1 - i0]
            np.not_equal(x[i0:i1], y[j0 : j0 + i1 - i0], out=e)
            np.multiply(cell, e, out=t)
            np.maximum(t, own, out=t)
            np.bitwise_xor(own, cell, out=own)
            np.bitwise_xor(own, t, out=own)
            cell[:] = t
        h = h[::-1]
        best, common = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for j in range(min(m, width)):  # windows at the beginning, up to a whole one
            k = longer[j]
            common[:k] += h[j, :k] == 0
            np.maximum(best[:k], 200.0 * common[:k] / (la[:k] + j + 1), out=best[:k])
        begins = np.arange(width, dtype=small)[:, None]
        count, less = np.zeros(h.shape, small), np.empty(h.shape, bool)
        for o in range(min(m, width)):
            k = longer[o]
            np.less_equal(h[o:, :k], begins[: width - o], out=less[: width - o, :k])
            np.add(count[: width - o, :k], less[: width - o, :k], out=count[: width - o, :k], casting="unsafe")
        whole = np.where(begins <= lb - la, count, 0).max(axis=0)
        np.maximum(best, 200.0 * whole / (la + la), out=best)
        for left in range(1, m):  # windows at the end, of `left` characters
            k = longer[left]
            np.maximum(best[:k], 200.0 * count[lb[:k] - left, np.arange(k)] / (la[:k] + left), out=best[:k])
        out[rows] = best
    return out


def jaro_winklers(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Texts of at most 64 characters."""
    codes, n, _ = encode(texts)
    out = np.empty(len(a))
    size = int(codes.max(initial=0)) + 1
    for at in range(0, len(a), step := max(1, min(8192, CELLS // size))):
        i, j = a[at : at + step], b[at : at + step]
        la, lb = n[i], n[j]
        own, place = np.unique(j, return_inverse=True)
        table, first = _table(codes[own], size)[0], place * size
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        x, y = codes[i], codes[j]
        used, hit = np.zeros(len(i), np.uint64), np.zeros(x.shape, bool)
        for c in range(int(la.max(initial=0))):
            window = (ONES << np.maximum(c - reach, 0).astype(np.uint64)) & (ONES >> (63 - np.minimum(c + reach, 63)).astype(np.uint64))
            free = table.take(first + x[:, c]) & window & ~used
            lowest = free & (~free + np.uint64(1))
            used |= lowest
            hit[:, c] = lowest != 0
        taken = (used[:, None] >> np.arange(y.shape[1], dtype=np.uint64)) & np.uint64(1) > 0
        m = hit.sum(axis=1)
        in_order = lambda values, mask: np.take_along_axis(np.where(mask, values, 0), np.argsort(~mask, axis=1, kind="stable"), axis=1)
        t = (in_order(x, hit) != in_order(y, taken)).sum(axis=1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = (m / la + m / lb + (m - t) / m) / 3
        same = (x[:, :4] == y[:, :4]) & (x[:, :4] > 0)
        prefix = np.cumprod(same, axis=1).sum(axis=1)
        value = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        value[m == 0] = 0.0
        value[(la == 0) & (lb == 0)] = 1.0
        out[at : at + step] = value
    return out
