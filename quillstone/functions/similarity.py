"""String similarities: Arrow functions over pairs of columns, and token sets as column expressions.

Scales are 0 to 100, Jaro-Winkler 0 to 1. Nulls count as empty texts. Two empty texts are equal for ratio(), and 0 for
token_set().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillstone.functions import batches


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel on integers (Hyyro, 2004)."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(filter(None, [both, " ".join(sorted(d))])) for d in (x - y, y - x))
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0,)))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, windows over its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), 0.0
    for s in range(1 - n, len(b)):
        best = max(best, ratio(a, b[max(s, 0) : s + n]))
        if best == 100.0:
            break
    return best


def jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, own = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                own.append(c)
                break
    m = len(own)
    if not m:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    t = sum(x != y for x, y in zip(own, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def numbered(f, many, longest=batches.LONGEST):
    """A function of distinct texts and two arrays of their numbers: the pairs' values, computed all together, and those
    with a text of more than `longest` characters by f."""

    def run(texts: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        fits = np.fromiter((len(t) <= longest for t in texts), bool, len(texts))
        short, found = fits[x] & fits[y], np.empty(len(x))
        if short.any():
            held = np.cumsum(fits) - 1  # numbers of the texts that fit, among these
            found[short] = many([t for t, ok in zip(texts, fits, strict=True) if ok], held[x[short]], held[y[short]])
        for k in np.flatnonzero(~short):
            found[k] = f(texts[x[k]], texts[y[k]])
        return found

    return run


def _pairwise(values):
    """An Arrow function over two columns; a batch computes its distinct pairs once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        ids: dict[str, int] = {}
        at = np.fromiter((ids.setdefault(t, len(ids)) for column in (a, b) for t in column.fillna("")), np.int64, 2 * len(a))
        texts = list(ids)
        pairs, back = np.unique(at[: len(a)] * len(texts) + at[len(a) :], return_inverse=True)
        return pd.Series(values(texts, pairs // len(texts), pairs % len(texts))[back])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


ratios, token_sorts, token_sets, partials = (numbered(f, many) for f, many in ((ratio, batches.ratios), (token_sort, batches.token_sorts), (token_set, batches.token_sets), (partial, batches.partials)))
sim_ratio, sim_token_sort, sim_token_set, sim_partial = map(_pairwise, (ratios, token_sorts, token_sets, partials))
sim_jaro_winkler = _pairwise(numbered(jaro_winkler, batches.jaro_winklers, 64))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)
