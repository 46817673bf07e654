"""Global alignment score over batches of pairs (inventory C16)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores of a match, a mismatch and a gap.
MATCH, MISMATCH, GAP = 1, -1, -1


# pairs whose diagonals are held at once; small enough for a core's cache
PAIRS = 2048


def _letters(words: np.ndarray, size: int) -> np.ndarray:
    """Letters of words of one length, one column per word."""
    text = "".join(words)
    kind, raw = (np.uint8, text.encode()) if text.isascii() else (np.uint32, text.encode("utf-32-le", "surrogatepass"))
    return np.ascontiguousarray(np.frombuffer(raw, kind).reshape(len(words), size).T)


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of pairs of one shape, the shorter word of each in ``x``.

    A cell (i, j) holds its score less (i + j) * GAP, so gaps count nothing and no cell is below 0. By
    diagonals: all cells of one depend on the two before it only. Cell (i, d - i) stands in row i.
    """
    (m, pairs), n = x.shape, len(y)
    unequal, equal = MISMATCH - 2 * GAP, MATCH - 2 * GAP
    kind = np.uint8 if equal * m <= 255 else np.int32
    y = y[::-1]
    before, last, now = (np.zeros((m + 1, pairs), kind) for _ in range(3))
    same, best = np.empty((m, pairs), bool), np.empty((m, pairs), kind)
    for d in range(2, m + n + 1):
        low, high = max(1, d - n), min(m, d - 1)
        size = high - low + 1
        step = np.equal(x[low - 1 : high], y[n - d + low : n - d + high + 1], out=same[:size]).view(np.uint8)
        cell = np.multiply(step, kind(equal - unequal), out=best[:size], casting="unsafe")
        cell += kind(unequal)
        cell += before[low - 1 : high]
        np.maximum(cell, last[low - 1 : high], out=cell)
        np.maximum(cell, last[low : high + 1], out=now[low : high + 1])
        now[0] = 0
        if d <= m:
            now[d] = 0
        before, last, now = last, now, before
    return last[m].astype(np.int64) + GAP * (m + n)


def align_scores(a: list[str], b: list[str]) -> np.ndarray:
    """Scores of many pairs at once: the recurrence runs on whole diagonals of ``PAIRS`` pairs of two lengths."""
    a, b = np.asarray(a, dtype=object), np.asarray(b, dtype=object)
    out = np.zeros(len(a), dtype=np.int64)
    la = np.fromiter(map(len, a), np.int64, len(a))
    lb = np.fromiter(map(len, b), np.int64, len(b))
    for m, n in set(zip(la.tolist(), lb.tolist())):
        rows = np.flatnonzero((la == m) & (lb == n))
        if m == 0 or n == 0:
            out[rows] = GAP * (m + n)
            continue
        for at in range(0, len(rows), PAIRS):
            part = rows[at : at + PAIRS]
            x, y = _letters(a[part], m), _letters(b[part], n)
            out[part] = _scores(y, x) if m > n else _scores(x, y)
    return out


@F.pandas_udf(T.LongType())
def needleman_wunsch(a: pd.Series, b: pd.Series) -> pd.Series:
    """C16. Global alignment score: match +1, mismatch -1, gap -1; null for a null side."""
    ok = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[ok] = align_scores(a[ok].tolist(), b[ok].tolist())
    return out
