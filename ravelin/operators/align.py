"""Optimal one-to-one alignment of answer spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def assignment(gain: np.ndarray) -> np.ndarray:
    """The column given to each row so that the gain's sum is largest (rows <= columns), by augmenting paths with potentials."""
    n, m = gain.shape
    cost = gain.max() - gain if gain.size else gain
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reach = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reach < slack[free]
            slack[free[better]], way[free[better]] = reach[better], j0
            j1 = free[np.argmin(slack[free])]
            delta = slack[j1]
            u[owner[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _f1(gold: set, pred: set) -> float:
    hit = len(gold & pred)
    p, r = (hit / len(pred) if pred else 1.0), (hit / len(gold) if gold else 1.0)
    return 2 * p * r / (p + r) if p + r else 0.0


def _numbers(bag: set) -> set:
    out = set()
    for x in bag:
        try:
            out.add(float(x))
        except ValueError:
            pass
    return out


def bags_f1(gold: list[set], pred: list[set], gate: bool = False) -> float:
    """Mean F1 of the best alignment over the larger number of spans; with gate, numbers of a gold span must be met."""
    if not gold and not pred:
        return 1.0
    if not gold or not pred:
        return 0.0
    gain = np.array([[0.0 if gate and _numbers(g) and not _numbers(g) & _numbers(p) else _f1(g, p) for p in pred] for g in gold])
    gain = gain if len(gold) <= len(pred) else gain.T
    return float(gain[np.arange(len(gain)), assignment(gain)].sum() / max(len(gold), len(pred)))


def aligned_f1(gold: Column, pred: Column, gate: bool = False) -> Column:
    """gold and pred: arrays of token arrays."""

    @F.pandas_udf("double")
    def score(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([bags_f1([set(x) for x in a], [set(x) for x in b], gate) for a, b in zip(g, p)])

    return score(gold, pred)
