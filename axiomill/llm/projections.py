"""What stable projections with a chi-square stopping test would cost for problem 4: a measurement.

The method: vectors of length 1 are projected on ``m`` random directions of a normal distribution. For
vectors at distance d the squared distance of their projections is d² times a chi-square variable of m
degrees. A query takes vectors in the order of projected distance and verifies each; it stops when the
next one, at projected distance t, is further away than the k-th best so far (or than the limit of
similarity) with the stated confidence: P(chi-square_m <= t² / d²) >= confidence.

:func:`measured` counts how many vectors a query verifies until then, and what it finds, against brute
force. It isn't part of any query; ``python -m axiomill.llm.projections DIR`` prints the table that the
README quotes (of a bounded sample of queries, against all rows of a test set).
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np


def chi_square_cdf(x: float, m: int) -> float:
    """P(chi-square with ``m`` degrees of freedom <= x)."""
    if x <= 0:
        return 0.0
    a, h = m / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < p else (low, middle)
    return high


@dataclass(frozen=True)
class Measured:
    """``recall`` of the neighbours, and the mean number of vectors verified by queries that have a
    neighbour above the limit and by those that have none."""

    recall: float
    with_neighbour: float
    without: float
    share_without: float


def measured(lists: list[set], queries: list[int], m: int, confidence: float, k: int = 5, limit: float = 0.25, seed: int = 1) -> Measured:
    """The cost and recall of ``queries`` (places in ``lists``, sets of ids) for the k nearest others of
    squared cosine >= ``limit``. Empty sets are neither queries nor found."""
    rng = np.random.default_rng(seed)
    ids, flat = np.unique(np.array([x for s in lists for x in s]), return_inverse=True)
    sizes = np.array([len(s) for s in lists])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    directions = rng.standard_normal((len(ids), m))
    points = np.zeros((len(lists), m))
    np.add.at(points, np.repeat(np.arange(len(lists)), sizes), directions[flat])
    points /= np.sqrt(np.maximum(sizes, 1))[:, None]
    posted = np.argsort(flat, kind="stable")
    rows, ends = np.repeat(np.arange(len(lists)), sizes)[posted], np.concatenate([[0], np.cumsum(np.bincount(flat))])
    bound, furthest = chi_square_quantile(confidence, m), 2 - 2 * math.sqrt(limit)
    found = wanted = 0
    verified: dict[bool, list[int]] = {True: [], False: []}
    for q in queries:
        if not sizes[q]:
            continue
        shared = np.zeros(len(lists), "int64")
        for v in flat[starts[q] : starts[q + 1]]:
            shared[rows[ends[v] : ends[v + 1]]] += 1
        cosine2 = shared**2 / np.maximum(sizes * sizes[q], 1)
        cosine2[q] = -1
        best = np.lexsort((np.arange(len(lists)), -cosine2))[:k]
        true = {int(i) for i in best if cosine2[i] >= limit}
        distance2 = 2 - 2 * np.sqrt(np.maximum(cosine2, 0))
        projected2 = ((points - points[q]) ** 2).sum(axis=1)
        projected2[q] = np.inf
        order = np.argsort(projected2, kind="stable")
        # The k-th best so far; until k are above the limit, the limit itself.
        nearest: list[float] = []
        seen = 0
        for i in order:
            d2 = min(furthest, nearest[k - 1] if len(nearest) >= k else furthest)
            if projected2[i] > bound * d2:
                break
            seen += 1
            if distance2[i] <= furthest + 1e-12:
                nearest = sorted([*nearest, float(distance2[i])])[:k]
        got = {int(i) for i in order[:seen]}
        found, wanted = found + len(true & got), wanted + len(true)
        verified[bool(true)].append(seen)
    some, none = (float(np.mean(v)) if v else 0.0 for v in (verified[True], verified[False]))
    return Measured(found / max(wanted, 1), some, none, len(verified[False]) / max(1, sum(map(len, verified.values()))))


def main(folder: str) -> None:
    import pyarrow.parquet as pq

    for table, column in (("thmconceptstb", "thmconcepts"), ("similarthmstb", "similarthms")):
        values = pq.read_table(f"{folder}/{table}.parquet", columns=[column])[column].to_pylist()
        lists = [set(v) for v in {frozenset(x for x in v if x is not None) for v in values if v} if v]
        lists.sort(key=sorted)
        queries = np.random.default_rng(2).choice(len(lists), min(400, len(lists)), replace=False).tolist()
        for m in (8, 16, 32, 64):
            r = measured(lists, queries, m, 0.9)
            print(f"{column}: {len(lists)} lists, {m} projections: recall {r.recall:.3f}, verified {r.with_neighbour:.0f} (with a neighbour), {r.without:.0f} (the {r.share_without:.0%} without)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
