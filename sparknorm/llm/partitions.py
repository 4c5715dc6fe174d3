"""Learned partitions of a vector space: a balanced cut of a neighbour graph and a classifier that follows it.

All of this is fitted on a bounded sample, in memory. The graph joins each
vector of the sample with its nearest ones; halving it again and again along
its slowest mode, with exchanges that cut fewer edges, gives parts of equal
size. A softmax classifier learns for each vector in which parts its neighbours
lie. Vectors set aside from fitting say how many of the most probable parts a
query has to visit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEIGHBOURS = 10  # of a vector in the graph
STEPS, EPOCHS, BATCH, RATE, PULL = 40, 30, 256, 0.02, 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(a: np.ndarray, b: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """Of each unit row of a the k nearest rows of b, itself left out where both are the same."""
    k = min(k, len(b) - same)
    out = np.empty((len(a), k), np.int64)
    for i in range(0, len(a), 512):
        s = a[i : i + 512] @ b.T
        if same:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), np.int64)
    return out


def halves(n: int, i: np.ndarray, j: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A side for each of n nodes, equally many but for one, with few edges (i, j) between the sides."""
    degree = np.maximum(np.bincount(i, minlength=n) + np.bincount(j, minlength=n), 1)

    def around(v: np.ndarray) -> np.ndarray:
        return np.bincount(i, v[j], n) + np.bincount(j, v[i], n)

    mode = rng.standard_normal(n)
    for _ in range(STEPS):  # a lazy walk; what stays longest is the graph's slowest mode
        mode = mode + around(mode) / degree
        mode -= (mode * degree).sum() / degree.sum()
        mode /= np.abs(mode).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        gain = np.where(side, -1, 1) * around(np.where(side, 1.0, -1.0))  # edges across less those inside
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        better = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2  # half of them: neighbours that change places together gain less
        if not better:
            break
        side[left[:better]], side[right[:better]] = True, False
    return side


def cut(links: np.ndarray, levels: int, rng: np.random.Generator) -> np.ndarray:
    """2 ** levels parts of the graph of each node's links."""
    n = len(links)
    i, j = np.repeat(np.arange(n), links.shape[1]), links.ravel()
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        new = np.empty(n, np.int64)
        place = np.empty(n, np.int64)
        inside = part[i] == part[j]
        by = np.argsort(part[i[inside]], kind="stable")
        ei, ej = i[inside][by], j[inside][by]
        bounds = np.searchsorted(part[ei], np.arange(part.max() + 2))
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            place[own] = np.arange(len(own))
            a, b = ei[bounds[p] : bounds[p + 1]], ej[bounds[p] : bounds[p + 1]]
            new[own] = 2 * p + halves(len(own), place[a], place[b], rng)
        part = new
    return part


@dataclass
class Router:
    """Weights of the classifier over parts, and how many parts a query visits."""

    weight: np.ndarray
    bias: np.ndarray
    visits: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias

    def part(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of unit rows."""
        return np.argmax(self.scores(x), axis=1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, : self.visits]


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on shares of parts, by Adam in small batches."""
    p = [np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            at = order[k : k + BATCH]
            s = x[at] @ p[0] + p[1]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            d = (s / s.sum(axis=1, keepdims=True) - target[at]) / len(at)
            t += 1
            rate = 5 * RATE * (1 - epoch / EPOCHS)
            for w, g, m1, v1 in zip(p, (x[at].T @ d + PULL * p[0], d.sum(axis=0)), m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.999**t)) + 1e-9)
    return p[0], p[1]


def fit(x: np.ndarray, levels: int, recall: float, k: int = 5, seed: int = 7) -> Router:
    """A router of 2 ** levels parts at most from unit rows; a third of them is set aside to find the number of visits."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, own = x[order[: len(x) // 3]], x[order[len(x) // 3 :]]
    levels = min(levels, max(0, int(np.log2(max(1, len(own) // 16)))))
    if not levels:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    links = nearest(own, own, NEIGHBOURS, same=True)
    part = cut(links, levels, rng)
    target = np.zeros((len(own), 1 << levels))
    np.add.at(target, (np.arange(len(own))[:, None], part[links]), 0.5 / links.shape[1])
    target[np.arange(len(own)), part] += 0.5
    router = Router(*train(own, target, rng), 1 << levels)
    place = np.argsort(router.visited(aside), axis=1)  # a part's turn in a query's visits
    found = router.part(aside)[nearest(aside, aside, k, same=True)]
    turn = np.sort(np.take_along_axis(place, found, axis=1).ravel())
    if len(turn):
        router.visits = int(turn[min(len(turn) - 1, int(np.ceil(recall * len(turn))))]) + 1
    return router
