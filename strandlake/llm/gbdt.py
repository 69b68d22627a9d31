"""Small gradient-boosted trees in numpy with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees flattened into node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: int = 8) -> Forest:
    """Logistic loss. monotone: +1 / -1 by feature; the margin never falls / rises with it.

    An empty sample or one with a single class gives a constant forest.
    """
    n, k = x.shape if x.size else (0, x.shape[1] if x.ndim == 2 else 1)
    rate0 = (y.sum() + 0.5) / (n + 1) if n else 0.5
    bias = float(np.log(rate0 / (1 - rate0)))
    nodes: list[list] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)
        f = np.full(n, bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
            while todo:
                node, rows, level, low, high = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value = float(np.clip(gs / (hs + l2), low, high))
                best = (1e-6, None)
                if level < depth and len(rows) >= 2 * least:
                    for j in range(k):
                        b = binned[rows, j]
                        size = len(cuts[j]) + 1
                        gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                        cl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                        if not len(gl):
                            continue
                        vl, vr = gl / (hl + l2), (gs - gl) / (hs - hl + l2)
                        gain = gl * gl / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs * gs / (hs + l2)
                        ok = (cl >= least) & (len(rows) - cl >= least)
                        if j in monotone:
                            ok &= monotone[j] * (vr - vl) >= 0
                        gain = np.where(ok, gain, -1)
                        c = int(gain.argmax())
                        if gain[c] > best[0]:
                            best = (float(gain[c]), (j, c, float(np.clip(vl[c], low, high)), float(np.clip(vr[c], low, high))))
                if best[1] is None:
                    nodes[node][4] = rate * value
                    f[rows] += rate * value
                    continue
                j, c, vl, vr = best[1]
                a = len(nodes)
                nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, a + 1, a + 1, 0.0]]
                nodes[node][:4] = [j, float(cuts[j][c]), a, a + 1]
                mid, go = (vl + vr) / 2, binned[rows, j] <= c
                sides = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone.get(j, 0)]
                todo += [(a, rows[go], level + 1, *sides[0]), (a + 1, rows[~go], level + 1, *sides[1])]
    cols = list(zip(*nodes, strict=True)) if nodes else [[0], [np.inf], [0], [0], [0.0]]
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Forest(*(np.array(c, kind) for c, kind in zip(cols, kinds, strict=True)), np.array(roots, np.int64), depth, bias)
