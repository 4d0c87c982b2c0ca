"""Gradients and hessians of a block of rows in numpy, for the training loop. The Column forms are in functions.objectives."""

from __future__ import annotations

import numpy as np

from ..functions.objectives import EPSILON, canonical


def sgn(x):
    return (x > 0).astype(np.float64) - (x < 0)


def softmax(s: np.ndarray) -> np.ndarray:
    """Over axis 0."""
    e = np.exp(s - s.max(axis=0))
    return e / e.sum(axis=0)


def pointwise(name: str, s: np.ndarray, y: np.ndarray, w: np.ndarray | None, p: dict) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones_like(s)
    d = s - y
    if name == "regression":
        g, h = d, one
    elif name == "regression_l1":
        g, h = sgn(d), one
    elif name == "huber":
        a = p.get("alpha", 0.9)
        g, h = np.where(np.abs(d) <= a, d, sgn(d) * a), one
    elif name == "fair":
        c = p.get("fair_c", 1.0)
        t = np.abs(d) + c
        g, h = c * d / t, c * c / (t * t)
    elif name == "poisson":
        g, h = np.exp(s) - y, np.exp(s + p.get("poisson_max_delta_step", 0.7))
    elif name == "quantile":
        a = p.get("alpha", 0.9)
        g, h = np.where(d.astype(np.float32) >= 0, 1.0 - a, -a), one
    elif name == "mape":
        lw = 1.0 / np.maximum(1.0, np.abs(y))
        if w is not None:
            lw = lw * w
        return (sgn(d) * lw.astype(np.float32)).astype(np.float32), (one if w is None else w).astype(np.float32)
    elif name == "gamma":
        e = y * np.exp(-s)
        g, h = 1.0 - e, e
    elif name == "tweedie":
        r = p.get("tweedie_variance_power", 1.5)
        a, b = np.exp((1.0 - r) * s), np.exp((2.0 - r) * s)
        g, h = -y * a + b, -y * (1.0 - r) * a + (2.0 - r) * b
    elif name == "binary":
        k = p.get("sigmoid", 1.0)
        pos = y > 0
        label = np.where(pos, 1.0, -1.0)
        r = -label * k / (1.0 + np.exp(label * k * s))
        side = np.where(pos, p.get("positive_weight", 1.0), p.get("negative_weight", 1.0))
        g, h = r * side, np.abs(r) * (k - np.abs(r)) * side
    elif name == "cross_entropy":
        e = np.exp(-np.maximum(s, -37.0))
        low = s <= -37.0
        es = np.exp(np.minimum(s, 0.0))
        g = np.where(low, es - y, ((1.0 - y) - y * e) / (1.0 + e))
        h = np.where(low, es, e / ((1.0 + e) * (1.0 + e)))
    elif name == "cross_entropy_lambda":
        if w is None:
            z = 1.0 / (1.0 + np.exp(-s))
            return (z - y).astype(np.float32), (z * (1.0 - z)).astype(np.float32)
        e = np.exp(s)
        z = 1.0 - np.exp(-w * np.log1p(e))
        g = (1.0 - y / z) * w / (1.0 + 1.0 / e)
        c = 1.0 / (1.0 - z)
        a = w * e / ((1.0 + e) ** 2)
        b = c / ((c - 1.0) ** 2) * (1.0 + w * e - c)
        return g.astype(np.float32), (a * (1.0 + y * b)).astype(np.float32)
    else:
        raise ValueError(name)
    if w is not None:
        g, h = g * w, h * w
    return g.astype(np.float32), h.astype(np.float32)


def label_gains(p: dict) -> np.ndarray:
    own = p.get("label_gain")
    return np.array(own, np.float64) if own else 2.0 ** np.arange(31) - 1.0


def _pairs(s, gain, y, disc, s2, gain2, y2, disc2, best: float, spread: bool, k: float):
    """Of one row and others behind it: lambda as it goes to the one row, its size and the hessian."""
    up = y > y2
    ds = np.where(up, s - s2, s2 - s)
    delta = np.abs(gain - gain2) * np.abs(disc - disc2) / best
    if spread:
        delta = delta / (0.01 + np.abs(ds))
    q = 1.0 / (1.0 + np.exp(np.clip(k * ds, -50, 50)))
    lam, hes = k * delta * q, k * k * delta * q * (1.0 - q)
    return np.where(up, -lam, lam), lam, hes


def _discount(place):
    return 1.0 / np.log2(2.0 + place)


def lambdarank(s: np.ndarray, y: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """One query. Pairs of different labels of which the better ranked one is above the truncation level."""
    n = len(s)
    g, h = np.zeros(n), np.zeros(n)
    gain = label_gains(p)[y.astype(np.int64)]
    cut = p.get("lambdarank_truncation_level", 30)
    disc = _discount(np.arange(n))
    best = float((np.sort(gain)[::-1][:cut] * disc[:cut]).sum())
    if best <= 0 or n < 2:
        return g, h
    order = np.argsort(-s, kind="stable")
    so, go, yo = s[order], gain[order], y[order]
    norm, k = p.get("lambdarank_norm", True), p.get("sigmoid", 1.0)
    spread = norm and so[0] != so[-1]
    gs, hs, total = np.zeros(n), np.zeros(n), 0.0
    for i in range(min(cut, n - 1)):
        j = np.arange(i + 1, n)
        j = j[yo[j] != yo[i]]
        if not len(j):
            continue
        side, lam, hes = _pairs(so[i], go[i], yo[i], disc[i], so[j], go[j], yo[j], disc[j], best, spread, k)
        gs[i] += side.sum()
        gs[j] -= side
        hs[i] += hes.sum()
        hs[j] += hes
        total += 2.0 * lam.sum()
    if norm and total > 0:
        f = np.log2(1.0 + total) / total
        gs, hs = gs * f, hs * f
    g[order], h[order] = gs, hs
    return g, h


def lambdarank_part(s: np.ndarray, y: np.ndarray, rank: np.ndarray, head: dict, p: dict):
    """Some rows of a query, with their places in it, against the query's first rows (head: their s and y in order, best, spread).

    With the sums over all parts (head: g, h, total): the rows' gradients and hessians. Without: what these rows give to those sums.
    """
    g, h = np.zeros(len(s)), np.zeros(len(s))
    gains = label_gains(p)
    gain, disc = gains[y.astype(np.int64)], _discount(rank)
    cut = len(head["s"])
    gs, hs, total = np.zeros(cut), np.zeros(cut), 0.0
    for i in range(cut if head["best"] > 0 else 0):
        j = np.flatnonzero((rank > i) & (y != head["y"][i]))
        if not len(j):
            continue
        side, lam, hes = _pairs(head["s"][i], gains[int(head["y"][i])], head["y"][i], _discount(i), s[j], gain[j], y[j], disc[j], head["best"], head["spread"], p.get("sigmoid", 1.0))
        gs[i], hs[i] = side.sum(), hes.sum()
        g[j] -= side
        h[j] += hes
        total += 2.0 * lam.sum()
    if "total" not in head:
        return gs, hs, total
    first = rank < cut
    g[first] += head["g"][rank[first]]
    h[first] += head["h"][rank[first]]
    if p.get("lambdarank_norm", True) and head["total"] > 0:
        f = np.log2(1.0 + head["total"]) / head["total"]
        g, h = g * f, h * f
    return g, h


def xendcg(s: np.ndarray, y: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One query; u: uniform numbers. The gradient is a sum of three terms: the softmax less the relevance shares 2^y - u, and
    twice what the term before it, taken per unit of the others' share, moves through the other rows."""
    n = len(s)
    if n < 2:
        return np.zeros(n), np.zeros(n)
    share = softmax(s)
    relevance = 2.0 ** y.astype(np.int64) - u
    term = share - relevance / max(EPSILON, float(relevance.sum()))
    g = term.copy()
    for _ in range(2):
        moved = term / (1.0 - share)
        term = share * (moved.sum() - moved)
        g += term
    return g, share * (1.0 - share)


def xendcg_part(s: np.ndarray, y: np.ndarray, u: np.ndarray, sums: list[float]):
    """Some rows of a query. sums: over the whole query, as many as are known of the greatest score, the exponentials, the relevances and twice what
    is moved. With all five the rows' gradients and hessians; else what these rows give to the next ones."""
    if not sums:
        return [float(s.max())]
    share, relevance = np.exp(s - sums[0]), 2.0 ** y.astype(np.int64) - u
    if len(sums) == 1:
        return [float(share.sum()), float(relevance.sum())]
    share = share / sums[1]
    term = share - relevance / max(EPSILON, sums[2])
    g = term.copy()
    for moved in sums[3:]:
        term = share * (moved - term / (1.0 - share))
        g += term
    return [float((term / (1.0 - share)).sum())] if len(sums) < 5 else (g, share * (1.0 - share))


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row id, whatever the partitions."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(2**53)


def draw(p: dict, iteration: int) -> int:
    """The seed of an iteration's uniform numbers."""
    return p.get("objective_seed", 5) + 7919 * iteration


def gradients(name: str, s: np.ndarray, y: np.ndarray, w: np.ndarray | None, p: dict, bounds: np.ndarray | None, ids: np.ndarray, iteration: int, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """s: classes x rows. Returns float32 gradients and hessians of the same shape. bounds: query boundaries; bias: per row, added to the scores of ranking losses."""
    name = canonical(name)
    if name in ("lambdarank", "rank_xendcg"):
        g, h = np.zeros(s.shape[1]), np.zeros(s.shape[1])
        t = s[0] if bias is None else s[0] + bias
        u = uniform(ids, draw(p, iteration))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            g[a:b], h[a:b] = lambdarank(t[a:b], y[a:b], p) if name == "lambdarank" else xendcg(t[a:b], y[a:b], u[a:b])
        if w is not None:
            g, h = g * w, h * w
        return g[None].astype(np.float32), h[None].astype(np.float32)
    if name == "multiclass":
        k = s.shape[0]
        q = softmax(s)
        g = q - (y.astype(np.int64) == np.arange(k)[:, None])
        h = k / (k - 1.0) * q * (1.0 - q)
        if w is not None:
            g, h = g * w, h * w
        return g.astype(np.float32), h.astype(np.float32)
    if name == "multiclassova":
        both = [pointwise("binary", s[i], (y.astype(np.int64) == i).astype(np.float64), w, p) for i in range(s.shape[0])]
        return np.stack([b[0] for b in both]), np.stack([b[1] for b in both])
    g, h = pointwise(name, s[0], y, w, p)
    return g[None], h[None]


def output(name: str, s: np.ndarray, p: dict) -> np.ndarray:
    """Raw scores (classes x rows) to outputs."""
    name = canonical(name)
    if name in ("poisson", "gamma", "tweedie"):
        return np.exp(s)
    if name in ("binary", "multiclassova"):
        return 1.0 / (1.0 + np.exp(-p.get("sigmoid", 1.0) * s))
    if name == "cross_entropy":
        return 1.0 / (1.0 + np.exp(-s))
    if name == "cross_entropy_lambda":
        return np.log1p(np.exp(s))
    if name == "multiclass":
        return softmax(s)
    if p.get("reg_sqrt") and name in ("regression", "regression_l1", "huber", "fair", "quantile", "mape"):
        return sgn(s) * s * s
    return s
