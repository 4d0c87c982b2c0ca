"""Whole training runs against a plain trainer: one leaf at a time, one histogram at a time, everything in numpy on the driver."""

import math

import numpy as np
import pytest

import arborframe as A
from arborframe.operators import losses
from arborframe.sources.matrix import from_dense

N, F = 1200, 4
RATE, LEAVES, LEAST = 0.2, 7, 20


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, k, N) for k in (40, 25, 12, 6)], axis=1).astype(float) + 1
    y = np.sin(x[:, 0] / 6) + 0.4 * (x[:, 1] > 9) + 0.1 * x[:, 2] * (x[:, 3] > 3) + rng.normal(0, 0.2, N)
    cols = {"y": y, "b": (y > 0.6).astype(float), "k": np.digitize(y, [0.3, 1.0]).astype(float), "w": rng.uniform(0.5, 2, N).astype(np.float32).astype(float), "q": np.arange(N) // 30, "rel": np.digitize(y, [0, 0.5, 1]).astype(float), "id": np.arange(N)}
    return x, cols, from_dense(spark, x, [f"f{i}" for i in range(F)], **cols).coalesce(1).cache()


def grow(x, g, h, keep=None, monotone=None):
    """(leaf of each row, leaf values): best-first growth with thresholds between all values. Rows that aren't kept are routed, not counted."""
    g, h = g.astype(np.float32).astype(float), h.astype(np.float32).astype(float)
    keep = np.ones(len(g), bool) if keep is None else keep
    leaf, low, high = np.zeros(len(g), int), {0: -math.inf}, {0: math.inf}

    def best(i):
        own = (leaf == i) & keep
        tg, th, n = g[own].sum(), h[own].sum(), own.sum()
        found = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            est = np.array([math.floor(h[own & (x[:, f] == v)].sum() * n / th + 0.5) for v in values])
            for j in range(len(values) - 1, 0, -1):  # of equal gains the largest threshold
                cut = values[j - 1]
                left = own & (x[:, f] <= cut)
                lg, lh, rn = g[left].sum(), h[left].sum(), est[j:].sum()
                if rn < LEAST or n - rn < LEAST or min(lh, th - lh) < 1e-3:
                    continue
                out = [float(np.clip(-a / b, low[i], high[i])) for a, b in ((lg, lh), (tg - lg, th - lh))]
                if monotone is None:
                    gain = lg * lg / lh + (tg - lg) ** 2 / (th - lh)
                else:
                    gain = sum(-(2 * a * o + b * o * o) for a, b, o in ((lg, lh, out[0]), (tg - lg, th - lh, out[1])))
                    if monotone[f] * (out[1] - out[0]) < 0:
                        gain = 0.0
                shift = tg * tg / th if low[i] == -math.inf and high[i] == math.inf else -(2 * tg * (o := float(np.clip(-tg / th, low[i], high[i]))) + th * o * o)
                if gain > shift and (found is None or gain - shift > found[0] + 1e-9 * abs(found[0])):
                    found = (gain - shift, f, cut, out)
        return found

    value = {0: -g[keep].sum() / h[keep].sum()}
    open_ = {0: best(0)}
    while len(value) < LEAVES and any(open_.values()):
        i = max((k for k, v in open_.items() if v), key=lambda k: (open_[k][0], -k))
        _, f, cut, out = open_[i]
        new = len(value)
        leaf[(leaf == i) & (x[:, f] > cut)] = new
        value[i], value[new], low[new], high[new] = out[0], out[1], low[i], high[i]
        if monotone is not None and monotone[f]:
            mid = sum(out) / 2
            a, b = (i, new) if monotone[f] > 0 else (new, i)
            high[a], low[b] = min(high[a], mid), max(low[b], mid)
        open_[i], open_[new] = best(i), best(new)
    return leaf, np.array([value[i] for i in range(len(value))])


def fitted(df, params, label, rounds, **roles):
    p = {"num_leaves": LEAVES, "min_data_in_leaf": LEAST, "min_data_in_bin": 1, "learning_rate": RATE, **params}
    d = A.Dataset(df, label, feature_name=[f"f{i}" for i in range(F)], **roles)
    b = A.train(p, d, rounds)
    return np.array([r.prediction for r in b.predict(df, raw_score=True).select("id", "prediction").orderBy("id").collect()]), b


def boosted(x, start, gradient, rounds, keep=None, renew=None, monotone=None):
    s = np.full(len(x), start, float)
    for it in range(rounds):
        g, h = gradient(s)
        k, factor = keep(it, g, h) if keep else (None, 1.0)
        leaf, value = grow(x, g * factor, h * factor, k, monotone)
        if renew:
            value = np.array([renew(s, leaf == i) for i in range(len(value))])
        s = s + RATE * value[leaf]
    return s


def test_regression(data):
    x, c, df = data
    y = c["y"].astype(np.float32).astype(float)
    got, _ = fitted(df, {}, "y", 4)
    assert np.allclose(got, boosted(x, c["y"].mean(), lambda s: (s - y, np.ones(N)), 4), atol=1e-5)


def test_binary_weighted(data):
    x, c, df = data
    w, b = c["w"], c["b"]
    share = (b * w).sum() / w.sum()

    def gradient(s):
        p = 1 / (1 + np.exp(-s))
        return (p - b) * w, p * (1 - p) * w

    got, _ = fitted(df, {"objective": "binary"}, "b", 4, weight="w")
    assert np.allclose(got, boosted(x, math.log(share / (1 - share)), gradient, 4), atol=1e-4)


def test_multiclass(data):
    x, c, df = data
    k = c["k"].astype(int)
    s = np.stack([np.full(N, math.log((k == i).mean())) for i in range(3)])
    for _ in range(3):
        p = losses.softmax(s)
        step = []
        for i in range(3):
            leaf, value = grow(x, p[i] - (k == i), 1.5 * p[i] * (1 - p[i]))
            step.append(RATE * value[leaf])
        s = s + np.stack(step)
    got, _ = fitted(df, {"objective": "multiclass", "num_class": 3}, "k", 3)
    assert np.allclose(got, s.T, atol=1e-4)


def test_quantile_renews_leaves(data):
    x, c, df = data
    y = c["y"].astype(np.float32).astype(float)
    gradient = lambda s: (np.where((s - y).astype(np.float32) >= 0, 0.1, -0.9), np.ones(N))
    got, _ = fitted(df, {"objective": "quantile", "alpha": 0.9}, "y", 3)
    want = boosted(x, np.quantile(c["y"], 0.9), gradient, 3, renew=lambda s, own: np.quantile((y - s)[own], 0.9))
    assert np.allclose(got, want, atol=1e-4)


def test_monotone(data):
    x, c, df = data
    y = c["y"].astype(np.float32).astype(float)
    got, _ = fitted(df, {"monotone_constraints": [1, 0, -1, 0]}, "y", 3)
    assert np.allclose(got, boosted(x, c["y"].mean(), lambda s: (s - y, np.ones(N)), 3, monotone=[1, 0, -1, 0]), atol=1e-5)


def test_forest(data):
    """Trees on bags of rows, their outputs averaged."""
    x, c, df = data
    y, start = c["y"].astype(np.float32).astype(float), c["y"].mean()
    out = []
    for it in range(3):
        leaf, value = grow(x, start - y, np.ones(N), losses.uniform(np.arange(N), 3 + 104729 * it) < 0.7)
        out.append(start + value[leaf])
    got, _ = fitted(df, {"boosting": "rf", "bagging_freq": 1, "bagging_fraction": 0.7}, "y", 3)
    assert np.allclose(got, np.mean(out, axis=0), atol=1e-5)


def test_goss(data):
    """All rows at first; then those with large gradients, and a share of the others with more weight."""
    x, c, df = data
    y = c["y"].astype(np.float32).astype(float)

    def keep(it, g, h):
        if it < int(1 / RATE):
            return None, 1.0
        size = np.abs(g.astype(np.float32) * h.astype(np.float32))
        bucket = size.view(np.uint32) >> 16
        order = np.sort(bucket)[::-1]
        top = bucket >= order[int(0.2 * N) - 1]
        return top | (losses.uniform(np.arange(N), 3 + 104729 * it) < 0.1 / 0.8), np.where(top, 1.0, 8.0).astype(np.float32)

    got, _ = fitted(df, {"data_sample_strategy": "goss"}, "y", 7)
    assert np.allclose(got, boosted(x, c["y"].mean(), lambda s: (s - y, np.ones(N)), 7, keep), atol=1e-4)


def test_dart(data):
    """The trees that a model keeps, with their weights, are what its training scores were made of: each is grown on the gradients without the dropped ones."""
    x, c, df = data
    y, start = c["y"].astype(np.float32).astype(float), c["y"].mean()
    from arborframe.operators.sampling import Lcg

    rng, trees, weights, total = Lcg(4), [], [], 0.0
    for _ in range(5):
        rng.next_float()
        drop = []
        if weights:
            inverse = len(weights) / total
            rate = min(0.6, 50 * inverse / total)
            for i, w in enumerate(weights):
                if rng.next_float() < rate * w * inverse:
                    drop.append(i)
        s = start + sum((t for i, t in enumerate(trees) if i not in drop), np.zeros(N))
        leaf, value = grow(x, s - y, np.ones(N))
        n = len(drop)
        new = RATE / (n + 1) if n else RATE
        for i in drop:
            trees[i] = trees[i] * (n / (n + 1))
            total -= weights[i] / (n + 1)
            weights[i] *= n / (n + 1)
        trees.append(new * value[leaf])
        weights.append(new)
        total += new
    got, _ = fitted(df, {"boosting": "dart", "skip_drop": 0.0, "drop_rate": 0.6}, "y", 5)
    assert np.allclose(got, start + sum(trees), atol=1e-4)


def test_lambdarank(data):
    """Gradients from a loop over all pairs of a query."""
    x, c, df = data
    rel, q = c["rel"].astype(int), c["q"]

    def gradient(s):
        g, h = np.zeros(N), np.zeros(N)
        for k in np.unique(q):
            own = np.flatnonzero(q == k)
            gain = 2.0 ** rel[own] - 1
            best = sum(v / math.log2(i + 2) for i, v in enumerate(sorted(gain, reverse=True)[:30]))
            if best <= 0:
                continue
            order = sorted(range(len(own)), key=lambda i: -s[own[i]])
            total, spread = 0.0, s[own[order[0]]] != s[own[order[-1]]]
            gq, hq = np.zeros(len(own)), np.zeros(len(own))
            for a in range(min(30, len(own))):
                for b in range(a + 1, len(own)):
                    i, j = order[a], order[b]
                    if gain[i] == gain[j]:
                        continue
                    hi, lo = (i, j) if gain[i] > gain[j] else (j, i)
                    d = s[own[hi]] - s[own[lo]]
                    delta = abs(gain[i] - gain[j]) * abs(1 / math.log2(a + 2) - 1 / math.log2(b + 2)) / best
                    delta = delta / (0.01 + abs(d)) if spread else delta
                    p = 1 / (1 + math.exp(d))
                    gq[hi] -= delta * p
                    gq[lo] += delta * p
                    hq[[hi, lo]] += delta * p * (1 - p)
                    total += 2 * delta * p
            f = math.log2(1 + total) / total if total > 0 else 1.0
            g[own], h[own] = gq * f, hq * f
        return g, h

    got, _ = fitted(df, {"objective": "lambdarank"}, "rel", 2, group="q")
    assert np.allclose(got, boosted(x, 0.0, gradient, 2), atol=1e-4)


def test_linear_trees(data):
    """The first tree is constant; a leaf of the next ones is a least squares fit on the features of its path."""
    x, c, df = data
    y, start = c["y"].astype(np.float32).astype(float), c["y"].mean()
    got, b = fitted(df, {"linear_tree": True, "linear_lambda": 0.1}, "y", 2)
    first, second = b.trees
    leaf, value = grow(x, start - y, np.ones(N))
    s = start + RATE * value[leaf]
    out = np.zeros(N)
    leaf, value = grow(x, s - y, np.ones(N))
    assert len(value) == second.leaves and not any(f for _, f, _ in first.linear)
    place = second.leaf_of_raw(x)
    for i in range(second.leaves):
        own, f = place == i, second.linear[i][1]
        if not f:
            out[own] = second.value[i]
            continue
        a = np.column_stack([x[own][:, f], np.ones(own.sum())])
        coef = np.linalg.solve(a.T @ a + np.diag([0.1] * len(f) + [0.0]), a.T @ (y - s)[own])
        out[own] = RATE * (a @ coef)
    assert any(f for _, f, _ in second.linear)
    assert np.allclose(got, s + out, atol=1e-4)


@pytest.mark.parametrize("sizes", [[70000, 5, 60000, 3000], [32768, 40000, 7, 32761, 10]])
def test_queries_longer_than_a_block(spark, sizes):
    """Each query is in one block and next to its other rows, also one that goes on over several batches."""
    from pyspark.sql import functions as F

    from arborframe.plans import blocks as B

    q = np.repeat(np.arange(len(sizes)), sizes)
    n = len(q)
    x = np.arange(n) % 50 + 1.0
    df = from_dense(spark, x[:, None], ["f0"], q=q, rel=(x > 20).astype(float) + (x > 40)).coalesce(1)
    d = A.Dataset(df, "rel", group="q", feature_name=["f0"]).construct()
    got = [len(r.q) // 8 - 1 for r in d.blocks.select("q").collect()]
    lengths = sorted(int(k) for r in d.blocks.select("q").collect() for k in np.diff(np.frombuffer(r.q, np.int64)))
    assert lengths == sorted(sizes) and sum(got) == len(sizes)
    assert d.blocks.agg(F.sum("n")).first()[0] == n and B.BLOCK == 32768
    b = A.train({"objective": "lambdarank", "num_leaves": 3}, d, 2)
    assert b.predict(df).where("prediction is not null").count() == n


@pytest.fixture(scope="module")
def long_queries(spark):
    rng = np.random.default_rng(3)
    q = rng.permutation(np.repeat(np.arange(6), [900, 30, 1500, 80, 3, 700]))
    n = len(q)
    x = rng.integers(1, 30, (n, 2)).astype(float)
    rel = np.digitize(x[:, 0] + rng.normal(0, 6, n), [8, 15, 25]).astype(float)
    return from_dense(spark, x, ["f0", "f1"], q=q, rel=rel, w=rng.uniform(0.5, 2, n), start=rng.integers(0, 40, n) / 10, pos=rng.integers(0, 5, n)).coalesce(1).cache()


@pytest.mark.parametrize("objective", ["lambdarank", "rank_xendcg"])
def test_gradients_of_queries_that_are_dealt_out(long_queries, monkeypatch, objective):
    """Rows of a query in several blocks get the gradients that they get in one."""
    from arborframe.plans import blocks as B

    monkeypatch.setattr(B, "WIDE", 100)
    monkeypatch.setattr(B, "BLOCK", 256)
    d = A.Dataset(long_queries, "rel", group="q", weight="w", init_score="start", feature_name=["f0", "f1"], params={"objective": objective}).construct()
    job = B.Job(d.used, objective, {}, 1, iteration=3)
    out, beside = B.graded(d.blocks, job, d.dealt)
    before, after = {r.block: r.asDict() for r in d.blocks.select("*").collect()}, {r.block: r.asDict() for r in out.collect()}
    wide = {}
    for k, r in sorted(before.items()):
        if r["wide"] is not None:
            wide.setdefault(r["wide"], []).append(k)
    assert d.dealt and len(wide) == 3 and sorted(map(len, wide.values())) == [3, 4, 6] and sum(r["n"] for r in after.values()) == 3213
    for parts in wide.values():
        rows = [job.open(before[k]) for k in parts]
        s, y, u = (np.concatenate(v) for v in zip(*((r.base[0], r.y, losses.uniform(r.ids, losses.draw({}, 3))) for r in rows), strict=True))
        g, h = losses.lambdarank(s, y, {}) if objective == "lambdarank" else losses.xendcg(s, y, u)
        w = np.concatenate([r.w for r in rows])
        got = [np.concatenate([np.frombuffer(after[k][c], np.float32) for k in parts]) for c in "gh"]
        assert np.abs(g).max() > 0 and np.allclose(got[0], g * w, rtol=1e-5, atol=1e-9) and np.allclose(got[1], h * w, rtol=1e-5, atol=1e-9)
    for x in (out, *beside):
        x.unpersist()


def test_training_on_queries_that_are_dealt_out(long_queries, monkeypatch):
    """The same trees as with each query in one block; a custom objective gets whole queries."""
    from arborframe.plans import blocks as B

    def run(**p):
        d = A.Dataset(long_queries, "rel", group="q", init_score="start", position="pos", feature_name=["f0", "f1"])
        b = A.train({"objective": "lambdarank", "num_leaves": 5, **p}, d, 3)
        return d.dealt, [(t.feature, t.threshold, t.count, np.round(t.value, 5).tolist()) for t in b.trees]

    whole = run()
    monkeypatch.setattr(B, "WIDE", 100)
    monkeypatch.setattr(B, "BLOCK", 256)
    dealt = run()
    assert not whole[0] and dealt[0] and dealt[1] == whole[1]

    def custom(s, y, w, q):
        assert len(q) == 7 and q[-1] == 3213 or set(np.diff(q)) <= {900, 30, 1500, 80, 3, 700}
        return s - y, np.ones(len(s))

    assert not run(objective=custom)[0]
