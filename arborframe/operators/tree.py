"""One decision tree: arrays of nodes and leaves, applied to bins or raw values, as an expression, and as text."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binning import ZERO, BinMapper

MISSING = ("none", "zero", "nan")


def rounded(v: float) -> float:
    return 0.0 if abs(v) <= ZERO else float(v)


@dataclass
class Tree:
    """Children >= 0 are nodes, below 0 leaves (~index)."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    cats: list[list[int] | None] = field(default_factory=list)  # categories that go left
    cat_bins: list[list[int] | None] = field(default_factory=list)
    default_left: list[bool] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    node_value: list[float] = field(default_factory=list)
    node_weight: list[float] = field(default_factory=list)
    node_count: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=lambda: [0.0])
    weight: list[float] = field(default_factory=lambda: [0.0])
    count: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    shrinkage: float = 1.0
    linear: list[tuple[float, list[int], list[float]]] | None = None  # per leaf: constant, features, coefficients

    @property
    def leaves(self) -> int:
        return len(self.value)

    def split(self, leaf: int, s, mapper: BinMapper) -> int:
        """Makes the leaf a node; the left child keeps the leaf's index. Returns the right child's."""
        node, right = len(self.feature), len(self.value)
        self.feature.append(s.feature)
        self.bin.append(s.bin)
        self.cat_bins.append(sorted(s.cat_bins) if s.cat_bins is not None else None)
        self.cats.append(sorted(int(mapper.cats[b - 1]) for b in s.cat_bins) if s.cat_bins is not None else None)
        self.threshold.append(0.0 if s.cat_bins is not None else mapper.value(s.bin))
        self.default_left.append(s.default_left and s.cat_bins is None)
        self.missing.append(mapper.missing)
        self.left.append(~leaf)
        self.right.append(~right)
        self.gain.append(float(np.float32(s.gain)))
        self.node_value.append(self.value[leaf])
        self.node_weight.append(s.left_h + s.right_h)
        self.node_count.append(s.left_n + s.right_n)
        p = self.parent[leaf]
        if p >= 0:
            (self.left if self.left[p] == ~leaf else self.right)[p] = node
        self.value[leaf], self.weight[leaf], self.count[leaf] = rounded(s.left_out), s.left_h, s.left_n
        self.value.append(rounded(s.right_out))
        self.weight.append(s.right_h)
        self.count.append(s.right_n)
        self.depth[leaf] += 1
        self.depth.append(self.depth[leaf])
        self.parent[leaf] = node
        self.parent.append(node)
        return right

    def shrink(self, rate: float) -> None:
        self.value = [rounded(v * rate) for v in self.value]
        self.node_value = [v * rate for v in self.node_value]
        if self.linear:
            self.linear = [(c * rate, f, [x * rate for x in k]) for c, f, k in self.linear]
        self.shrinkage *= rate

    def add_bias(self, b: float) -> None:
        self.value = [rounded(v + b) for v in self.value]
        self.node_value = [v + b for v in self.node_value]
        if self.linear:
            self.linear = [(c + b, f, k) for c, f, k in self.linear]

    # ---- applying

    def _route(self, n: int, goes_left) -> np.ndarray:
        leaf = np.zeros(n, np.int32)
        if not self.feature:
            return leaf
        stack = [(0, np.arange(n))]
        while stack:
            node, rows = stack.pop()
            mask = goes_left(node, rows)
            for child, own in ((self.left[node], rows[mask]), (self.right[node], rows[~mask])):
                if child < 0:
                    leaf[own] = ~child
                elif len(own):
                    stack.append((child, own))
        return leaf

    def leaf_of_bins(self, bins: np.ndarray, mappers: dict[int, BinMapper], at: dict[int, int]) -> np.ndarray:
        """bins: used features x rows; at: feature -> its row there."""

        def left(node, rows):
            f = self.feature[node]
            b = bins[at[f]][rows]
            if self.cat_bins[node] is not None:
                return np.isin(b, self.cat_bins[node])
            out = b <= self.bin[node]
            m = mappers[f]
            if m.missing == "nan":
                out[b == m.num_bin - 1] = self.default_left[node]
            elif m.missing == "zero":
                out[b == m.default_bin] = self.default_left[node]
            return out

        return self._route(bins.shape[1] if bins.size or bins.ndim == 2 else 0, left)

    def leaf_of_raw(self, x: np.ndarray) -> np.ndarray:
        """x: rows x features, NaN for missing."""

        def left(node, rows):
            v = x[rows, self.feature[node]]
            nan = np.isnan(v)
            if self.cats[node] is not None:
                ok = ~nan & (v >= 0) & (v < 2**31)
                return ok & np.isin(np.where(ok, v, -1).astype(np.int64), self.cats[node])
            kind = self.missing[node]
            if kind != "nan":
                v = np.where(nan, 0.0, v)
            out = v <= self.threshold[node]
            if kind == "nan":
                out[nan] = self.default_left[node]
            elif kind == "zero":
                out[np.abs(v) <= ZERO] = self.default_left[node]
            return out

        return self._route(len(x), left)

    def outputs(self, leaf: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        out = np.array(self.value)[leaf]
        if self.linear and x is not None:
            for i, (c, f, k) in enumerate(self.linear):
                if f:
                    rows = np.flatnonzero(leaf == i)
                    part = x[np.ix_(rows, f)]
                    ok = np.isfinite(part).all(axis=1)
                    out[rows[ok]] = c + part[ok] @ np.array(k)
        return out

    def column(self, names: list[str], what: str = "value") -> Column:
        """The tree as one expression of raw feature columns: its output, or the leaf's index."""
        col = lambda f: F.coalesce(F.col(f"`{names[f]}`").cast("double"), F.lit(float("nan")))

        def leaf(i):
            if what == "leaf":
                return F.lit(i)
            if self.linear and self.linear[i][1]:
                c, f, k = self.linear[i]
                good = ~F.isnan(col(f[0]))
                for j in f[1:]:
                    good = good & ~F.isnan(col(j))
                return F.when(good, sum((col(j) * F.lit(x) for j, x in zip(f, k, strict=True)), F.lit(c))).otherwise(F.lit(self.value[i]))
            return F.lit(self.value[i])

        def test(node):
            v = col(self.feature[node])
            if self.cats[node] is not None:
                if not self.cats[node]:
                    return F.lit(False)
                return F.when(F.isnan(v) | (v < 0) | (v >= 2.0**31), F.lit(False)).otherwise(F.floor(v).isin([int(c) for c in self.cats[node]]))
            kind, default = self.missing[node], F.lit(self.default_left[node])
            t = F.lit(float(self.threshold[node]))
            if kind == "nan":
                return F.when(F.isnan(v), default).otherwise(v <= t)
            v = F.nanvl(v, F.lit(0.0))
            return F.when(F.abs(v) <= ZERO, default).otherwise(v <= t) if kind == "zero" else v <= t

        def build(i):
            return leaf(~i) if i < 0 else F.when(test(i), build(self.left[i])).otherwise(build(self.right[i]))

        return build(0) if self.feature else leaf(0)

    # ---- Shapley values

    def expected(self) -> float:
        n = sum(self.count)
        return sum(v * c for v, c in zip(self.value, self.count, strict=True)) / n if n else float(np.mean(self.value))

    def _cover(self, i: int) -> int:
        return self.count[~i] if i < 0 else self.node_count[i]

    def contributions(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds path-dependent Shapley values of each row to out (rows x features + 1; the last is the expected value).

        A leaf's value is spread over the features of its path. For each leaf, all rows at once: feature i of the path
        has a share z (of the training rows that pass its splits) and a flag o (does the row pass them?), and the weight of
        a subset of size s of d features is s! (d - s - 1)! / d!.
        """
        out[:, -1] += self.expected()
        if not self.feature:
            return
        passes: dict[int, np.ndarray] = {}
        for node in range(len(self.feature)):
            passes[node] = self._goes_left(node, x)

        def walk(i, path):
            if i >= 0:
                total = max(self.node_count[i], 1)
                for child, ok in ((self.left[i], passes[i]), (self.right[i], ~passes[i])):
                    walk(child, [*path, (self.feature[i], self._cover(child) / total, ok)])
                return
            share: dict[int, float] = {}
            flag: dict[int, np.ndarray] = {}
            for f, z, ok in path:
                share[f] = share.get(f, 1.0) * z
                flag[f] = flag[f] & ok if f in flag else ok
            feats = list(share)
            d = len(feats)
            one = [flag[f].astype(np.float64) for f in feats]
            w = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
            for j, f in enumerate(feats):
                poly = [np.ones(len(x))]  # coefficients by number of chosen features among the others
                for m, g in enumerate(feats):
                    if m != j:
                        nxt = [np.zeros(len(x)) for _ in range(len(poly) + 1)]
                        for s, c in enumerate(poly):
                            nxt[s] += c * share[g]
                            nxt[s + 1] += c * one[m]
                        poly = nxt
                out[:, f] += self.value[~i] * (one[j] - share[f]) * sum(c * w[s] for s, c in enumerate(poly))

        walk(0, [])

    def _goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        t = Tree(feature=[self.feature[node]], bin=[0], threshold=[self.threshold[node]], cats=[self.cats[node]], cat_bins=[None], default_left=[self.default_left[node]], missing=[self.missing[node]], left=[~0], right=[~1], value=[0.0, 0.0])
        return t.leaf_of_raw(x) == 0

    # ---- text

    def _decision(self, i: int) -> int:
        return int(self.cats[i] is not None) | (2 if self.default_left[i] else 0) | MISSING.index(self.missing[i]) << 2

    def to_text(self, index: int) -> str:
        cat_nodes = [i for i, c in enumerate(self.cats) if c is not None]
        words, edges = [], [0]
        for i in cat_nodes:
            bits = [0] * (max(self.cats[i], default=0) // 32 + 1)
            for c in self.cats[i]:
                bits[c // 32] |= 1 << c % 32
            words += bits
            edges.append(len(words))
        threshold = [float(cat_nodes.index(i)) if self.cats[i] is not None else t for i, t in enumerate(self.threshold)]
        g, f = (lambda v: f"{v:.17g}"), (lambda v: f"{v:g}")
        join = lambda values, form=str: " ".join(form(v) for v in values)
        lines = [f"Tree={index}", f"num_leaves={self.leaves}", f"num_cat={len(cat_nodes)}", f"split_feature={join(self.feature)}", f"split_gain={join(self.gain, f)}", f"threshold={join(threshold, g)}"]
        lines += [f"decision_type={join(self._decision(i) for i in range(len(self.feature)))}", f"left_child={join(self.left)}", f"right_child={join(self.right)}", f"leaf_value={join(self.value, g)}"]
        lines += [f"leaf_weight={join(self.weight, g)}", f"leaf_count={join(self.count)}", f"internal_value={join(self.node_value, f)}", f"internal_weight={join(self.node_weight, f)}", f"internal_count={join(self.node_count)}"]
        if cat_nodes:
            lines += [f"cat_boundaries={join(edges)}", f"cat_threshold={join(words)}"]
        lines.append(f"is_linear={int(bool(self.linear))}")
        if self.linear:
            lines += [f"leaf_const={join((c for c, _, _ in self.linear), g)}", f"num_features={join(len(x) for _, x, _ in self.linear)}"]
            lines += ["leaf_features=" + " ".join(str(v) for _, x, _ in self.linear for v in x), "leaf_coeff=" + " ".join(g(v) for _, _, k in self.linear for v in k)]
        return "\n".join([*lines, f"shrinkage={self.shrinkage:g}", "", ""])

    @classmethod
    def from_text(cls, text: str) -> Tree:
        kv = dict(line.split("=", 1) for line in text.strip().splitlines() if "=" in line)
        ints = lambda k: [int(x) for x in kv.get(k, "").split()]
        floats = lambda k: [float(x) for x in kv.get(k, "").split()]
        t = cls(feature=ints("split_feature"), gain=floats("split_gain"), threshold=floats("threshold"), left=ints("left_child"), right=ints("right_child"), value=floats("leaf_value"), shrinkage=float(kv.get("shrinkage", 1)))
        n, nodes = len(t.value), len(t.feature)
        if n != int(kv["num_leaves"]) or nodes != n - 1:
            raise ValueError("model text: the number of leaves doesn't fit")
        t.weight, t.count = floats("leaf_weight") or [0.0] * n, ints("leaf_count") or [0] * n
        t.node_value, t.node_weight, t.node_count = floats("internal_value") or [0.0] * nodes, floats("internal_weight") or [0.0] * nodes, ints("internal_count") or [0] * nodes
        t.bin = [0] * nodes
        kinds = ints("decision_type") or [0] * nodes
        t.default_left = [bool(d & 2) for d in kinds]
        t.missing = [MISSING[d >> 2 & 3] for d in kinds]
        edges, words = ints("cat_boundaries"), ints("cat_threshold")
        t.cats, t.cat_bins = [None] * nodes, [None] * nodes
        for i, d in enumerate(kinds):
            if d & 1:
                k = int(t.threshold[i])
                own = words[edges[k] : edges[k + 1]]
                t.cats[i] = [c for c in range(32 * len(own)) if own[c // 32] >> c % 32 & 1]
                t.threshold[i] = 0.0
        t.parent, t.depth = [-1] * n, [0] * n
        if nodes:
            stack = [(0, 0)]
            while stack:
                i, d = stack.pop()
                for c in (t.left[i], t.right[i]):
                    if c < 0:
                        t.parent[~c], t.depth[~c] = i, d + 1
                    else:
                        stack.append((c, d + 1))
        if kv.get("is_linear") == "1":
            k, f, c = ints("num_features"), ints("leaf_features"), floats("leaf_coeff")
            at = np.concatenate([[0], np.cumsum(k)]).astype(int)
            t.linear = [(x, f[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i, x in enumerate(floats("leaf_const"))]
        return t

    def to_json(self, index: int) -> dict:
        def node(i):
            if i < 0:
                out = {"leaf_index": ~i, "leaf_value": self.value[~i], "leaf_weight": self.weight[~i], "leaf_count": self.count[~i]}
                if self.linear:
                    out |= {"leaf_const": self.linear[~i][0], "leaf_features": self.linear[~i][1], "leaf_coeff": self.linear[~i][2]}
                return out if self.feature else {"leaf_value": self.value[0], "leaf_count": self.count[0]}
            cat = self.cats[i] is not None
            return {
                "split_index": i, "split_feature": self.feature[i], "split_gain": self.gain[i], "threshold": "||".join(map(str, self.cats[i])) if cat else self.threshold[i],
                "decision_type": "==" if cat else "<=", "default_left": self.default_left[i], "missing_type": {"none": "None", "zero": "Zero", "nan": "NaN"}[self.missing[i]],
                "internal_value": self.node_value[i], "internal_weight": self.node_weight[i], "internal_count": self.node_count[i], "left_child": node(self.left[i]), "right_child": node(self.right[i]),
            }

        return {"tree_index": index, "num_leaves": self.leaves, "num_cat": sum(c is not None for c in self.cats), "shrinkage": self.shrinkage, "tree_structure": node(0 if self.feature else ~0)}
