"""Best split of a leaf from its histogram: running sums over ordered bins, then the arg-max."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from .binning import BinMapper

EPS = float(np.float32(1e-15))


@dataclass
class Split:
    feature: int
    gain: float
    bin: int = 0
    cat_bins: list[int] | None = None
    default_left: bool = True
    left_g: float = 0.0
    left_h: float = 0.0
    left_n: int = 0
    right_g: float = 0.0
    right_h: float = 0.0
    right_n: int = 0
    left_out: float = 0.0
    right_out: float = 0.0
    monotone: int = 0


@dataclass
class Rules:
    """What limits splits and outputs."""

    l1: float = 0.0
    l2: float = 0.0
    max_delta_step: float = 0.0
    path_smooth: float = 0.0
    min_data: int = 20
    min_hessian: float = 1e-3
    min_gain: float = 0.0
    max_cat_to_onehot: int = 4
    max_cat_threshold: int = 32
    cat_l2: float = 10.0
    cat_smooth: float = 10.0
    min_data_per_group: int = 100


def threshold_l1(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_output(g, h, r: Rules, n=None, parent: float = 0.0, lo: float = -math.inf, hi: float = math.inf, l2: float | None = None):
    """-T(G) / (H + l2), limited by max_delta_step, smoothed towards the parent, kept in [lo, hi]."""
    out = -threshold_l1(g, r.l1) / (h + (r.l2 if l2 is None else l2))
    if r.max_delta_step > 0:
        out = np.clip(out, -r.max_delta_step, r.max_delta_step)
    if r.path_smooth > 0 and n is not None:
        k = np.asarray(n) / r.path_smooth
        out = out * k / (k + 1.0) + parent / (k + 1.0)
    return np.clip(out, lo, hi)


def gain_given(g, h, out, r: Rules, l2: float | None = None):
    t = threshold_l1(g, r.l1)
    return -(2.0 * t * out + (h + (r.l2 if l2 is None else l2)) * out * out)


def simple(r: Rules, bounded: bool) -> bool:
    return r.max_delta_step <= 0 and r.path_smooth <= 0 and not bounded


def leaf_gain(g, h, r: Rules, n=None, parent: float = 0.0, lo=-math.inf, hi=math.inf, l2: float | None = None):
    if simple(r, lo > -math.inf or hi < math.inf):
        t = threshold_l1(g, r.l1)
        return t * t / (h + (r.l2 if l2 is None else l2))
    return gain_given(g, h, leaf_output(g, h, r, n, parent, lo, hi, l2), r, l2)


def _both(lg, lh, ln, rg, rh, rn, r, parent, lo, hi, monotone, l2=None):
    if simple(r, lo > -math.inf or hi < math.inf or monotone != 0):
        return leaf_gain(lg, lh, r, l2=l2) + leaf_gain(rg, rh, r, l2=l2)
    a, b = leaf_output(lg, lh, r, ln, parent, lo, hi, l2), leaf_output(rg, rh, r, rn, parent, lo, hi, l2)
    gain = gain_given(lg, lh, a, r, l2) + gain_given(rg, rh, b, r, l2)
    if monotone:
        gain = np.where((a > b) if monotone > 0 else (a < b), 0.0, gain)
    return gain


def numeric_split(m: BinMapper, hist: np.ndarray, g: float, h: float, n: int, r: Rules, parent: float, shift: float, lo=-math.inf, hi=math.inf, monotone: int = 0, only: int | None = None) -> Split | None:
    """hist: bins x (gradient, hessian). h already holds the 2 * EPS that are added to it. Counts are estimated from hessians."""
    nb = m.num_bin
    bg, bh = hist[:nb, 0], hist[:nb, 1]
    est = np.floor(bh * (n / h) + 0.5)
    two = m.missing != "none" and nb > 2
    last = nb - 1 - (m.missing == "nan" and two)  # bins that are scanned: 0..last
    best: tuple[float, int, bool] | None = None
    for reverse in (True, False) if two else (True,):
        use = np.ones(nb, bool)
        if two:
            if m.missing == "zero":
                use[m.default_bin] = False
            else:
                use[nb - 1] = False
        ug, uh, un = np.where(use, bg, 0.0), np.where(use, bh, 0.0), np.where(use, est, 0.0)
        t = np.arange(0, last) if reverse or m.missing != "nan" or not two else np.arange(0, last + 1)
        if not len(t):
            continue
        if reverse:  # what lies above the threshold goes right, the rest, missing included, left
            cg, ch, cn = (np.cumsum(x[::-1])[::-1] for x in (ug[: last + 1], uh[: last + 1], un[: last + 1]))
            rg, rh, rn = cg[t + 1], ch[t + 1] + EPS, cn[t + 1]
            lg, lh, ln = g - rg, h - rh, n - rn
            skip = np.zeros(len(t), bool) if not (two and m.missing == "zero") else t + 1 == m.default_bin
        else:
            cg, ch, cn = np.cumsum(ug), np.cumsum(uh), np.cumsum(un)
            lg, lh, ln = cg[t], ch[t] + EPS, cn[t]
            rg, rh, rn = g - lg, h - lh, n - ln
            skip = np.zeros(len(t), bool) if not (two and m.missing == "zero") else t == m.default_bin
        ok = ~skip & (ln >= r.min_data) & (rn >= r.min_data) & (lh >= r.min_hessian) & (rh >= r.min_hessian)
        if only is not None:
            ok &= t == only
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _both(lg, lh, ln, rg, rh, rn, r, parent, lo, hi, monotone)
        gain = np.where(ok & (gain > shift), gain, -np.inf)
        i = len(t) - 1 - int(np.argmax(gain[::-1])) if reverse else int(np.argmax(gain))
        if np.isfinite(gain[i]) and (best is None or gain[i] > best[0]):
            best = (float(gain[i]), int(t[i]), reverse, lg[i], lh[i], ln[i], rg[i], rh[i], rn[i])
    if best is None:
        return None
    gain, b, left, lg, lh, ln, rg, rh, rn = best
    if m.missing == "nan" and nb == 2:
        left = False
    out = lambda a, c, k: float(leaf_output(a, c, r, k, parent, lo, hi))
    return Split(m.feature, gain - shift, b, None, left, float(lg), float(lh - EPS), int(ln), float(rg), float(rh - EPS), int(rn), out(lg, lh, ln), out(rg, rh, rn), monotone)


def categorical_split(m: BinMapper, hist: np.ndarray, g: float, h: float, n: int, r: Rules, parent: float, shift: float, lo=-math.inf, hi=math.inf, only: int | None = None) -> Split | None:
    """One category against the rest if there are few; else prefixes, from either end, of the categories ordered by G / (H + cat_smooth)."""
    nb = m.num_bin
    bg, bh = hist[:nb, 0], hist[:nb, 1]
    est = np.floor(bh * (n / h) + 0.5)
    onehot = nb - 1 <= r.max_cat_to_onehot
    l2 = r.l2 if onehot else r.l2 + r.cat_l2
    best = None
    if onehot:
        for b in range(1, nb):
            if only is not None and b != only:
                continue
            lg, lh, ln = bg[b], bh[b] + EPS, est[b]
            rg, rh, rn = g - lg, h - lh, n - ln
            if ln < r.min_data or bh[b] < r.min_hessian or rn < r.min_data or rh < r.min_hessian:
                continue
            gain = float(_both(lg, lh, ln, rg, rh, rn, r, parent, lo, hi, 0))
            if gain > shift and (best is None or gain > best[0]):
                best = (gain, [b], lg, lh, ln, rg, rh, rn)
    else:
        have = [b for b in range(1, nb) if est[b] >= r.cat_smooth]
        have.sort(key=lambda b: bg[b] / (bh[b] + r.cat_smooth))
        most = min(r.max_cat_threshold, (len(have) + 1) // 2)
        for order in (have, have[::-1]):
            lg, lh, ln, group = 0.0, EPS, 0.0, 0.0
            for i, b in enumerate(order[:most]):
                lg, lh, ln, group = lg + bg[b], lh + bh[b], ln + est[b], group + est[b]
                if ln < r.min_data or lh < r.min_hessian:
                    continue
                rg, rh, rn = g - lg, h - lh, n - ln
                if rn < r.min_data or rn < r.min_data_per_group or rh < r.min_hessian:
                    break
                if group < r.min_data_per_group:
                    continue
                group = 0.0
                if only is not None and i != only:
                    continue
                gain = float(_both(lg, lh, ln, rg, rh, rn, r, parent, lo, hi, 0, l2))
                if gain > shift and (best is None or gain > best[0]):
                    best = (gain, order[: i + 1], lg, lh, ln, rg, rh, rn)
    if best is None:
        return None
    gain, bins, lg, lh, ln, rg, rh, rn = best
    out = lambda a, c, k: float(leaf_output(a, c, r, k, parent, lo, hi, l2))
    return Split(m.feature, gain - shift, 0, list(bins), False, float(lg), float(lh - EPS), int(ln), float(rg), float(rh - EPS), int(rn), out(lg, lh, ln), out(rg, rh, rn))


def best_split(mappers: list[BinMapper], hist: np.ndarray, total: tuple[float, float, int], r: Rules, parent: float, lo=-math.inf, hi=math.inf, allowed=None, monotone=None, contri=None, penalty=None, depth_penalty: float = 1.0, random_bins=None) -> Split | None:
    """The leaf's best split: highest gain, then the smaller feature. hist: features x bins x 2, in the order of mappers.

    allowed: feature numbers that may be used; penalty: feature -> amount taken from its gain; random_bins: feature -> the only bin tried.
    """
    g, h, n = total
    h = h + 2 * EPS
    if n < 2 * r.min_data or h < 2 * r.min_hessian:
        return None
    shift = float(leaf_gain(g, h, r, n, parent)) + r.min_gain if r.path_smooth <= 0 else float(gain_given(g, h, parent, r)) + r.min_gain
    best = None
    for i, m in enumerate(mappers):
        if allowed is not None and m.feature not in allowed:
            continue
        only = None if random_bins is None else random_bins.get(m.feature)
        if m.categorical:
            s = categorical_split(m, hist[i], g, h, n, r, parent, shift, lo, hi, only)
        else:
            s = numeric_split(m, hist[i], g, h, n, r, parent, shift, lo, hi, (monotone or {}).get(m.feature, 0), only)
        if s is None:
            continue
        gain = s.gain
        if contri:
            gain *= contri[m.feature]
        if s.monotone:
            gain *= depth_penalty
        if penalty:
            gain -= penalty(m.feature) if callable(penalty) else penalty.get(m.feature, 0.0)
        if gain > 0 and (best is None or gain > best.gain):
            best = replace(s, gain=gain)
    return best


def monotone_depth_penalty(depth: int, penalty: float) -> float:
    if penalty >= depth + 1.0:
        return EPS
    if penalty <= 1.0:
        return 1.0 - penalty / 2.0**depth + EPS
    return 1.0 - 2.0 ** (penalty - 1.0 - depth) + EPS
