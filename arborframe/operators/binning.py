"""Bin mappers: found from a bounded sample of rows, one feature per group, and applied to all rows as expressions or arrays."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 1e-35
#: A share of rows in one bin from which that bin counts as the most frequent one.
SPARSE = 0.7


@dataclass
class BinMapper:
    """How one feature's values become bins."""

    feature: int
    name: str
    categorical: bool = False
    missing: str = "none"  # none, zero or nan
    bounds: list[float] = field(default_factory=list)  # upper bounds of numeric bins; with missing "nan" one more bin holds NaN
    cats: list[int] = field(default_factory=list)  # category of bin 1, 2, ...; bin 0 is all others
    num_bin: int = 1
    default_bin: int = 0
    most_freq_bin: int = 0
    trivial: bool = True
    low: float = 0.0
    high: float = 0.0
    sparse_rate: float = 0.0

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bins of raw values (double, NaN for missing)."""
        v = np.asarray(values, np.float64)
        if self.categorical:
            ok = np.isfinite(v) & (v >= 0) & (v < 2**31)
            code = np.where(ok, v, -1).astype(np.int64)
            out = np.zeros(len(v), np.int64)
            if self.cats:
                order = np.argsort(self.cats)
                known = np.array(self.cats, np.int64)[order]
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                out = np.where(known[at] == code, order[at] + 1, 0)
            return out
        nan = np.isnan(v)
        if self.missing == "zero":
            v = np.where(nan, 0.0, v)
        bound = np.array(self.bounds)
        out = np.minimum(np.searchsorted(bound, np.where(nan, 0.0, v), "left"), len(bound) - 1)
        return np.where(nan, self.num_bin - 1, out) if self.missing == "nan" else out

    def column(self, c: Column) -> Column:
        """The same as an expression."""
        c = F.coalesce(c.cast("double"), F.lit(float("nan")))
        if self.categorical:
            out = F.lit(0)
            code = F.when(F.isnan(c) | (c < 0) | (c >= 2.0**31), F.lit(-1)).otherwise(c.cast("int"))
            if self.cats:
                table = F.create_map(*[x for i, k in enumerate(self.cats) for x in (F.lit(k), F.lit(i + 1))])
                out = F.coalesce(F.element_at(table, code), F.lit(0))
            return out.cast("int")
        v = F.nanvl(c, F.lit(0.0))
        inner = self.bounds[:-1]
        out = F.size(F.filter(F.array(*[F.lit(float(b)) for b in inner]), lambda b: b < v)) if inner else F.lit(0)
        return (F.when(F.isnan(c), self.num_bin - 1).otherwise(out) if self.missing == "nan" else out).cast("int")

    def value(self, b: int) -> float:
        """The threshold that stands for a bin: its upper bound, or its category."""
        return float(self.cats[b - 1]) if self.categorical else self.bounds[b]

    def info(self) -> str:
        if self.trivial:
            return "none"
        if self.categorical:
            return ":".join(str(c) for c in sorted(self.cats))
        return f"[{self.low:.17g}:{self.high:.17g}]"


def _next_up(x: float) -> float:
    return math.nextafter(x, math.inf)


def _between(values: np.ndarray, ends: np.ndarray) -> list[float]:
    """Bounds half way between each value in ends (indices) and the next one, just above; the last is infinity. A bound that isn't above the one before it is left out."""
    if not len(ends):
        return [math.inf]
    half = np.nextafter((values[ends] + values[ends + 1]) / 2.0, math.inf)
    above = np.maximum.accumulate(np.concatenate([[-math.inf], half[:-1]]))
    return [*half[half > above].tolist(), math.inf]


def greedy_bounds(values: np.ndarray, counts: np.ndarray, max_bin: int, total: int, min_data_in_bin: int) -> list[float]:
    """Upper bounds of at most max_bin bins of about equal counts; the last is infinity. values: distinct, ascending.

    With no more values than bins each value has its own, joined with the next ones until min_data_in_bin rows are in it. Else
    a bin takes values until it reaches the mean of what the bins to come must share. A value that alone reaches the
    overall mean ends its bin, and a bin that is half full ends before it.
    """
    values, n = np.asarray(values, np.float64), len(values)
    if max_bin < 1 or not n:
        return [math.inf] * (max_bin >= 1)
    upto = np.cumsum(counts, dtype=np.int64)  # rows up to and with each value
    reach = lambda need, done: int(np.searchsorted(upto, done + need, "left"))  # noqa: E731  the first value with `need` rows beyond `done`
    ends: list[int] = []
    if n <= max_bin:
        done, last = 0, -math.inf
        while (i := reach(max(min_data_in_bin, 1), done)) < n - 1:
            half = math.nextafter((values[i] + values[i + 1]) / 2.0, math.inf)
            while half <= last and i < n - 2:  # no number lies between: the bin goes on
                i += 1
                half = math.nextafter((values[i] + values[i + 1]) / 2.0, math.inf)
            if half <= last:
                break
            ends.append(i)
            done, last = int(upto[i]), half
        return _between(values, np.array(ends, np.int64))
    if min_data_in_bin > 0:
        max_bin = max(1, min(max_bin, total // min_data_in_bin))
    heavy = np.flatnonzero(counts >= total / max_bin)
    light = upto - np.cumsum(np.where(counts >= total / max_bin, counts, 0))  # rows of light values up to each
    stops = np.append(heavy, n)
    all_light, bins = int(total - counts[heavy].sum()), max_bin - len(heavy)
    mean = all_light / bins if bins else math.inf
    at = done = 0
    while len(ends) < max_bin - 1 and at < n - 1:
        stop = int(stops[np.searchsorted(stops, at)])  # the next heavy value
        full = reach(mean, done) if mean < math.inf else n
        i = min(max(full, at), stop)
        if i >= stop and stop - 1 >= at and upto[stop - 1] - done >= max(1.0, mean * 0.5):
            i = stop - 1  # half full: the heavy value has a bin to itself
        if i >= n - 1:
            break
        ends.append(i)
        at, done = i + 1, int(upto[i])
        if i != stop:
            bins -= 1
            mean = (all_light - int(light[i])) / bins if bins > 0 else math.inf
    return _between(values, np.array(ends, np.int64))


def zero_split_bounds(values: np.ndarray, counts: np.ndarray, max_bin: int, total: int, min_data_in_bin: int) -> list[float]:
    """Negative values, zero and positive values have bins of their own."""
    left, right = values < -ZERO, values > ZERO
    n_left, n_right = int(counts[left].sum()), int(counts[right].sum())
    n_zero = total - n_left - n_right
    out: list[float] = []
    if left.any():
        share = max(1, int(n_left / max(total - n_zero, 1) * (max_bin - 1)))
        out = greedy_bounds(values[left], counts[left], share, n_left, min_data_in_bin)
        out[-1] = -ZERO
    room = max_bin - 1 - len(out)
    if right.any() and room > 0:
        return [*out, ZERO, *greedy_bounds(values[right], counts[right], room, n_right, min_data_in_bin)]
    return [*out, math.inf]


def forced_bounds(values: np.ndarray, counts: np.ndarray, max_bin: int, total: int, min_data_in_bin: int, forced: list[float]) -> list[float]:
    """Bounds around zero and the forced ones come first; the free bins are shared by the counts between them, rounded, and what is left over goes to the last part."""
    around = [b for b, there in ((-ZERO, (values < -ZERO).any()), (ZERO, (values > ZERO).any())) if there]
    own = [float(b) for b in forced if abs(b) > ZERO][: max(0, max_bin - 1 - len(around))]
    fixed = np.array([*sorted({*around, *own}), math.inf])
    edge = np.concatenate([[0], np.searchsorted(values, fixed, "left")])
    rows = np.diff(np.concatenate([[0], np.cumsum(counts)])[edge])
    free = max_bin - len(fixed)
    room = np.floor(rows * free / max(total, 1) + 0.5).astype(np.int64)
    room[-1] = free
    more: list[float] = []
    for a, b, n, some in zip(edge[:-1], edge[1:], rows, room, strict=True):
        some = min(int(some), free - len(more))
        if some > 0 and b > a:
            more += greedy_bounds(values[a:b], counts[a:b], some + 1, int(n), min_data_in_bin)[:-1]
    return sorted({*more, *fixed.tolist()})


def find_mapper(
    feature: int, name: str, values: np.ndarray, total: int, *, max_bin: int = 255, min_data_in_bin: int = 3, use_missing: bool = True, zero_as_missing: bool = False, categorical: bool = False,
    min_split_data: int = 0, pre_filter: bool = True, forced: list[float] | None = None, counts: np.ndarray | None = None,
) -> BinMapper:
    """Bin mapper of a feature from sampled values (NaN: missing); total: rows that the sample has, zeros left out included; counts: rows of each value, by default one."""
    v = np.asarray(values, np.float64)
    times = np.ones(len(v), np.int64) if counts is None else np.asarray(counts, np.int64)
    nan = int(times[np.isnan(v)].sum())
    v, times = v[~np.isnan(v)], times[~np.isnan(v)]
    zeros = total - int(times.sum()) - nan
    m = BinMapper(feature, name, categorical=categorical)
    if categorical:
        v, times = np.append(v, 0.0), np.append(times, max(0, zeros))
        return _categorical(m, v, times, nan + int(times[v < 0].sum()), max_bin, use_missing, min_split_data, pre_filter)
    distinct, counts = _summed(np.where(np.abs(v) <= ZERO, 0.0, v), times)
    if zeros > 0:
        i = int(np.searchsorted(distinct, 0.0))
        if i < len(distinct) and distinct[i] == 0:
            counts[i] += zeros
        else:
            distinct, counts = np.insert(distinct, i, 0.0), np.insert(counts, i, zeros)
    if not use_missing:
        m.missing = "none"
    elif zero_as_missing:
        m.missing = "zero"
    else:
        m.missing = "nan" if nan else "none"
    if m.missing != "nan" and nan:  # counted as 0
        i = int(np.searchsorted(distinct, 0.0))
        if i < len(distinct) and distinct[i] == 0:
            counts[i] += nan
        else:
            distinct, counts = np.insert(distinct, i, 0.0), np.insert(counts, i, nan)
    if not len(distinct):
        return m
    m.low, m.high = float(distinct[0]), float(distinct[-1])
    room, rows = (max_bin - 1, total - nan) if m.missing == "nan" else (max_bin, total)
    find = (lambda: forced_bounds(distinct, counts, room, rows, min_data_in_bin, forced)) if forced else (lambda: zero_split_bounds(distinct, counts, room, rows, min_data_in_bin))
    m.bounds = find()
    if m.missing == "zero" and len(m.bounds) == 2:
        m.missing = "none"
    at = np.minimum(np.searchsorted(m.bounds, distinct, "left"), len(m.bounds) - 1)
    in_bin = np.bincount(at, counts, len(m.bounds)).astype(np.int64)
    m.num_bin = len(m.bounds) + (m.missing == "nan")
    if m.missing == "nan":
        in_bin = np.append(in_bin, nan)
    m.trivial = m.num_bin <= 1 or (pre_filter and not _splittable(in_bin, min_split_data, False))
    m.default_bin = int(m.bins(np.zeros(1))[0])
    _frequent(m, in_bin, total)
    return m


def _summed(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values that have rows, ascending, and their rows."""
    values, times = values[times > 0], times[times > 0]
    distinct, at = np.unique(values, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, at, times)
    return distinct, counts


def _categorical(m: BinMapper, v: np.ndarray, times: np.ndarray, nan: int, max_bin: int, use_missing: bool, min_split_data: int, pre_filter: bool) -> BinMapper:
    cats, counts = _summed(v[v >= 0].astype(np.int64), times[v >= 0])
    order = np.lexsort((cats, -counts))
    cats, counts = cats[order], counts[order]
    total = int(counts.sum())
    need, have, keep = round(0.99 * total), 0, 0
    while keep < len(cats) and keep + 1 < max_bin and (have < need or len(cats) < max_bin):
        have += int(counts[keep])
        keep += 1
    m.cats = [int(c) for c in cats[:keep]]
    m.num_bin = keep + 1
    m.missing = "nan" if use_missing and (nan or keep < len(cats)) else "none"
    in_bin = np.concatenate([[total - have + nan], counts[:keep]])
    m.trivial = m.num_bin <= 2 and in_bin[0] == 0 or keep == 0 or (pre_filter and not _splittable(in_bin, min_split_data, True))
    _frequent(m, in_bin, total + nan)
    return m


def _splittable(in_bin: np.ndarray, least: int, categorical: bool) -> bool:
    """Can some split leave `least` rows on both sides?"""
    total = int(in_bin.sum())
    left = in_bin if categorical and len(in_bin) > 2 else np.cumsum(in_bin)[:-1]
    return bool(((left >= least) & (total - left >= least)).any()) if len(left) else False


def _frequent(m: BinMapper, in_bin: np.ndarray, total: int) -> None:
    m.most_freq_bin = int(np.argmax(in_bin))
    share = in_bin[m.most_freq_bin] / max(total, 1)
    if share < SPARSE:
        m.most_freq_bin = m.default_bin
    m.sparse_rate = float(in_bin[m.most_freq_bin] / max(total, 1))


_FOUND = "mapper string"


def value_counts(rows: DataFrame) -> DataFrame:
    """(feature, v, c): rows of each distinct value of each column f0, f1, ...; zeros, which are what is left of all rows, are left out. Spark sums inside each partition before it shuffles."""
    cells = F.posexplode(F.array(*[f"f{i}" for i in range(len(rows.columns))])).alias("feature", "v")
    return rows.select(cells).where(F.isnan("v") | (F.abs("v") > ZERO)).groupBy("feature", "v").agg(F.count("*").alias("c"))


def bin_counts(df: DataFrame, m: BinMapper, c: Column) -> DataFrame:
    """(bin, n) of a column."""
    return df.groupBy(m.column(c).alias("bin")).agg(F.count("*").alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """The row of (bin, n) with the largest n, of equal ones the smallest bin."""
    return counts.agg(F.max_by(F.struct("bin", "n"), F.struct("n", -F.col("bin"))).alias("x")).select("x.bin", "x.n")


def _sampled(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """A share `rate` of the rows, drawn by a hash of a row's place in the table: equal rows are drawn independently, and nothing is shuffled."""
    u = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), 11) / F.lit(float(2**53))
    return rows.withColumn("u", u).where(F.col("u") < rate).drop("u")


def find_mappers(df: DataFrame, features: list[str], categorical: set[str] = frozenset(), n: int | None = None, sample: int | None = 200_000, params: dict | None = None) -> list[BinMapper]:
    """Mappers of all features, each found by its own task from the value counts of about `sample` rows, or of all rows if it is None."""
    p = params or {}
    n = df.count() if n is None else n
    cols = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))).alias(f"f{i}") for i, f in enumerate(features)]
    rows, drawn = df.select(*cols), sample is not None and n > sample
    rows = _sampled(rows, sample / n, p.get("data_random_seed", 1)).persist() if drawn else rows
    total = rows.count() if drawn else n
    least = int(p.get("min_data_in_leaf", 20) * total / n) if n else 0
    by_feature, forced = p.get("max_bin_by_feature"), p.get("forced_bins") or {}
    kinds = [f in categorical for f in features]

    def find(key, table):
        i = key[0].as_py()
        m = find_mapper(
            i, features[i], np.asarray(table.column("v").combine_chunks()), total, counts=np.asarray(table.column("c").combine_chunks()), max_bin=by_feature[i] if by_feature else p.get("max_bin", 255), min_data_in_bin=p.get("min_data_in_bin", 3),
            use_missing=p.get("use_missing", True), zero_as_missing=p.get("zero_as_missing", False), categorical=kinds[i], min_split_data=least, pre_filter=p.get("feature_pre_filter", True), forced=forced.get(i),
        )
        return pa.table({"mapper": [json.dumps(asdict(m))]})

    got = {m.feature: m for m in (BinMapper(**json.loads(r.mapper)) for r in value_counts(rows).groupBy("feature").applyInArrow(find, _FOUND).collect())}
    if drawn:
        rows.unpersist()
    for i, f in enumerate(features):
        if i not in got:  # all zero
            got[i] = find_mapper(i, f, np.zeros(0), total, categorical=kinds[i])
    return [got[i] for i in range(len(features))]


def read_forced_bins(spark, path: str) -> dict[int, list[float]]:
    """A JSON list of {feature, bin_upper_bound}."""
    rows = spark.read.option("multiLine", True).schema("feature int, bin_upper_bound array<double>").json(path).collect()
    return {r.feature: sorted(set(r.bin_upper_bound)) for r in rows if r.feature is not None and r.bin_upper_bound}
