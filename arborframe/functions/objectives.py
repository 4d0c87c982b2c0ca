"""Losses as Column expressions: gradient and hessian projections, starting scores and output transforms.

Scores are double; gradients and hessians are rounded to float, as the histograms expect them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-15
#: Other names of the objectives.
NAMES = {
    "l2": "regression", "mse": "regression", "mean_squared_error": "regression", "rmse": "regression", "l2_root": "regression", "regression_l2": "regression",
    "l1": "regression_l1", "mae": "regression_l1", "mean_absolute_error": "regression_l1", "mean_absolute_percentage_error": "mape",
    "softmax": "multiclass", "multiclass_ova": "multiclassova", "ova": "multiclassova", "ovr": "multiclassova", "xentropy": "cross_entropy", "xentlambda": "cross_entropy_lambda",
    "xendcg": "rank_xendcg", "xe_ndcg": "rank_xendcg",
}
OBJECTIVES = (
    "regression", "regression_l1", "huber", "fair", "poisson", "quantile", "mape", "gamma", "tweedie",
    "binary", "multiclass", "multiclassova", "cross_entropy", "cross_entropy_lambda", "lambdarank", "rank_xendcg", "custom",
)


def canonical(name: str) -> str:
    name = NAMES.get(name, name)
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective {name!r}")
    return name


def sgn(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def sigmoid(x: Column, slope: float = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * x))


def _weighted(g: Column, h: Column, w: Column | None) -> tuple[Column, Column]:
    if w is not None:
        g, h = g * w, h * w
    return g.cast("float"), h.cast("float")


def _regression(s, y, w, p):
    return _weighted(s - y, F.lit(1.0), w)


def _l1(s, y, w, p):
    return _weighted(sgn(s - y), F.lit(1.0), w)


def _huber(s, y, w, p):
    d, a = s - y, p.get("alpha", 0.9)
    return _weighted(F.when(F.abs(d) <= a, d).otherwise(sgn(d) * a), F.lit(1.0), w)


def _fair(s, y, w, p):
    d, c = s - y, p.get("fair_c", 1.0)
    t = F.abs(d) + c
    return _weighted(c * d / t, c * c / (t * t), w)


def _poisson(s, y, w, p):
    return _weighted(F.exp(s) - y, F.exp(s + p.get("poisson_max_delta_step", 0.7)), w)


def _quantile(s, y, w, p):
    a = p.get("alpha", 0.9)
    return _weighted(F.when((s - y).cast("float") >= 0, 1.0 - a).otherwise(-a), F.lit(1.0), w)


def mape_weight(y: Column, w: Column | None = None) -> Column:
    out = 1.0 / F.greatest(F.lit(1.0), F.abs(y))
    return (out if w is None else out * w).cast("float")


def _mape(s, y, w, p):
    return (sgn(s - y) * mape_weight(y, w)).cast("float"), (F.lit(1.0) if w is None else w).cast("float")


def _gamma(s, y, w, p):
    e = y * F.exp(-s)
    return _weighted(1.0 - e, e, w)


def _tweedie(s, y, w, p):
    r = p.get("tweedie_variance_power", 1.5)
    a, b = F.exp((1.0 - r) * s), F.exp((2.0 - r) * s)
    return _weighted(-y * a + b, -y * (1.0 - r) * a + (2.0 - r) * b, w)


def _binary(s, y, w, p):
    k = p.get("sigmoid", 1.0)
    positive = y > 0
    label = F.when(positive, 1.0).otherwise(-1.0)
    side = F.when(positive, float(p.get("positive_weight", 1.0))).otherwise(float(p.get("negative_weight", 1.0)))
    r = -label * k / (1.0 + F.exp(label * k * s))
    return _weighted(r * side, F.abs(r) * (k - F.abs(r)) * side, w)


def _cross_entropy(s, y, w, p):
    e = F.exp(-s)
    g = F.when(s > -37.0, ((1.0 - y) - y * e) / (1.0 + e)).otherwise(F.exp(s) - y)
    h = F.when(s > -37.0, e / ((1.0 + e) * (1.0 + e))).otherwise(F.exp(s))
    return _weighted(g, h, w)


def _cross_entropy_lambda(s, y, w, p):
    if w is None:
        z = sigmoid(s)
        return (z - y).cast("float"), (z * (1.0 - z)).cast("float")
    e = F.exp(s)
    hhat = F.log1p(e)
    z = 1.0 - F.exp(-w * hhat)
    enf = 1.0 / e
    g = (1.0 - y / z) * w / (1.0 + enf)
    c = 1.0 / (1.0 - z)
    d = 1.0 + e
    a = w * e / (d * d)
    d = c - 1.0
    b = (c / (d * d)) * (1.0 + w * e - c)
    return g.cast("float"), (a * (1.0 + y * b)).cast("float")


_POINTWISE: dict[str, Callable] = {
    "regression": _regression, "regression_l1": _l1, "huber": _huber, "fair": _fair, "poisson": _poisson, "quantile": _quantile, "mape": _mape, "gamma": _gamma,
    "tweedie": _tweedie, "binary": _binary, "cross_entropy": _cross_entropy, "cross_entropy_lambda": _cross_entropy_lambda,
}


def gradients(name: str, score: Column, label: Column, weight: Column | None = None, **params) -> tuple[Column, Column]:
    """(gradient, hessian) of a loss on single scores."""
    return _POINTWISE[canonical(name)](score, label, weight, params)


def softmax(scores: Column) -> Column:
    """Of an array of scores, shifted by the largest."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def multiclass_gradients(scores: Column, label: Column, classes: int, weight: Column | None = None, one_vs_all: bool = False, **params) -> list[tuple[Column, Column]]:
    """(gradient, hessian) for each class; scores: array column."""
    out = []
    p = None if one_vs_all else softmax(scores)
    for k in range(classes):
        if one_vs_all:
            out.append(_binary(F.element_at(scores, k + 1), F.when(label.cast("int") == k, 1.0).otherwise(0.0), weight, params))
        else:
            x = F.element_at(p, k + 1)
            out.append(_weighted(x - F.when(label.cast("int") == k, 1.0).otherwise(0.0), (classes / (classes - 1.0)) * x * (1.0 - x), weight))
    return out


def class_weights(df: DataFrame, label: str, is_unbalance: bool = False, scale_pos_weight: float = 1.0) -> dict[str, float]:
    """Weights of the two classes for the binary loss."""
    if not is_unbalance:
        return {"positive_weight": scale_pos_weight, "negative_weight": 1.0}
    r = df.agg(F.sum((F.col(label) > 0).cast("long")).alias("p"), F.count("*").alias("n")).first()
    pos, neg = r.p or 0, (r.n or 0) - (r.p or 0)
    if pos and neg and pos > neg:
        return {"positive_weight": 1.0, "negative_weight": pos / neg}
    return {"positive_weight": neg / pos if pos and neg else 1.0, "negative_weight": 1.0}


def average(label: Column, weight: Column | None = None) -> Column:
    return F.avg(label) if weight is None else F.sum(label * weight) / F.sum(weight)


def start_score(name: str, label: Column, weight: Column | None = None, **params) -> Column:
    """Aggregate that gives the constant score to start from."""
    name = canonical(name)
    if name in ("regression", "huber", "fair"):
        return average(label, weight)
    if name in ("poisson", "gamma", "tweedie"):
        return F.ln(average(label, weight))
    if name in ("regression_l1", "quantile", "mape"):
        raise ValueError(f"{name}: starts from a percentile, see start_value")
    if name in ("binary", "cross_entropy"):
        x = average((label > 0).cast("double"), weight) if name == "binary" else average(label, weight)
        p = F.least(F.greatest(x, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
        return F.ln(p / (1.0 - p)) / params.get("sigmoid", 1.0)
    if name == "cross_entropy_lambda":
        return F.ln(F.expm1(average(label, weight)))
    return F.lit(0.0)


def start_value(df: DataFrame, name: str, label: Column, weight: Column | None = None, order: Column | None = None, **params) -> float | None:
    """The constant score to start from. Losses that start from a percentile find it in ranges of the labels; order settles ties of weighted ones."""
    name = canonical(name)
    if name not in ("regression_l1", "quantile", "mape"):
        return df.agg(start_score(name, label, weight, **params).alias("x")).first().x
    alpha = params.get("alpha", 0.9) if name == "quantile" else 0.5
    if name == "mape":
        weight = mape_weight(label, weight)
    if weight is None:
        return percentile(df.select(label.cast("double").alias("v")), "v", alpha).first().result
    rows = df.select(label.cast("double").alias("v"), weight.cast("double").alias("w"), (F.monotonically_increasing_id() if order is None else order).alias("o"))
    r = weighted_percentile(rows, "v", "w", alpha, order="o").first()
    return None if r is None else r.result


def class_start_scores(df: DataFrame, label: str, classes: int, weight: str | None = None) -> list[float]:
    """ln of each class's share, at least EPSILON."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    r = df.agg(F.sum(w).alias("t"), *(F.sum(F.when(F.col(label).cast("int") == k, w).otherwise(0.0)).alias(f"c{k}") for k in range(classes))).first()
    import math

    return [math.log(max(EPSILON, (r[f"c{k}"] or 0.0) / r.t)) for k in range(classes)]


def settled(df: DataFrame, *cached: DataFrame) -> DataFrame:
    """The few rows of df, made now, so that what it was made from can leave the cache."""
    rows, schema = df.collect(), df.schema
    for x in cached:
        x.unpersist()
    return df.sparkSession.createDataFrame(rows, schema)


def _running(groups: DataFrame, by: list[str], value: str, size: str) -> tuple[DataFrame, DataFrame]:
    """groups (by..., value, size, ...), one per distinct value, with _b: the sizes of the lesser values of the same `by`, and _t: of all. Sums
    run inside ranges of (by, value) and then over the ranges' totals, so that no task sees all values of a group. Second: what is cached, as both use the same ranges."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartitionByRange(n, *by, value).withColumn("_p", F.spark_partition_id()).persist()
    totals = dealt.groupBy(*by, "_p").agg(F.sum(size).alias("_s"))  # a row for each range and group in it
    line = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    base = totals.select(*by, "_p", F.coalesce(F.sum("_s").over(line.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(line).alias("_t"))
    inside = Window.partitionBy("_p", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return run.join(base, [*by, "_p"]).withColumn("_b", F.col("_before") + F.col("_in")).drop("_in", "_before", "_p"), dealt


def percentile(df: DataFrame, value: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """(by..., result): the value at place alpha * (n - 1) of the n sorted values, between two of them in proportion. Nulls and NaN have no place."""
    by = by or []
    groups = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count("*").alias("_n"))
    at = F.lit(float(alpha)) * (F.col("_t") - 1)
    has = lambda place: (F.col("_b") <= place) & (place < F.col("_b") + F.col("_n"))
    run, cached = _running(groups, by, value, "_n")
    run = run.withColumn("_at", at)
    near = run.groupBy(*by).agg(F.max(F.when(has(F.floor("_at")), F.col(value))).alias("_lo"), F.max(F.when(has(F.ceil("_at")), F.col(value))).alias("_hi"), F.max("_at").alias("_at"))
    return settled(near.where("_at is not null").select(*by, (F.col("_lo") + (F.col("_at") - F.floor("_at")) * (F.col("_hi") - F.col("_lo"))).alias("result")), cached)


def weighted_percentile(df: DataFrame, value: str, weight: str, alpha: float, by: list[str] | None = None, order: str = "row_id") -> DataFrame:
    """(by..., result): the value where the running weight passes alpha times the total; between it and the one before it,
    interpolated if the weight steps by 1 or more. A null or NaN value has no place. Rows of one value count in the order of `order`."""
    by = by or []
    rows = df.where(~F.isnan(value) & F.col(value).isNotNull())
    groups = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"), F.min_by(weight, order).alias("_first"))
    run, cached = _running(groups, by, value, "_w")
    goal = F.lit(float(alpha)) * F.col("_t")
    x = run.groupBy(*by).agg(
        F.min(F.when(F.col("_b") + F.col("_w") > goal, F.struct(value, "_b", "_first"))).alias("hit"), F.max(F.when(F.col("_b") + F.col("_w") <= goal, F.col(value))).alias("_vb"),
        F.max(value).alias("_last"), F.max("_t").alias("_t"),
    )
    v, c, step, goal = F.col("hit")[value], F.col("hit._b"), F.col("hit._first"), F.lit(float(alpha)) * F.col("_t")
    inside = F.col("_vb").isNull() | (goal >= c + step)  # the first of all, or a later row of one value
    mid = F.col("_vb") + (goal - c) / step * (v - F.col("_vb"))
    out = F.when(F.col("hit").isNull(), F.col("_last")).when(inside, v).when(step >= 1.0, mid).otherwise(F.col("_vb"))
    return settled(x.where("_last is not null").select(*by, out.alias("result")), cached)


def transform(name: str, score: Column, **params) -> Column:
    """Raw score to output."""
    name = canonical(name)
    if name in ("poisson", "gamma", "tweedie"):
        return F.exp(score)
    if name == "binary":
        return sigmoid(score, params.get("sigmoid", 1.0))
    if name == "cross_entropy":
        return sigmoid(score)
    if name == "cross_entropy_lambda":
        return F.log1p(F.exp(score))
    if name == "multiclass":
        return softmax(score)
    if name == "multiclassova":
        return F.transform(score, lambda s: sigmoid(s, params.get("sigmoid", 1.0)))
    if params.get("reg_sqrt") and name in ("regression", "regression_l1", "huber", "fair", "quantile", "mape"):
        return sgn(score) * score * score
    return score


def clamped(x: Column, limit: float = 1e38) -> Column:
    """NaN and null become 0; infinities the limit."""
    x = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))


def check_labels(df: DataFrame, name: str, label: str) -> None:
    """Raises if the labels don't fit the objective."""
    name = canonical(name)
    r = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.sum(label).alias("s")).first()
    if r.lo is None:
        return
    if name in ("poisson", "gamma", "tweedie") and (r.lo < 0 or r.s == 0):
        raise ValueError(f"{name}: labels must not be negative, nor all 0")
    if name == "gamma" and r.lo <= 0:
        raise ValueError("gamma: labels must be positive")
    if name in ("cross_entropy", "cross_entropy_lambda") and (r.lo < 0 or r.hi > 1):
        raise ValueError(f"{name}: labels must be in [0, 1]")
