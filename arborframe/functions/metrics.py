"""Evaluation metrics as aggregates. The tie-aware ones group equal scores first, so no order among ties matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .objectives import settled

EPSILON = 1e-15
HIGHER = {"auc", "average_precision", "r2", "auc_mu", "ndcg", "map"}
NAMES = {
    "mse": "l2", "mean_squared_error": "l2", "regression": "l2", "regression_l2": "l2", "l2_root": "rmse", "root_mean_squared_error": "rmse", "mae": "l1", "mean_absolute_error": "l1", "regression_l1": "l1",
    "mean_absolute_percentage_error": "mape", "binary": "binary_logloss", "multiclass": "multi_logloss", "softmax": "multi_logloss", "multiclassova": "multi_logloss", "ova": "multi_logloss", "ovr": "multi_logloss",
    "xentropy": "cross_entropy", "xentlambda": "cross_entropy_lambda", "kldiv": "kullback_leibler", "lambdarank": "ndcg", "rank_xendcg": "ndcg", "xendcg": "ndcg", "mean_average_precision": "map",
}
METRICS = (
    "l2", "rmse", "l1", "quantile", "huber", "fair", "poisson", "mape", "gamma", "gamma_deviance", "tweedie", "binary_logloss", "binary_error", "auc", "average_precision", "r2",
    "multi_logloss", "multi_error", "auc_mu", "ndcg", "map", "cross_entropy", "cross_entropy_lambda", "kullback_leibler",
)


def canonical(name: str) -> str:
    return NAMES.get(name, name)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def loss(name: str, p: Column, y: Column, **params) -> Column:
    """Loss of one row; p is the transformed output."""
    d = y - p
    if name in ("l2", "rmse"):
        return d * d
    if name == "l1":
        return F.abs(d)
    if name == "quantile":
        a = params.get("alpha", 0.9)
        return F.when(d < 0, (a - 1.0) * d).otherwise(a * d)
    if name == "huber":
        a = params.get("alpha", 0.9)
        return F.when(F.abs(d) <= a, 0.5 * d * d).otherwise(a * (F.abs(d) - 0.5 * a))
    if name == "fair":
        c, x = params.get("fair_c", 1.0), F.abs(d)
        return c * x - c * c * F.log1p(x / c)
    if name == "poisson":
        q = F.greatest(p, F.lit(1e-10))
        return q - y * F.ln(q)
    if name == "mape":
        return F.abs(d) / F.greatest(F.lit(1.0), F.abs(y))
    if name == "gamma":
        return y / p + F.ln(p)
    if name == "gamma_deviance":
        t = y / (p + 1e-9)
        return t - _log(t) - 1.0
    if name == "tweedie":
        r, q = params.get("tweedie_variance_power", 1.5), F.greatest(p, F.lit(1e-10))
        return -y * F.exp((1.0 - r) * F.ln(q)) / (1.0 - r) + F.exp((2.0 - r) * F.ln(q)) / (2.0 - r)
    if name == "binary_logloss":
        q = F.when(y > 0, p).otherwise(1.0 - p)
        return -F.ln(F.greatest(q, F.lit(EPSILON)))
    if name == "binary_error":
        return ((p > 0.5) != (y > 0)).cast("double")
    if name in ("cross_entropy", "kullback_leibler"):
        a, b = F.greatest(p, F.lit(1e-12)), F.greatest(1.0 - p, F.lit(1e-12))
        return -(y * F.ln(a) + (1.0 - y) * F.ln(b))
    raise ValueError(f"unknown metric {name!r}")


def entropy(y: Column) -> Column:
    part = lambda q: F.when(q > 0, q * F.ln(q)).otherwise(0.0)
    return part(y) + part(1.0 - y)


def pointwise(name: str, p: Column, y: Column, w: Column | None = None, **params) -> Column:
    """Aggregate: weighted mean of the loss (root for rmse, twice the sum for gamma_deviance)."""
    x = loss(name, p, y, **params)
    if name == "kullback_leibler":
        x = x + entropy(y)
    total, weight = (F.sum(x), F.count(x).cast("double")) if w is None else (F.sum(x * w), F.sum(w))
    if name == "gamma_deviance":
        return 2.0 * total
    return F.sqrt(total / weight) if name == "rmse" else total / weight


def cross_entropy_lambda(score: Column, y: Column, w: Column | None = None) -> Column:
    """On raw scores; weights act inside the loss, the mean is over rows."""
    h = F.log1p(F.exp(score)) if w is None else F.log1p(F.exp(score)) * w
    z = 1.0 - F.exp(-h)
    a, b = F.greatest(z, F.lit(1e-12)), F.greatest(1.0 - z, F.lit(1e-12))
    return F.avg(-(y * F.ln(a) + (1.0 - y) * F.ln(b)))


def r2(p: Column, y: Column, w: Column | None = None) -> Column:
    """1 - RSS / TSS; with TSS 0 it is 1 if RSS is 0 too, else 0."""
    w = F.lit(1.0) if w is None else w
    rss = F.sum(w * (y - p) * (y - p))
    tss = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    return F.when(tss > 0, 1.0 - rss / tss).when(rss > 0, 0.0).otherwise(1.0)


def _ties(df: DataFrame, score: str, label: str, weight: str | None) -> tuple[DataFrame, DataFrame]:
    w = F.lit(1.0) if weight is None else F.col(weight)
    groups = df.groupBy(F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) > 0, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) > 0, 0.0).otherwise(w)).alias("neg"))
    return running_above(groups)


def running_above(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (_s, pos, neg), one per distinct score, with the sums of those that score higher. The sums run inside ranges
    of the score and then over the ranges' totals, so no task sees all scores. Second: what is cached for it."""
    spark = groups.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartitionByRange(n, F.col("_s").desc()).withColumn("_p", F.spark_partition_id()).persist()
    totals = dealt.groupBy("_p").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = totals.select("_p", F.coalesce(F.sum("tp").over(before), F.lit(0.0)).alias("bp"), F.coalesce(F.sum("tn").over(before), F.lit(0.0)).alias("bn"))
    inside = Window.partitionBy("_p").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.select("*", F.coalesce(F.sum("pos").over(inside), F.lit(0.0)).alias("ip"), F.coalesce(F.sum("neg").over(inside), F.lit(0.0)).alias("in_"))
    return run.join(F.broadcast(base), "_p").select("_s", "pos", "neg", (F.col("ip") + F.col("bp")).alias("pos_above"), (F.col("in_") + F.col("bn")).alias("neg_above")), dealt


def auc(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """(value): area under the ROC curve; 1 if there is one class only."""
    ties, cached = _ties(df, score, label, weight)
    t = ties.agg(F.sum(F.col("neg") * (F.col("pos") / 2 + F.col("pos_above"))).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return settled(t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / (F.col("p") * F.col("n"))).otherwise(1.0).alias("value")), cached)


def average_precision(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """(value): over groups of equal score, positives times the precision down to the group; 1 if there is no positive or no negative."""
    up = F.col("pos") + F.col("pos_above")
    ties, cached = _ties(df, score, label, weight)
    t = ties.agg(F.sum(F.col("pos") * up / F.greatest(up + F.col("neg") + F.col("neg_above"), F.lit(1e-300))).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return settled(t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / F.col("p")).otherwise(1.0).alias("value")), cached)


def multi_logloss(probabilities: Column, y: Column, w: Column | None = None) -> Column:
    p = F.greatest(F.element_at(probabilities, y.cast("int") + 1), F.lit(EPSILON))
    return F.avg(-F.ln(p)) if w is None else F.sum(-F.ln(p) * w) / F.sum(w)


def multi_error(probabilities: Column, y: Column, w: Column | None = None, top_k: int = 1) -> Column:
    """A row is wrong if more than top_k classes score at least as high as its own, itself included."""
    own = F.element_at(probabilities, y.cast("int") + 1)
    wrong = (F.size(F.filter(probabilities, lambda s: s >= own)) > top_k).cast("double")
    return F.avg(wrong) if w is None else F.sum(wrong * w) / F.sum(w)


def auc_mu(df: DataFrame, scores: str, label: str, classes: int, weight: str | None = None, matrix: list[list[float]] | list[float] | None = None) -> DataFrame:
    """(value): mean over pairs of classes of the AUC of the scores projected on the pair's partition vector."""
    if matrix and not isinstance(matrix[0], (list, tuple)):  # row after row
        if len(matrix) != classes * classes:
            raise ValueError("auc_mu_weights must have classes * classes values")
        matrix = [list(matrix[i * classes : (i + 1) * classes]) for i in range(classes)]
    a = matrix or [[0.0 if i == j else 1.0 for j in range(classes)] for i in range(classes)]
    parts = []
    for i in range(classes):
        for j in range(i + 1, classes):
            v = [a[i][k] - a[j][k] for k in range(classes)]
            sign = v[i] - v[j]
            dist = sum((F.element_at(scores, k + 1) * F.lit(v[k]) for k in range(classes)), F.lit(0.0)) * F.lit(sign)
            own = df.where(F.col(label).cast("int").isin(i, j)).select(F.round(dist, 12).alias("s"), (F.col(label).cast("int") == i).cast("int").alias("y"), *([F.col(weight).alias("w")] if weight else []))
            parts.append(auc(own, "s", "y", "w" if weight else None))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out.agg(F.avg("value").alias("value"))


def ranked(df: DataFrame, query: str, score: str, label: str, order: str) -> DataFrame:
    """Rows with their place by score (ties by order) and the place of their label among the query's labels, both from 0."""
    q = Window.partitionBy(query)
    return df.select("*", (F.row_number().over(q.orderBy(F.col(score).desc(), order)) - 1).alias("rank"), (F.row_number().over(q.orderBy(F.col(label).desc(), order)) - 1).alias("ideal"))


def label_gain(label: Column, gains: list[float] | None = None) -> Column:
    """2^label - 1, or the given gain of each label."""
    if gains:
        return F.element_at(F.array(*[F.lit(float(g)) for g in gains]), label.cast("int") + 1)
    return F.pow(F.lit(2.0), label) - 1.0


def ndcg(df: DataFrame, query: str, score: str, label: str, order: str, ks: tuple[int, ...] = (1, 2, 3, 4, 5), weight: str | None = None, gains: list[float] | None = None) -> DataFrame:
    """(k, value): mean over queries (weighted by the mean row weight of a query) of DCG / best DCG; 1 where nothing is relevant."""
    r = ranked(df, query, score, label, order)
    part = lambda place, k: F.sum(F.when(F.col(place) < k, label_gain(F.col(label), gains) / F.log2(F.col(place) + 2.0)).otherwise(0.0))
    per = r.groupBy(query).agg(*(part("rank", k).alias(f"d{k}") for k in ks), *(part("ideal", k).alias(f"m{k}") for k in ks), (F.lit(1.0) if weight is None else F.avg(weight)).alias("w"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col(f"m{k}") > 0, F.col(f"d{k}") / F.col(f"m{k}")).otherwise(1.0).alias("v")) for k in ks)))
    return per.select("w", rows.alias("x")).groupBy(F.col("x.k").alias("k")).agg((F.sum(F.col("x.v") * F.col("w")) / F.sum("w")).alias("value"))


def mean_average_precision(df: DataFrame, query: str, score: str, label: str, order: str, ks: tuple[int, ...] = (1, 2, 3, 4, 5), weight: str | None = None) -> DataFrame:
    """(k, value): precision at each hit among the first k, over min(positives, k); 1 where nothing is relevant."""
    r = ranked(df, query, score, label, order).withColumn("hit", (F.col(label) > 0.5).cast("double"))
    q = Window.partitionBy(query)
    r = r.select(query, "rank", "hit", (F.lit(1.0) if weight is None else F.col(weight)).alias("w"), F.sum("hit").over(q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    per = r.groupBy(query).agg(F.sum("hit").alias("n"), F.avg("w").alias("w"), *(F.sum(F.when((F.col("rank") < k) & (F.col("hit") > 0), F.col("hits") / (F.col("rank") + 1.0)).otherwise(0.0)).alias(f"s{k}") for k in ks))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col("n") > 0, F.col(f"s{k}") / F.least(F.col("n"), F.lit(float(k)))).otherwise(1.0).alias("v")) for k in ks)))
    return per.select("w", rows.alias("x")).groupBy(F.col("x.k").alias("k")).agg((F.sum(F.col("x.v") * F.col("w")) / F.sum("w")).alias("value"))
