"""Ranking operators on rows of queries: places, gains, pair gradients, position sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(df: DataFrame, query: str, score: str, order: str, name: str = "rank") -> DataFrame:
    """df with the place of each row in its query, from 0, by descending score (ties by order)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), order)) - 1)


def gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1.0


def discount(place: Column) -> Column:
    return 1.0 / F.log2(place + 2.0)


def max_dcg(df: DataFrame, query: str, label: str, order: str, k: int) -> DataFrame:
    """(query, max_dcg) at k."""
    best = places(df, query, label, order, "_i")
    return best.where(F.col("_i") < k).groupBy(query).agg(F.sum(gain(F.col(label)) * discount(F.col("_i"))).alias("max_dcg"))


def dcg(df: DataFrame, query: str, score: str, label: str, order: str, k: int) -> DataFrame:
    r = places(df, query, score, order, "_i")
    return r.where(F.col("_i") < k).groupBy(query).agg(F.sum(gain(F.col(label)) * discount(F.col("_i"))).alias("dcg"))


def lambdarank(df: DataFrame, query: str, score: str, label: str, order: str, truncation: int = 30, sigmoid: float = 1.0, norm: bool = True) -> DataFrame:
    """(order, g, h) per row. Pairs of one query whose labels differ and whose better place is above the truncation, so a
    query of n rows has at most truncation * n pairs; each pair adds to both of its rows."""
    rows = places(df.select(query, F.col(order).alias("o"), F.col(score).alias("s"), F.col(label).alias("y")), query, "s", "o", "r")
    best = max_dcg(df, query, label, order, truncation)
    ends = rows.groupBy(query).agg(F.max("s").alias("_hi"), F.min("s").alias("_lo"))
    top = rows.where(F.col("r") < truncation).select(query, *(F.col(c).alias(f"{c}1") for c in ("o", "s", "y", "r")))
    pairs = top.join(rows.withColumnRenamed("o", "o2").withColumnRenamed("s", "s2").withColumnRenamed("y", "y2").withColumnRenamed("r", "r2"), query).where("r2 > r1 and y1 <> y2")
    pairs = pairs.join(best, query).join(ends, query).where("max_dcg > 0")
    up = F.col("y1") > F.col("y2")
    ds = F.when(up, F.col("s1") - F.col("s2")).otherwise(F.col("s2") - F.col("s1"))
    delta = F.abs(gain(F.col("y1")) - gain(F.col("y2"))) * F.abs(discount(F.col("r1")) - discount(F.col("r2"))) / F.col("max_dcg")
    if norm:
        delta = F.when(F.col("_hi") != F.col("_lo"), delta / (0.01 + F.abs(ds))).otherwise(delta)
    q = 1.0 / (1.0 + F.exp(F.greatest(F.least(sigmoid * ds, F.lit(50.0)), F.lit(-50.0))))
    lam, hes = sigmoid * delta * q, sigmoid * sigmoid * delta * q * (1.0 - q)
    p = pairs.select(query, "o1", "o2", F.when(up, -lam).otherwise(lam).alias("l"), hes.alias("x"), lam.alias("a"))
    both = p.select(query, F.explode(F.array(F.struct(F.col("o1").alias("o"), F.col("l"), "x", "a"), F.struct(F.col("o2").alias("o"), (-F.col("l")).alias("l"), "x", "a"))).alias("e")).select(query, "e.*")
    per = both.groupBy(query, "o").agg(F.sum("l").alias("g"), F.sum("x").alias("h"), F.sum("a").alias("a"))
    total = per.groupBy(query).agg(F.sum("a").alias("t"))
    f = F.when(F.col("t") > 0, F.log2(1.0 + F.col("t")) / F.col("t")).otherwise(1.0) if norm else F.lit(1.0)
    out = rows.select(query, "o").join(per.join(total, query).select(query, "o", (F.col("g") * f).alias("g"), (F.col("h") * f).alias("h")), [query, "o"], "left")
    return out.select(query, F.col("o").alias(order), F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("h", F.lit(0.0)).alias("h"))


def position_sums(df: DataFrame, position: str, g: str, h: str) -> DataFrame:
    return df.groupBy(position).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))


def query_weights(df: DataFrame, query: str, weight: str) -> DataFrame:
    """(query, w, n): a query's weight is the mean of its rows'."""
    return df.groupBy(query).agg(F.avg(weight).alias("w"), F.count("*").alias("n"))


def label_counts(df: DataFrame, query: str, label: str) -> DataFrame:
    return df.groupBy(query, label).agg(F.count("*").alias("n"))


def query_boundaries(df: DataFrame, query: str, order: str) -> DataFrame:
    """Runs of equal consecutive ids, in the order of `order`: (run, query, first, n). Runs are numbered inside ranges of the
    order and then over the ranges, so no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(query).alias("q"), F.col(order).alias("o")).repartitionByRange(n, "o").withColumn("p", F.spark_partition_id()).persist()
    inside = Window.partitionBy("p").orderBy("o")
    edge = rows.groupBy("p").agg(F.max_by("q", "o").alias("last"))
    before = edge.select((F.row_number().over(Window.orderBy("p"))).alias("i"), "p", F.lag("last").over(Window.orderBy("p")).alias("prev"))
    marked = rows.join(F.broadcast(before), "p").withColumn("lag", F.coalesce(F.lag("q").over(inside), "prev")).withColumn("new", (F.col("lag").isNull() | (F.col("lag") != F.col("q"))).cast("long"))
    counts = marked.groupBy("p").agg(F.sum("new").alias("c"))
    base = counts.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    run = marked.join(F.broadcast(base), "p").withColumn("run", F.col("b") + F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("run").agg(F.first("q").alias("query"), F.min("o").alias("first"), F.count("*").alias("n"))
