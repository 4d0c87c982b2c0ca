"""Gradient histograms: GROUP BY (leaf, feature, bin) with integer sums, so that no order of rows or partitions matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_point(x: Column, bits: int) -> Column:
    """x * 2^bits as a long."""
    return F.round(x.cast("double") * float(2**bits)).cast("long")


def scale_bits(n: int, largest: float) -> int:
    """Bits after the point with which n values up to `largest` can't overflow a long."""
    import math

    return int(math.floor(62 - math.ceil(math.log2(max(n, 2))) - math.ceil(math.log2(max(largest, 1e-30)))))


def histogram(df: DataFrame, bins: list[str], g: str, h: str, leaf: str | None = None) -> DataFrame:
    """([leaf,] feature, bin, g, h, n): one row goes to one entry per feature; Spark sums inside each partition before it shuffles.

    g and h should be longs (fixed_point); then the sums are exact.
    """
    by = ([leaf] if leaf else []) + ["feature", "bin"]
    long = df.select(*([leaf] if leaf else []), g, h, F.posexplode(F.array(*[F.col(b).cast("int") for b in bins])).alias("feature", "bin"))
    return long.groupBy(*by).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))


def totals(df: DataFrame, g: str, h: str, leaf: str | None = None) -> DataFrame:
    own = df.groupBy(leaf) if leaf else df.groupBy()
    return own.agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))


def subtract(parent: DataFrame, smaller: DataFrame) -> DataFrame:
    """The larger child's histogram: parent minus the smaller child's, entry by entry. Exact for longs."""
    s = smaller.select("feature", "bin", F.col("g").alias("sg"), F.col("h").alias("sh"), F.col("n").alias("sn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = parent.join(s, ["feature", "bin"], "left").select("feature", "bin", (F.col("g") - zero("sg")).alias("g"), (F.col("h") - zero("sh")).alias("h"), (F.col("n") - zero("sn")).alias("n"))
    return out.where("n > 0")


def with_bin(hist: DataFrame, total: DataFrame, bin_: int) -> DataFrame:
    """hist (feature, bin, g, h, n), in which one bin of each feature was left out, with that bin: the totals less all others."""
    rest = hist.groupBy("feature").agg(*(F.sum(c).alias(f"o{c}") for c in "ghn"))
    lost = rest.join(F.broadcast(total)).select("feature", F.lit(bin_).alias("bin"), *((F.col(c) - F.col(f"o{c}")).alias(c) for c in "ghn"))  # the totals are one row
    return hist.select("feature", "bin", *"ghn").union(lost)


def best_threshold(hist: DataFrame, l1: float = 0.0, l2: float = 0.0, min_data: int = 1, min_hessian: float = 0.0, missing_bin: str | None = None, monotone: int = 0) -> DataFrame:
    """Per feature the best numeric split of hist (feature, bin, g, h, n [, missing_bin: the feature's bin of missing values]):
    (feature, bin, default_left, gain, left_n). Missing values are tried on either side; first the left, which wins ties;
    on the left the largest threshold wins ties, on the right the smallest."""
    from pyspark.sql import Window

    w = Window.partitionBy("feature")
    miss = F.col(missing_bin) if missing_bin else F.lit(None).cast("int")
    is_missing = F.coalesce(F.col("bin") == miss, F.lit(False))
    part = lambda c: F.sum(F.when(is_missing, 0).otherwise(F.col(c))).over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    lost = lambda c: F.sum(F.when(is_missing, F.col(c)).otherwise(0)).over(w)
    cols = ("g", "h", "n")
    a = hist.select("feature", "bin", is_missing.alias("_m"), *(part(c).alias(f"c{c}") for c in cols), *(lost(c).alias(f"m{c}") for c in cols), *(F.sum(c).over(w).alias(f"t{c}") for c in cols))
    a = a.where(~F.col("_m"))
    sides = F.explode(F.array(F.lit(True), F.lit(False))).alias("default_left")
    b = a.select("*", sides).where(F.col("default_left") | (F.col("mn") > 0))
    add = lambda c: F.col(f"c{c}") + F.when(F.col("default_left"), F.col(f"m{c}")).otherwise(0)
    c = b.select("feature", "bin", "default_left", *(add(x).alias(f"l{x}") for x in cols), *(F.col(f"t{x}") for x in cols))
    rg, rh, rn = F.col("tg") - F.col("lg"), F.col("th") - F.col("lh"), F.col("tn") - F.col("ln")
    c = c.where((F.col("ln") >= max(min_data, 1)) & (rn >= max(min_data, 1)) & (F.col("lh") >= min_hessian) & (rh >= min_hessian))
    t = lambda x: F.signum(x) * F.greatest(F.abs(x) - l1, F.lit(0.0))
    score = lambda x, y: t(x.cast("double")) * t(x.cast("double")) / (y + l2)
    gain = score(F.col("lg"), F.col("lh")) + score(rg, rh) - score(F.col("tg"), F.col("th"))
    if monotone:
        lo, ro = -t(F.col("lg").cast("double")) / (F.col("lh") + l2), -t(rg.cast("double")) / (rh + l2)
        c = c.where(lo <= ro if monotone > 0 else lo >= ro)
    d = c.select("feature", "bin", "default_left", gain.alias("gain"), F.col("ln").alias("left_n"))
    pick = Window.partitionBy("feature").orderBy(F.col("gain").desc(), F.col("default_left").desc(), F.when(F.col("default_left"), -F.col("bin")).otherwise(F.col("bin")))
    return d.withColumn("_r", F.row_number().over(pick)).where("_r = 1").drop("_r")
