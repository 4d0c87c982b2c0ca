"""CSV, TSV and LibSVM files with column roles and side files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that stand for a missing value, whatever their case.
MISSING = ("", "na", "nan", "null")
SIDE = {"weight": ".weight", "query": ".query", "position": ".position", "init": ".init"}


def detect(lines: list[str]) -> str:
    """libsvm, tsv or csv, by the first lines: a colon, or a constant number of tabs or commas."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        raise ValueError("the file is empty")
    if any(re.search(r"(^|\s)\d+:\S", x) for x in lines):
        return "libsvm"
    for name, sep in (("tsv", "\t"), ("csv", ",")):
        counts = {x.count(sep) for x in lines}
        if len(counts) == 1 and counts.pop() > 0:
            return name
    if all("\t" not in x and "," not in x for x in lines):
        return "csv"
    raise ValueError("unknown format: neither LibSVM nor a constant number of tabs or commas")


def number(c: Column) -> Column:
    """A token as a double; missing tokens are NaN. A token that is no number raises."""
    t = F.lower(F.trim(c))
    return F.when(t.isNull() | t.isin(*MISSING), F.lit(float("nan"))).when(t.isin("inf", "+inf", "infinity"), F.lit(1e308)).when(t.isin("-inf", "-infinity"), F.lit(-1e308)).otherwise(t.cast("double"))


def _role(spec: str | int | None, names: list[str]) -> list[str]:
    """Columns named by 'name:a,b', by indices '0,1' or by one index."""
    if spec is None or spec == "":
        return []
    if isinstance(spec, int):
        return [names[spec]]
    if spec.startswith("name:"):
        out = spec[5:].split(",")
        missing = [x for x in out if x not in names]
        if missing:
            raise ValueError(f"the header has no {missing}")
        return out
    return [names[int(x)] for x in spec.split(",")]


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df with the place of each row in its file: partitions are counted first, then rows inside them."""
    part = df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["count"] for r in part.groupBy("_p").count().collect()}  # one row per partition
    at, base = 0, []
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    first = df.sparkSession.createDataFrame(base or [(0, 0)], "_p int, _b long")
    inside = F.col("_m").bitwiseAND((1 << 33) - 1)
    return part.join(F.broadcast(first), "_p").withColumn(name, F.col("_b") + inside).drop("_p", "_m", "_b")


def read(spark: SparkSession, path: str, header: bool = False, label: str | int | None = 0, weight: str | int | None = None, group: str | int | None = None, ignore: str | int | None = None, names: list[str] | None = None, num_features: int | None = None, keep_order: bool = False) -> DataFrame:
    """Rows of a text file: label, [weight, query,] and a column per feature.

    label=None: the file has features only. Indices of weight, group and ignore count without the label column. With
    keep_order a row_id column holds each row's place, which side files need.
    """
    lines = spark.read.text(path)
    head = [r.value for r in lines.limit(33).collect()]
    if not head:
        raise ValueError(f"{path} is empty")
    kind = detect(head[1:] if header else head)
    if keep_order:
        lines = numbered(lines)
    extra = ["row_id"] if keep_order else []
    if kind == "libsvm":
        return _libsvm(lines, label, num_features, extra)
    sep = "\t" if kind == "tsv" else ","
    if header:
        cols = [x.strip() for x in head[0].split(sep)]
        lines = lines.where(F.col("value") != head[0])
        if keep_order:
            lines = lines.withColumn("row_id", F.col("row_id") - 1)
    else:
        n = head[0].count(sep) + 1
        feats = names or [f"Column_{i}" for i in range(n - (label is not None))]
        at = 0 if label is None or isinstance(label, str) else label
        cols = feats if label is None else [*feats[:at], "label", *feats[at:]]
    if len(cols) != head[-1].count(sep) + 1:
        raise ValueError("the number of columns differs from the number of names")
    parts = F.split("value", re.escape(sep) if sep != "\t" else "\t")
    table = lines.where(F.trim("value") != "").select(*extra, *[number(F.try_element_at(parts, F.lit(i + 1))).alias(c) for i, c in enumerate(cols)])
    target = _role(label, cols) if header or isinstance(label, str) else ["label"] if label is not None else []
    rest = [c for c in cols if c not in target]
    w, g, drop = _role(weight, rest), _role(group, rest), _role(ignore, rest)
    out = [F.col(f"`{target[0]}`").alias("label")] if target else []
    out += [F.col(f"`{w[0]}`").alias("weight")] if w else []
    out += [F.col(f"`{g[0]}`").cast("long").alias("query")] if g else []
    return table.select(*extra, *out, *[F.col(f"`{c}`") for c in rest if c not in {*w, *g, *drop}])


def _libsvm(lines: DataFrame, label, num_features: int | None, extra: list[str]) -> DataFrame:
    """idx:value pairs, counted from 0; what isn't there is 0."""
    tokens = F.split(F.trim("value"), r"\s+")
    pairs = F.filter(tokens, lambda t: t.contains(":"))
    rows = lines.where(F.trim("value") != "").select(*extra, F.when(~tokens[0].contains(":"), number(tokens[0])).alias("label"), F.transform(pairs, lambda t: F.struct(F.split(t, ":")[0].cast("int").alias("i"), number(F.split(t, ":")[1]).alias("v"))).alias("pairs"))
    if num_features is None:
        num_features = (rows.agg(F.max(F.array_max(F.transform("pairs", lambda p: p["i"])))).first()[0] or 0) + 1
    cell = lambda i: F.coalesce(F.try_element_at(F.transform(F.filter("pairs", lambda p: p["i"] == i), lambda p: p["v"]), F.lit(-1)), F.lit(0.0))
    return rows.select(*extra, *(["label"] if label is not None else []), *[cell(i).alias(f"Column_{i}") for i in range(num_features)])


def with_side_files(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """rows (with row_id) and what .weight, .query, .position and .init files next to the file say: one value per line;
    .query holds the sizes of consecutive queries, .init tab-separated scores."""
    from pyspark.errors import AnalysisException

    for name, suffix in SIDE.items():
        try:
            side = spark.read.text(path + suffix)
            if name == "query":
                sizes = numbered(side).select("row_id", F.col("value").cast("long").alias("n")).collect()  # one row per query file line
                at, ends = 0, []
                for i, r in enumerate(sorted(sizes)):
                    ends.append((at, at + r.n, i))
                    at += r.n
                table = spark.createDataFrame(ends, "first long, last long, query long")
                long = table.select("query", F.explode(F.sequence("first", F.col("last") - 1)).alias("row_id"))
                rows = rows.join(long, "row_id", "left")
                continue
            value = F.transform(F.split("value", "\t"), lambda x: x.cast("double")) if name == "init" else F.col("value").cast("long" if name == "position" else "double")
            rows = rows.join(numbered(side).select("row_id", value.alias({"init": "init_score"}.get(name, name))), "row_id", "left")
        except AnalysisException:
            continue
    return rows


def dataset(spark: SparkSession, path: str, params: dict | None = None, **kwargs):
    """A Dataset from a text file and its side files, or from what save_binary wrote to <path>.bin or <path>."""
    from pyspark.errors import AnalysisException

    from ..plans.engine import Dataset

    for at in (path + ".bin", path):
        try:
            spark.read.schema("meta string").json(f"{at}/meta").first()
            return Dataset.load_binary(spark, at)
        except AnalysisException:
            continue
    p = params or {}
    rows = read(spark, path, header=bool(p.get("header", False)), label=p.get("label_column") or 0, weight=p.get("weight_column"), group=p.get("group_column"), ignore=p.get("ignore_column"), keep_order=True, **kwargs)
    rows = with_side_files(spark, rows, path)
    cols = rows.columns
    get = lambda c: c if c in cols else None
    feats = [c for c in cols if c not in ("row_id", "label", "weight", "query", "position", "init_score")]
    return Dataset(rows, "label", weight=get("weight"), group=get("query"), position=get("position"), init_score=get("init_score"), feature_name=feats, params=p)
