"""Arrays, pandas, Arrow and sparse matrices as DataFrames."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def from_dense(spark: SparkSession, x: np.ndarray, names: list[str] | None = None, **columns) -> DataFrame:
    """A 2-D array, one column per feature; further columns (label=..., weight=...) by name. Other types than float32 and float64 are cast."""
    x = np.asarray(x)
    if x.ndim != 2:
        raise ValueError("a matrix must have two dimensions")
    if x.dtype not in (np.float32, np.float64):
        x = x.astype(np.float32)
    names = names or [f"Column_{i}" for i in range(x.shape[1])]
    data = {n: pa.array(x[:, i].astype(np.float64)) for i, n in enumerate(names)} | {k: pa.array(np.asarray(v)) for k, v in columns.items()}
    return spark.createDataFrame(pa.table(data))


def from_chunks(spark: SparkSession, chunks: list[np.ndarray], names: list[str] | None = None) -> DataFrame:
    """2-D arrays one below the other."""
    if len({c.shape[1] for c in chunks}) != 1 or len({c.dtype for c in chunks}) != 1:
        raise ValueError("chunks must have the same columns and type")
    return functools.reduce(DataFrame.unionByName, [from_dense(spark, c, names) for c in chunks])


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """Integers, floats and booleans; null is a missing value. Other types are rejected."""
    for f in table.schema:
        if not (pa.types.is_integer(f.type) or pa.types.is_floating(f.type) or pa.types.is_boolean(f.type)):
            raise ValueError(f"column {f.name}: type {f.type} is not supported")
    return spark.createDataFrame(table)


def concatenated(df: DataFrame, columns: list[str], name: str = "init_score") -> DataFrame:
    """Several columns as one array column (scores of several classes)."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def from_pandas(spark: SparkSession, pdf, categories: dict[str, list] | None = None) -> tuple[DataFrame, dict[str, list]]:
    """Category columns become codes, by the given categories or their own; unknown and missing ones NaN. Returns the categories used."""
    import pandas as pd

    pdf, used = pdf.copy(), {}
    for c in pdf.columns:
        if isinstance(pdf[c].dtype, pd.CategoricalDtype):
            cats = (categories or {}).get(c) or list(pdf[c].cat.categories)
            used[c] = cats
            codes = pd.Categorical(pdf[c].astype(object), categories=cats).codes.astype(float)
            pdf[c] = np.where(codes < 0, np.nan, codes)
        elif pdf[c].dtype == object or str(pdf[c].dtype) in ("str", "string") or str(pdf[c].dtype).startswith("datetime"):
            raise ValueError(f"column {c}: type {pdf[c].dtype} is not supported; make it a category")
    return spark.createDataFrame(pdf), used


def encode_categories(df: DataFrame, column: str, categories: list | None = None) -> tuple[DataFrame, list]:
    """A string column as codes of the given categories, or of its own in order; unknown and missing ones NaN."""
    cats = categories if categories is not None else [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).toLocalIterator()]
    table = df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(cats)], f"`{column}` {dict(df.dtypes)[column]}, _code double")
    out = df.join(table, column, "left").withColumn(column, F.coalesce("_code", F.lit(float("nan")))).drop("_code")
    return out, cats


def check_types(df: DataFrame, columns: list[str]) -> None:
    types = dict(df.dtypes)
    for c in columns:
        if types[c] not in NUMERIC and not types[c].startswith("decimal"):
            raise ValueError(f"column {c}: type {types[c]} is not supported")


def from_sparse(spark: SparkSession, matrix, name: str = "row_id") -> DataFrame:
    """A scipy CSR/CSC/COO matrix, or (indptr, indices, values, columns) of a CSR one, as (row_id, feature, value). Of cells given twice the later stays."""
    if isinstance(matrix, tuple):
        indptr, indices, values, columns = matrix
        indptr = np.asarray(indptr, np.int64)
        if indptr[0] != 0 or (np.diff(indptr) < 0).any() or indptr[-1] != len(indices) or len(indices) != len(values) or (len(indices) and (np.min(indices) < 0 or np.max(indices) >= columns)):
            raise ValueError("malformed sparse matrix")
        rows, cols, values = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)), np.asarray(indices), np.asarray(values, np.float64)
    else:
        coo = matrix.tocoo()
        rows, cols, values = coo.row, coo.col, coo.data
    key = rows.astype(np.int64) * (int(cols.max(initial=0)) + 1) + cols
    last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]
    return spark.createDataFrame(pa.table({name: pa.array(rows[last].astype(np.int64)), "feature": pa.array(cols[last].astype(np.int32)), "value": pa.array(values[last].astype(np.float64))}))


def to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, feature, value) of the cells that aren't zero."""
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("feature", "value")
    return df.select(key, cells).where(F.isnan("value") | (F.abs("value") > 1e-35))


def to_wide(long: DataFrame, key: str, features: int) -> DataFrame:
    """One column per feature; cells that aren't there are 0."""
    wide = long.groupBy(key).pivot("feature", list(range(features))).agg(F.first("value"))
    return wide.select(key, *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"Column_{i}") for i in range(features)])


def sampled_columns(df: DataFrame, columns: list[str], fraction: float, seed: int = 1) -> DataFrame:
    """(feature, value) of the cells that aren't zero in a sample of the rows, drawn by a hash of their places: equal rows are drawn independently."""
    rows = df.select(*columns, F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("_k"))
    rows = rows.where(F.shiftrightunsigned("_k", 11) / F.lit(float(2**53)) < fraction)
    return to_long(rows, "_k", columns).drop("_k")
