"""Where intermediate tables go: the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written so far that nobody has removed.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set, a temporary one on a single machine (tests); a cluster must name one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="arborframe-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends there, and a lost executor loses no part of it.

    files: how many files are enough for it, if its last stage may have fewer tasks (see `files_for`).
    """
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    at = f"{shared_folder(spark)}/arborframe-{uuid.uuid4().hex}"
    _tables.append(at)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.arborframe_table = at
    return out


def files_for(docs: DataFrame, each: int) -> int | None:
    """A file for every `each` bytes of the files that docs is read from, so that small inputs don't become hundreds of tiny files and large ones stay spread; None if docs comes from elsewhere."""
    size = input_bytes(docs)
    return -(-size // each) if size else None


def stable(df: DataFrame) -> DataFrame:
    """df if each of its partitions is read from files, so that a task that runs again gets the same rows in the same order; else df written."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df) if any(x in plan for x in ("Exchange", "Join", "Aggregate", "Window", "RDD")) else df


def _remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if at in _tables:
        _tables.remove(at)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing reads any more."""
    for df in tables:
        if at := getattr(df, "arborframe_table", None):
            _remove(df.sparkSession, at)


@contextmanager
def only(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables that were written inside, but for those appended to the list."""
    before, keep = set(_tables), []
    yield keep
    kept = {getattr(df, "arborframe_table", None) for df in keep}
    for at in [x for x in _tables if x not in before and x not in kept]:
        _remove(spark, at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is read from; 0 for rows that come from elsewhere."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    own = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in own if x.getClass().getSimpleName() == "LogicalRelation")
