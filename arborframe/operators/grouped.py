"""Losses that couple the rows of a group: a group's Hessian is a matrix, of which training uses a diagonal.

A grouped loss takes (scores, labels, weights) of one group and returns its gradient and Hessian matrix. `objective`
turns it into a custom objective for `train`: groups are the dataset's queries, which blocks never cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

METHODS = ("exact", "drop_off_diagonal", "gershgorin")


def diagonal(h: np.ndarray, method: str = "drop_off_diagonal") -> np.ndarray:
    """exact: the matrix must be diagonal already; drop_off_diagonal: its diagonal; gershgorin: the sums of absolute values of each row, an upper bound."""
    h = np.asarray(h, np.float64)
    d = np.diag(h)
    if method == "exact":
        if np.abs(h - np.diag(d)).max(initial=0.0) > 0:
            raise ValueError("the Hessian isn't diagonal")
        return d.copy()
    if method == "drop_off_diagonal":
        return d.copy()
    if method == "gershgorin":
        return np.abs(h).sum(axis=1)
    raise ValueError(f"unknown method {method!r}")


def objective(loss: Callable, method: str = "drop_off_diagonal", least: float = 1e-16) -> Callable:
    """A custom objective of a grouped loss."""

    def call(score, label, weight, bounds):
        if bounds is None:
            raise ValueError("a grouped loss needs a group column")
        g, h = np.zeros(len(score)), np.zeros(len(score))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own, matrix = loss(score[a:b], label[a:b], None if weight is None else weight[a:b])
            g[a:b], h[a:b] = own, np.maximum(diagonal(matrix, method), least)
        return g, h

    return call


def gradients(df: DataFrame, group: str, order: str, score: str, label: str, loss: Callable, method: str = "drop_off_diagonal") -> DataFrame:
    """(group, order, g, h) of a grouped loss, one group per call; a group must fit a task."""
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        g, h = loss(np.asarray(table.column(score).combine_chunks(), np.float64), np.asarray(table.column(label).combine_chunks(), np.float64), None)
        return pa.table({group: table.column(group), order: table.column(order), "g": np.asarray(g, np.float64), "h": diagonal(h, method)})

    return df.select(group, order, score, label).groupBy(group).applyInArrow(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, g double, h double")
