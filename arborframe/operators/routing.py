"""Routing predicates: which child a row goes to, and a row's leaf in a small tree, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binning import ZERO


def by_bin(b: Column, threshold: int, missing_bin: int | None = None, default_left: bool = True) -> Column:
    """True: left."""
    out = b <= threshold
    return out if missing_bin is None else F.when(b == missing_bin, F.lit(default_left)).otherwise(out)


def by_bins(b: Column, left: list[int]) -> Column:
    """A categorical split; bin 0, all other categories, never goes left."""
    return b.isin([x for x in left if x > 0])


def by_value(v: Column, threshold: float, missing: str = "none", default_left: bool = True) -> Column:
    v = F.coalesce(v.cast("double"), F.lit(float("nan")))
    if missing == "nan":
        return F.when(F.isnan(v), F.lit(default_left)).otherwise(v <= threshold)
    v = F.nanvl(v, F.lit(0.0))
    return F.when(F.abs(v) <= ZERO, F.lit(default_left)).otherwise(v <= threshold) if missing == "zero" else v <= threshold


def by_category(v: Column, left: list[int]) -> Column:
    """Missing, negative and unknown categories go right."""
    v = F.coalesce(v.cast("double"), F.lit(float("nan")))
    return F.when(F.isnan(v) | (v < 0) | (v >= 2.0**31), F.lit(False)).otherwise(F.floor(v).isin(left))


def children(leaf: Column, of: int, right: int, goes_left: Column) -> Column:
    """The leaf column after `of` was split: its rows that don't go left get `right`."""
    return F.when((leaf == of) & ~goes_left, F.lit(right)).otherwise(leaf)
