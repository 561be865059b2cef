"""Turning array columns into rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, array: Column | str, keep: list, value: str, position: str | None = None
) -> DataFrame:
    """One row per non-NULL element.

    The outer form is used and its NULL row dropped afterwards. The inner form makes the
    optimizer add a filter ``size(array) > 0`` below the explode, which computes a costly
    array expression a second time and before any repartitioning.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    else:
        rows = df.select(*keep, F.explode_outer(array).alias(value))
    return rows.where(F.col(value).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once. Inside a lambda an expression that is
    written twice is computed twice, and nesting such uses multiplies the work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
