"""Window shapes used by the operators.

Windows without a partition column only ever run on series that are already
aggregated to days, weeks or months; everything else passes ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import col


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``newest`` tuple.

    Written as ``max_by`` so that each map task keeps one candidate per key; a key
    that owns a third of the rows shuffles one row per task, not its history.
    """
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*newest)).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def series(by: Sequence[str], order: str | Column, *ties: str | Column):
    order_cols = [col(order), *[col(t) for t in ties]]
    if by:
        return Window.partitionBy(*by).orderBy(*order_cols)
    return Window.orderBy(*order_cols)


def rolling_mean(
    value: str, order: str, rows: int, min_rows: int | None = None, by: Sequence[str] = ()
) -> Column:
    """Mean of the trailing ``rows`` rows, NULL until ``min_rows`` have a value."""
    w = series(by, order).rowsBetween(-(rows - 1), 0)
    need = rows if min_rows is None else min_rows
    return F.when(F.count(col(value)).over(w) >= need, F.avg(col(value)).over(w))


def running_total(value: str | Column, order: str, by: Sequence[str] = ()) -> Column:
    w = series(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(col(value)).over(w)


def lagged(value: str, n: int, order: str, by: Sequence[str] = ()) -> Column:
    return F.lag(col(value), n).over(series(by, order))


def from_start(order: str, by: Sequence[str] = ()) -> Column:
    return F.row_number().over(series(by, order))


def from_end(order: str, by: Sequence[str] = ()) -> Column:
    return F.row_number().over(series(by, F.col(order).desc()))


def share_of(value: str | Column, by: Sequence[str]) -> Column:
    """Share of the parent's total; ``by`` must be a small grouping."""
    total = F.sum(col(value)).over(Window.partitionBy(*by))
    return F.try_divide(col(value).cast("double"), total.cast("double"))
