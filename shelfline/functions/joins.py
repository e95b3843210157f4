"""Join shapes that keep one equi key and never multiply rows by accident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_id(dim: DataFrame, id_columns: Sequence[str], alias: str = "match_id") -> DataFrame:
    """Turn ``key = id_a OR key = id_b`` into one equi key.

    Each dimension row is repeated once per different id it carries, so the join
    that follows hashes on ``alias`` instead of comparing every pair.
    """
    ids = F.array_distinct(F.array_compact(F.array(*id_columns)))
    return dim.withColumn(alias, F.explode(ids))


def grand_total(df: DataFrame, value: Column) -> Column:
    """One-row aggregate as a scalar sub-query (no cross join)."""
    return df.agg(value.alias("v")).select("v").scalar()


def top_groups(df: DataFrame, group: str, measure: Column, k: int) -> DataFrame:
    """The ``k`` groups with the greatest measure; ties by name."""
    ranked = df.groupBy(group).agg(measure.alias("_m"))
    return ranked.orderBy(F.col("_m").desc(), F.col(group)).limit(k).select(group)


def members_of(df: DataFrame, groups: DataFrame, on: str) -> DataFrame:
    """Rows whose group is in ``groups``, a frame limited to a fixed top-k."""
    return df.join(F.broadcast(groups), on, "left_semi")


def month_spine(first, last, alias: str = "month") -> Column:
    """Array of month starts between two dates, for ``explode``."""
    return F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month")).alias(alias)
