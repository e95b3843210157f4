"""Mergeable summaries: quantiles and distinct counts of any period from one pass.

A state is made per day, month or cohort in one pass over the facts; states of any
range are merged without reading the facts again. States have a bounded size whatever
number of rows they stand for.

Quantiles (KLL): the rank of a returned value is off by at most ``rank_error(k)`` of the
rows, with 99 % confidence; up to about k rows the value is exact. Distinct counts
(theta): exact up to 2^lg different values, beyond that the relative standard error is
2^(-lg / 2); ``distinct_error`` is three of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import col

#: Size of a quantile state (some 8 bytes each), and log2 of the entries of a distinct state.
K, LG = 4096, 12


def rank_error(k: int = K) -> float:
    """Bound of a quantile's rank as a share of the rows (fixed by the sketch's analysis)."""
    return 2.296 / k**0.9021


def distinct_error(lg: int = LG) -> float:
    return 3 / 2 ** (lg / 2)


# -- quantiles ----------------------------------------------------------------------

def quantile_states(df: DataFrame, value: str | Column, by: Sequence[str | Column], k: int = K) -> DataFrame:
    """One state per group; NULL values are left out, a group without any has no state."""
    kept = df.withColumn("_v", col(value).cast("double")).filter("_v IS NOT NULL")
    return kept.groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("state"))


def quantiles(states: DataFrame, ranks: Mapping[str, float], by: Sequence[str | Column] = ()) -> DataFrame:
    """Rows ``n`` and the value at each of ``ranks`` (name: rank) of the merged states."""
    # Without groups a constant is the group: no states at all then make no row.
    merged = states.groupBy(*(by or [F.lit(1).alias("_one")])).agg(F.kll_merge_agg_double("state").alias("_all"))
    names = [c for c in merged.columns if c not in ("_all", "_one")]
    return merged.select(
        *names,
        F.kll_sketch_get_n_double("_all").alias("n"),
        *[F.kll_sketch_get_quantile_double("_all", F.lit(r)).alias(name) for name, r in ranks.items()],
    )


def rank_bounds(values: DataFrame, facts: DataFrame, value: str, name: str, rank: float, by: Sequence[str], k: int = K) -> DataFrame:
    """``values`` with ``within_bound``: whether the true ranks of the value in column
    ``name`` among the ``facts`` allow for ``rank``. Reads the facts, for checks."""
    joined = facts.select(*by, F.col(value).alias("_fact")).join(values.select(*by, F.col(name).alias("_q")), list(by))
    counted = joined.groupBy(*by).agg(
        F.count("_fact").alias("_n"),
        F.count_if(F.col("_fact") < F.col("_q")).alias("_lower"),
        F.count_if(F.col("_fact") <= F.col("_q")).alias("_up_to"),
    )
    slack = F.col("_n") * rank_error(k) + 1
    target = F.col("_n") * rank
    within = (F.col("_lower") <= target + slack) & (F.col("_up_to") >= target - slack)
    return values.join(counted.select(*by, within.alias("within_bound")), list(by))


# -- distinct counts --------------------------------------------------------------------

def distinct_states(df: DataFrame, values: Mapping[str, str], by: Sequence[str | Column], lg: int = LG) -> DataFrame:
    """A state per group for every name in ``values`` (name: column)."""
    return df.groupBy(*by).agg(*[F.theta_sketch_agg(c, F.lit(lg)).alias(name) for name, c in values.items()])


def distinct_counts(states: DataFrame, names: Sequence[str], by: Sequence[str | Column] = (), lg: int = LG) -> DataFrame:
    """Distinct values of the merged states."""
    merged = states.groupBy(*by).agg(*[F.theta_union_agg(n, F.lit(lg)).alias(n) for n in names])
    others = [c for c in merged.columns if c not in names]
    return merged.select(*others, *[F.theta_sketch_estimate(n).alias(n) for n in names])


def distinct_by_period(states: DataFrame, day: str, names: Sequence[str], periods: Mapping[str, Column], lg: int = LG) -> DataFrame:
    """One row per period: distinct values of all states that meet its condition on
    ``day``; periods may overlap and share one pass over the states."""
    merged = states.agg(
        *[F.theta_union_agg(F.when(inside, F.col(n)), F.lit(lg)).alias(f"{n}_{i}") for i, inside in enumerate(periods.values()) for n in names]
    )
    rows = [
        F.struct(F.lit(p).alias("period"), *[F.coalesce(F.theta_sketch_estimate(f"{n}_{i}"), F.lit(0)).alias(n) for n in names])
        for i, p in enumerate(periods)
    ]
    return merged.select(F.inline(F.array(*rows)))


def active_by_period(df: DataFrame, value: str, day: str, periods: Mapping[str, Column]) -> DataFrame:
    """The exact counterpart for periods that all end at the last day of ``df``: a value
    is active in each of them that its latest day meets, so one fold serves all."""
    latest = df.groupBy(value).agg(F.max(day).alias(day)).filter(F.col(value).isNotNull())
    counted = latest.agg(*[F.count_if(inside).alias(f"n_{i}") for i, inside in enumerate(periods.values())])
    rows = [F.struct(F.lit(p).alias("period"), F.col(f"n_{i}").alias("active")) for i, p in enumerate(periods)]
    return counted.select(F.inline(F.array(*rows)))
