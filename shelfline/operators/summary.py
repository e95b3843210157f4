"""Daily summary of the sell-through, kept as a table and refreshed by the day.

A row stands for all lines of one day, distributor, outlet, item and unit of measure.
Units, doors, points of distribution and line counts of any period follow from it, so
operators that take sell-through lines (Q04-Q14, Q67-Q79) take the summary instead: they
count its rows by ``line_count``. The unit of measure stays apart because the case size,
which turns cases into units, is looked up when a report is made, not when lines arrive.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.inventory import line_count

DAY = "sale_date"
GRAIN = [DAY, "dist_code", "acct_code", "item_code", "uom"]
SCHEMA = "dist_code string, acct_code string, item_code string, uom string, qty bigint, line_count bigint, sale_date date"


def daily_summary(lines: DataFrame) -> DataFrame:
    """Sales lines (or a summary of them) folded to the grain, partition column last."""
    folded = lines.groupBy(*GRAIN).agg(F.sum("qty").alias("qty"), line_count(lines).alias("line_count"))
    return folded.select(*[c for c in GRAIN if c != DAY], "qty", "line_count", DAY)


def _partitioned(summary: DataFrame):
    """A writer with a folder per day. The rebalance deals days out to files and splits
    a day that is large, so neither small files nor one task for a busy day."""
    return summary.hint("rebalance", DAY).write.partitionBy(DAY)


def write_summary(lines: DataFrame, path: str) -> None:
    """The summary of all lines as a new table."""
    _partitioned(daily_summary(lines)).mode("errorifexists").parquet(path)


def refresh_days(spark: SparkSession, lines: DataFrame, path: str, days: Iterable[date]) -> None:
    """Makes the table right for ``days`` and leaves the others alone.

    ``lines``: all lines of these days at least. Only their partitions are read from the
    lines and overwritten; a day without lines any more loses its partition. A run that
    is repeated after a failure ends in the same table."""
    wanted = sorted(set(days))
    if not wanted:
        return
    fresh = daily_summary(lines.filter(F.col(DAY).isin(wanted)))
    _partitioned(fresh).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    left = {r[DAY] for r in read_summary(spark, path).filter(F.col(DAY).isin(wanted)).groupBy(DAY).count().collect()}
    held = {r[DAY] for r in lines.filter(F.col(DAY).isin(wanted)).select(DAY).distinct().collect()}
    for day in left - held:  # at most the days asked for
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY}={day.isoformat()}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_summary(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """The table as sales lines; ``since`` prunes partitions."""
    table = spark.read.schema(SCHEMA).parquet(path)
    return table if since is None else table.filter(F.col(DAY) >= F.lit(since))
