"""Harvested mentions laid out for look-ups: clustered by entity, with Bloom filters.

A report on one entity needs a sliver of the mentions. Rows are dealt to files by range
of entity and time and sorted inside them, so the statistics of a row group tell which
entities and days it can hold; an address, which no sort order serves, is looked up by
the Bloom filter that each row group keeps of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of the rows. Time comes last: it splits an entity that holds a third of all
#: rows over as many files as its share, each with its own span of days.
ORDER = ["entity_type", "entity_name", "harvested_at"]
#: The day of ``harvested_at`` in the writer's time zone. Reports ask for days, and files
#: keep statistics of dates, but none of timestamps as Spark writes them by default.
DAY = "harvested_day"
#: Columns with a Bloom filter per row group, and the distinct values one is sized for.
FILTERED, DISTINCT_VALUES = ("url",), 1_000_000
#: Bytes of a row group before compression.
ROW_GROUP_BYTES = 32 << 20


def write_clustered(
    rows: DataFrame,
    path: str,
    files: int,
    order: Sequence[str] = ORDER,
    filtered: Sequence[str] = FILTERED,
    row_group_bytes: int = ROW_GROUP_BYTES,
    distinct_values: int = DISTINCT_VALUES,
) -> DataFrame:
    """Writes ``rows`` in ``files`` files by range of ``order``, of which those columns
    that the rows have are used, with their ``harvested_day``, and reads them back. One
    exchange, once; choose ``files`` so that one is a few hundred MB. Nulls come first,
    as in any sort."""
    if "harvested_at" in rows.columns:
        rows = rows.withColumn(DAY, F.col("harvested_at").cast("date"))
    by = [c for c in order if c in rows.columns]
    dealt = rows.repartitionByRange(files, *by).sortWithinPartitions(*by)
    writer = dealt.write.option("parquet.block.size", row_group_bytes)
    for c in filtered:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{c}", distinct_values)
    writer.parquet(path)
    return read_clustered(rows.sparkSession, path, rows)


def read_clustered(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    reader = spark.read.schema(like.schema) if like is not None else spark.read
    return reader.parquet(path)


def mentions_at(mentions: DataFrame, addresses: Sequence[str]) -> DataFrame:
    """Mentions at some addresses, given as literals so that they reach the files' Bloom
    filters: as many as ``spark.sql.parquet.pushdown.inFilterThreshold`` (10), more are
    looked up between the least and the greatest. No address gives no row, and a null
    one matches nothing."""
    return mentions.filter(F.col("url").isin([a for a in addresses if a is not None]))
