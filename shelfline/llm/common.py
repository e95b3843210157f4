"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def by_bytes(items: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Consecutive runs of ``items`` of about ``most`` bytes each."""
    run, size = [], 0
    for item in items:
        run.append(item)
        size += len(item)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def row_key(identity: str, text: str) -> list[Column]:
    """Columns that tell rows apart without numbering them: the id (null stays null)
    and a hash of the text. Repeated rows share a key and so get equal results."""
    return [F.col(identity).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash")]


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & (left["__hash"] == right["__hash"])


#: Rows of a table of row keys that may be broadcast (some 60 bytes each in memory).
BROADCAST_KEYS = 500_000


def key_side(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of row keys as the side of a join: broadcast while its counted
    rows are few, so that whole texts are not shuffled to drop or change some of them."""
    return F.broadcast(keys) if keys.count() <= most else keys
