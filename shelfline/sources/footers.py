"""Bounds of columns from the statistics in Parquet footers: no row is read.

Spark answers MIN, MAX and COUNT from footers when a table is read through its second
file source and the push-down is switched on. Both are settings of a session, so the
aggregate runs in a session of its own; the caller's settings stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose statistics in a footer are exact and ordered as Spark orders them.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
SOURCES = "spark.sql.sources.useV1SourceList"


#: The session of the running application; starting one takes longer than reading footers.
_sessions: dict[str, SparkSession] = {}


def _footer_session(spark: SparkSession) -> SparkSession:
    application = spark.sparkContext.applicationId
    if application not in _sessions:
        _sessions.clear()
        _sessions[application] = _new_session(spark)
    return _sessions[application]


def _new_session(spark: SparkSession) -> SparkSession:
    session = spark.newSession()
    first = [s for s in session.conf.get(SOURCES).split(",") if s.strip() != "parquet"]
    session.conf.set(SOURCES, ",".join(first))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def bounds(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row: ``rows`` and, per column, ``<column>_min`` and ``<column>_max``.

    Takes integers, dates, and timestamps without time zone, which files hold as whole
    microseconds; any other type is a ValueError, as its statistics may be cut off,
    unordered or missing. Spark finds a column's statistics by its place in the schema,
    so the files must hold the same columns in the same order, none of them nested (a
    ValueError). Nulls do not count. An empty table has 0 rows and null bounds. A file
    with rows but no value in a column has no statistics of it: the result fails when
    it is computed."""
    session = _footer_session(spark)
    declared = session.read.parquet(path).schema
    moments = [c for c in columns if isinstance(declared[c].dataType, T.TimestampNTZType)]
    wrong = [c for c in columns if c not in moments and not isinstance(declared[c].dataType, ORDERED)]
    if wrong:
        raise ValueError(f"no exact file statistics of column {', '.join(wrong)}")
    if any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in declared):
        raise ValueError("a table with nested columns")
    stored = T.StructType([T.StructField(f.name, T.LongType() if f.name in moments else f.dataType) for f in declared])
    table = session.read.schema(stored).parquet(path)
    ends = {f"{c}_{end}": (c, of) for c in dict.fromkeys(columns) for end, of in (("min", F.min), ("max", F.max))}
    found = table.agg(F.count(F.lit(1)).alias("rows"), *[of(F.col(f"`{c}`")).alias(name) for name, (c, of) in ends.items()])
    # Without any row group the pushed-down count is null.
    found = found.withColumn("rows", F.greatest("rows", F.lit(0)).cast("long"))
    moment = lambda name: F.timestamp_micros(F.col(f"`{name}`")).cast("timestamp_ntz")
    return found.withColumns({name: moment(name) for name, (c, _) in ends.items() if c in moments})


def greatest(spark: SparkSession, path: str, column: str) -> Any:
    """Greatest value of a column, or None where footers do not tell: a hint for a
    caller that can do without."""
    try:
        return bounds(spark, path, [column]).first()[f"{column}_max"]
    except (ValueError, KeyError, PySparkException, Py4JJavaError):
        return None
