"""Sheet (CSV) source, CSV sink and the guarded table scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan with explicit columns, so that only those are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared columns without rows when ``path`` is absent.

    Only a missing path is forgiven; unreadable files and wrong columns still fail.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return scan(spark, path, schema.fieldNames())


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Declared numeric columns as DOUBLE; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Spreadsheet export: the first row is the header, every cell is a string.

    Columns are found by their names in the file, in whatever order it has them; a
    name that it lacks is an error."""
    sheet = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in columns if c not in sheet.columns]
    if missing:
        raise ValueError(f"the sheet {path} has no column {', '.join(missing)}")
    return sheet.select(*(F.col(f"`{c}`") for c in columns))


def write_csv(df: DataFrame, path: str) -> str:
    """Full export, written in parallel with one header per part file."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path
