"""Session settings the operators are tuned for; whoever starts the session applies them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Call sites in error messages cost several driver round trips per column
#: expression; building a plan takes longer than running it with them on. This one
#: must be set before the session starts.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

#: Runtime re-planning is what keeps look-up joins safe: a dimension is only
#: broadcast when its measured size is under the threshold, and a hot join key
#: is split across tasks even when the join feeds another aggregation.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, app: str = "shelfline", extra: dict[str, str] | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**RUNTIME_SETTINGS, **STATIC_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
