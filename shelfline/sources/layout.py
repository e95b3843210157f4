"""A bucketed layout of the two fact tables.

Order lines meet their order in most reports. With both facts bucketed and sorted by
the order key, that join needs neither exchange nor sort: each task reads the matching
buckets. A skewed key cannot arise, as an order has a bounded number of lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfline.sources.roles import Tables
from shelfline.sources.storage import scratch_path

#: Bucket columns of the facts, and the number of buckets; choose it so that a bucket of
#: the larger fact is a few hundred MB.
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
BUCKETS = 64
#: Bytes of the larger fact's files that a bucket is meant to hold: its rows are several
#: times that in memory, where one task sorts them.
BUCKET_BYTES = 16 << 20


class BucketedTables(Tables):
    """Tables of a folder, of which ``names`` (table: catalog name) are read bucketed;
    all others are the folder's plain files."""

    def __init__(self, spark: SparkSession, folder: str, names: dict[str, str]):
        super().__init__(spark, folder)
        self.names = names

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.names and self.spark.catalog.tableExists(self.names[name]):
            return self.spark.table(self.names[name])
        return super().__getattr__(name)

    def drop(self) -> None:
        """Forgets the catalog entries; reads fall back to the plain files."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def buckets_for(tables: Tables, least: int) -> int:
    """Buckets that stay of one size as the facts grow, ``least`` or more."""
    hadoop = tables.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    sizes = []
    for table in KEYS:
        path = hadoop(f"{tables.folder}/{table}.parquet")
        store = path.getFileSystem(tables.spark.sparkContext._jsc.hadoopConfiguration())
        sizes.append(store.getContentSummary(path).getLength())
    return max(least, -(-max(sizes) // BUCKET_BYTES))


def write_bucketed(tables: Tables, buckets: int = BUCKETS, prefix: str | None = None, folder: str | None = None) -> BucketedTables:
    """Writes the facts bucketed under ``folder`` (default: the shared folder) as catalog
    tables with names that start with ``prefix``. One exchange each, once, spares one in
    every later join; a task writes one file per bucket."""
    prefix = prefix or f"shelfline_{uuid.uuid4().hex[:8]}"
    names = {}
    for table, key in KEYS.items():
        path = f"{folder}/{table}" if folder else scratch_path(tables.spark, table)
        names[table] = f"{prefix}_{table}"
        dealt = getattr(tables, table).repartition(buckets, key)
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(names[table])
    return BucketedTables(tables.spark, tables.folder, names)
