"""Bounds from file statistics, and the last sale found with their help."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from shelfline.plans import inputs
from shelfline.sources import footers
from shelfline.sources.roles import Tables


def plan(df, mode="formatted"):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_bounds_come_from_footers_and_leave_the_session_alone(spark, tables):
    before = spark.conf.get(footers.SOURCES)
    found = footers.bounds(spark, f"{tables.folder}/lineitem.parquet", ["l_shipdate", "l_orderkey"])
    assert "PushedAggregation: [COUNT(*), MIN(l_shipdate), MAX(l_shipdate), MIN(l_orderkey)" in plan(found)
    exact = tables.lineitem.agg(F.count("*"), F.min("l_shipdate"), F.max("l_shipdate"), F.min("l_orderkey"), F.max("l_orderkey"))
    assert tuple(found.first()) == tuple(exact.first())
    assert spark.conf.get(footers.SOURCES) == before and "BatchScan" not in plan(tables.lineitem)


def test_several_files_dates_nulls_and_empty_tables(spark, tmp_path):
    rows = [(date(2020, 1, 3), 5), (None, -2), (date(2019, 5, 1), None), (date(2021, 7, 9), 8)]
    df = spark.createDataFrame(rows, "`a day` date, n int")
    df.coalesce(1).write.parquet(f"{tmp_path}/t")
    df.where("n = 8").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert tuple(footers.bounds(spark, f"{tmp_path}/t", ["n", "a day"]).first()) == (5, -2, 8, date(2019, 5, 1), date(2021, 7, 9))
    df.where("false").coalesce(1).write.parquet(f"{tmp_path}/empty")
    assert tuple(footers.bounds(spark, f"{tmp_path}/empty", ["n"]).first()) == (0, None, None)


def test_types_without_exact_statistics_are_refused(spark, tmp_path):
    spark.createDataFrame([("x", 1.5, datetime(2020, 1, 1))], "s string, d double, at timestamp").write.parquet(f"{tmp_path}/t")
    for column in ("s", "d", "at"):
        with pytest.raises(ValueError, match=column):
            footers.bounds(spark, f"{tmp_path}/t", [column])
        assert footers.greatest(spark, f"{tmp_path}/t", column) is None
    assert footers.greatest(spark, f"{tmp_path}/nowhere", "s") is None
    spark.range(3).withColumn("list", F.array("id")).write.parquet(f"{tmp_path}/nested")
    with pytest.raises(ValueError, match="nested"):
        footers.bounds(spark, f"{tmp_path}/nested", ["id"])


def test_the_last_sale_is_exact_whatever_the_hint(spark, tables, monkeypatch):
    exact = inputs.sold_lines(tables, with_account=False).agg(F.max("sale_date")).first()[0]
    assert inputs.latest_sale(tables) == exact
    for hint in (None, datetime(1970, 1, 1), datetime(2200, 1, 1)):
        monkeypatch.setattr(footers, "greatest", lambda *a, hint=hint: hint)
        assert inputs.latest_sale(tables) == exact


def test_facts_without_a_date_have_no_last_sale(spark, tables, tmp_path):
    none = tables.lineitem.withColumn("l_shipdate", F.lit(None).cast("timestamp_ntz"))
    none.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert inputs.latest_sale(Tables(spark, str(tmp_path))) is None
