"""Clustered mentions, KPIs guarded in their own job, and the one-pass door sheet."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from shelfline.operators import accounts as acc
from shelfline.operators import quality as dq
from shelfline.operators import trends as tr
from shelfline.plans import inputs
from shelfline.sources import clustered, roles

MENTION = "entity_name string, entity_type string, source_engine string, url string, title string, snippet string, harvested_at timestamp"
DAY, FILES = datetime(2024, 1, 31), 24


def mentions(spark, n=6000):
    """A third of all rows on one entity, the rest on sixty."""
    rows = []
    for i in range(n):
        entity = "hot" if i % 3 == 0 else f"e{i % 61:02d}"
        rows.append((entity, "brand" if i % 2 else "flavor", "web", f"u/{i}", f"t {i}", "s" * 40, DAY - timedelta(hours=i % 600)))
    return spark.createDataFrame(rows, MENTION)


def rows_read(df):
    """Rows that the scans of a frame hand on, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    found = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        found += metric.get().value() if metric.isDefined() else 0
    return found


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "mentions")
    return path, clustered.write_clustered(mentions(spark), path, FILES, row_group_bytes=8 << 10, distinct_values=1000)


def test_layout_keeps_all_rows(spark, laid_out):
    path, read = laid_out
    assert sorted(read.drop(clustered.DAY).collect(), key=lambda r: r["url"]) == sorted(mentions(spark).collect(), key=lambda r: r["url"])
    sizes = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(sizes) == FILES


def test_a_hot_entity_is_spread_by_time(spark, laid_out):
    _, read = laid_out
    files = read.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entity_name") == "hot").alias("hot")).collect()
    assert max(f["n"] for f in files) <= 2 * 6000 / FILES
    assert sum(f["hot"] > 0 for f in files) >= 4


def test_one_entity_reads_a_sliver(laid_out):
    _, read = laid_out
    assert 0 < rows_read(read.filter("entity_name = 'e07'")) <= 6000 / 4
    # Two days of an entity that has a third of all rows, by the report itself.
    assert 0 < rows_read(tr.sources_for(read, "hot", DAY.date(), days=1)) <= 6000 / 4


def test_an_address_is_found_by_its_bloom_filter(spark, laid_out, tmp_path):
    _, read = laid_out
    wanted = clustered.mentions_at(read, ["u/77", None, "u/5no"])
    assert [r["url"] for r in wanted.collect()] == ["u/77"]
    # Every row group's span of addresses covers "u/5no": only the Bloom filters can tell that none has it.
    plain = clustered.write_clustered(mentions(spark), str(tmp_path / "plain"), FILES, filtered=(), row_group_bytes=8 << 10)
    absent = [f"u/{i}no" for i in range(1, 9)]
    # Row groups and pages that the statistics leave are handed on by a plain layout, and not by this one.
    assert rows_read(clustered.mentions_at(read, absent)) < rows_read(clustered.mentions_at(plain, absent)) / 4
    assert clustered.mentions_at(read, []).count() == 0


def test_reports_on_the_layout(spark, laid_out):
    _, read = laid_out
    plain, day = mentions(spark), DAY.date()
    assert tr.sources_for(read, "hot", day).collect() == tr.sources_for(plain, "hot", day).collect()
    assert tr.trending(read, day, ["flavor"]).collect() == tr.trending(plain, day, ["flavor"]).collect()


def test_layout_of_odd_rows(spark, tmp_path):
    some = spark.createDataFrame([(None, None, None, None, None, None, None)] * 2 + [("a", "b", "c", "d" * 100_000, "", "", DAY)], MENTION)
    read = clustered.write_clustered(some, str(tmp_path / "odd"), 3)
    assert read.count() == 3 and clustered.mentions_at(read, ["d" * 100_000]).count() == 1
    empty = clustered.write_clustered(some.limit(0), str(tmp_path / "empty"), 3)
    assert empty.columns == [*some.columns, clustered.DAY] and empty.count() == 0
    lacking = clustered.write_clustered(some.drop("entity_type"), str(tmp_path / "lacking"), 2)
    assert lacking.count() == 3


KPI = "name string, current double, prior double, source string, allow_missing_prior boolean"
KPIS = [("a", 1.0, 2.0, "s", False), ("c", 3.0, 0.0, "s", False), ("b", 3.0, None, "s", None), ("d", 3.0, 0.0, "s", True), ("e", None, None, "s", False)]


def test_one_action_yields_rows_and_guard(spark):
    kpis = spark.createDataFrame(KPIS, KPI)
    watched, observation = dq.guarded(kpis)
    assert watched.columns == kpis.columns
    assert sorted(watched.collect(), key=repr) == sorted(kpis.collect(), key=repr)
    assert observation.get == {"checks": 5, "broken": 2, "first_broken": "b"}
    one = dq.all_checks_pass(kpis).first()
    assert (one["checks"], one["broken"]) == (5, 2)


def test_published_kpis_and_strict_callers(spark, tmp_path):
    kpis = spark.createDataFrame(KPIS, KPI)
    published, report = dq.publish_guarded(kpis, str(tmp_path / "k"))
    assert report == {"checks": 5, "broken": 2, "first_broken": "b", "passed": False}
    assert sorted(published.collect(), key=repr) == sorted(kpis.collect(), key=repr)
    with pytest.raises(dq.GuardFailed) as failed:
        dq.publish_guarded(kpis, str(tmp_path / "s"), strict=True)
    assert failed.value.report["first_broken"] == "b" and spark.read.parquet(str(tmp_path / "s")).count() == 5
    none, report = dq.publish_guarded(kpis.limit(0), str(tmp_path / "e"), strict=True)
    assert report == {"checks": 0, "broken": 0, "first_broken": None, "passed": True} and none.count() == 0


def test_door_facts_with_primary_equal_two_passes(spark, tables):
    lines, items = inputs.sold_lines(tables), inputs.items(tables)
    distributors = roles.distributor(tables)
    one = acc.door_facts_with_primary(lines, items, distributors, inputs.AS_OF)
    two = acc.door_facts(lines, items, inputs.AS_OF).join(acc.primary_distributor(lines, items, distributors, inputs.AS_OF), "vip_id", "left")
    assert sorted(map(tuple, one.select(sorted(one.columns)).collect()), key=repr) == sorted(map(tuple, two.select(sorted(one.columns)).collect()), key=repr)


def test_door_facts_of_ties_nulls_and_repeated_lines(spark):
    line = "dist_code string, item_code string, acct_code string, uom string, qty bigint, sale_date date"
    items = spark.createDataFrame([("I1", "x", "b", 12)], "item_code string, item_desc string, brand string, units_per_case int")
    distributors = spark.createDataFrame([("D1", "one"), ("D2", "two")], "distributor_code string, distributor_name string")
    day = date(2001, 7, 1)
    rows = [("D1", "I1", "S1", "B", 5, day), ("D2", "I1", "S1", "B", 5, day), ("D2", "I9", "S2", "B", 1, day), ("D2", "I9", "S2", "B", 1, day), (None, "I1", "S3", "C", 2, day)]
    got = acc.door_facts_with_primary(spark.createDataFrame(rows, line), items, distributors, date(2001, 8, 1))
    by = {r["vip_id"]: r for r in got.collect()}
    two = acc.door_facts(spark.createDataFrame(rows, line), items, date(2001, 8, 1)).collect()
    assert {r["vip_id"]: r["qty_lifetime"] for r in two} == {v: r["qty_lifetime"] for v, r in by.items()}
    assert by["S1"]["primary_distributor_name"] == "two" and by["S1"]["pod_lifetime"] == 1
    assert by["S2"]["primary_distributor_name"] == "two" and by["S2"]["pod_lifetime"] == 1
    assert by["S3"]["primary_distributor_name"] is None
    assert got.count() == 3
