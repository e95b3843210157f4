"""The daily summary, bucketed facts, and mergeable sketches."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F
from shelfline.operators import inventory as inv
from shelfline.operators import sketches as sk
from shelfline.operators import summary
from shelfline.plans import inputs
from shelfline.sources import layout

LINE = "dist_code string, item_code string, acct_code string, uom string, qty bigint, sale_date date"
DAYS = [date(2001, 7, d) for d in (2, 3, 4)]


def lines_of(spark, rows):
    return spark.createDataFrame([(f"D{d}", f"I{i}", f"S{a}", u, q, day) for d, i, a, u, q, day in rows], LINE)


ROWS = [(d, i, d + i, "B" if i else "C", 1 + i, day) for day in DAYS for d in (1, 2) for i in (0, 1) for _ in range(3)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def collected(df):
    return sorted(map(tuple, df.select("dist_code", "acct_code", "item_code", "uom", "qty", "line_count", "sale_date").collect()))


def test_a_late_line_changes_only_its_day(spark, tmp_path):
    path = str(tmp_path / "summary")
    lines = lines_of(spark, ROWS)
    summary.write_summary(lines, path)
    before = files(path)
    late = lines.unionByName(lines_of(spark, [(1, 0, 1, "C", 50, DAYS[1]), (9, 9, 9, None, 4, DAYS[1])]))
    for _ in range(2):  # repeated, as after a failure
        summary.refresh_days(spark, late, path, [DAYS[1]])
        assert collected(summary.read_summary(spark, path)) == collected(summary.daily_summary(late))
    after = files(path)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all(f"sale_date={DAYS[1]}" in f for f in changed)


def test_a_day_without_lines_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "summary")
    lines = lines_of(spark, ROWS)
    summary.write_summary(lines, path)
    left = lines.filter(F.col("sale_date") != F.lit(DAYS[0]))
    summary.refresh_days(spark, left, path, [DAYS[0], DAYS[2], date(2001, 7, 9)])
    assert collected(summary.read_summary(spark, path)) == collected(summary.daily_summary(left))
    assert not os.path.exists(f"{path}/sale_date={DAYS[0]}")
    summary.refresh_days(spark, left, path, [])


def test_operators_take_the_summary_for_its_lines(spark, tables, tmp_path):
    lines, items = inputs.sold_lines(tables, inputs.WINDOW_START), inputs.items(tables)
    path = str(tmp_path / "summary")
    summary.write_summary(lines, path)
    kept = summary.read_summary(spark, path, inputs.WINDOW_START)
    for operator in (inv.distributor_depletion, inv.weekly_family_depletion):
        one, two = (sorted(map(tuple, operator(x, items, inputs.AS_OF).collect()), key=repr) for x in (lines, kept))
        assert one == two
    assert collected(summary.daily_summary(kept)) == collected(kept)
    text = inv.distributor_depletion(kept, items, inputs.AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_date" in text.replace("\n", " ")


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning(l_orderkey" in line or "Exchange hashpartitioning(o_orderkey" in line for line in text.splitlines())


def test_bucketed_facts_join_without_an_exchange(spark, tables, tmp_path, shuffled_joins):
    bucketed = layout.write_bucketed(tables, 4, folder=str(tmp_path / "facts"))
    for build in (inputs.order_totals, inputs.depletion):
        assert exchanges(build(tables)) == 2 and exchanges(build(bucketed)) == 0
    assert sorted(bucketed.lineitem.collect()) == sorted(tables.lineitem.collect())
    assert bucketed.customer.count() == tables.customer.count()
    bucketed.drop()
    assert exchanges(inputs.depletion(bucketed)) == 2  # the plain files again


def test_quantiles_of_merged_states_keep_their_bound(spark):
    facts = spark.range(200_000).select((F.floor(F.col("id") / 30) % 2).alias("g"), (F.col("id") % 30).alias("day"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    states = sk.quantile_states(facts, "v", ["g", "day"], 512).cache()
    for first, last in ((0, 29), (3, 11), (7, 7)):
        days = F.col("day").between(first, last)
        found = sk.quantiles(states.filter(days), {"low": 0.05, "median": 0.5}, ["g"])
        for name, rank in (("low", 0.05), ("median", 0.5)):
            checked = sk.rank_bounds(found, facts.filter(days), "v", name, rank, ["g"], 512).collect()
            assert len(checked) == 2 and all(r["within_bound"] for r in checked)
    assert max(len(r["state"]) for r in states.collect()) < 512 * 8 * 4


def test_quantiles_of_nothing(spark):
    facts = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    assert [tuple(r) for r in sk.quantiles(sk.quantile_states(facts, "v", ["g"]), {"median": 0.5}, ["g"]).collect()] == [("b", 1, 2.0)]
    assert sk.quantiles(sk.quantile_states(facts.limit(0), "v", ["g"]), {"median": 0.5}).collect() == []


def test_distinct_states_of_any_period(spark):
    facts = spark.range(100_000).select((F.col("id") % 60).cast("int").alias("d"), (F.col("id") * 31 % 20_011).alias("who"))
    facts = facts.select(F.date_add(F.lit(date(2001, 1, 1)), F.col("d")).alias("day"), "who")
    states = sk.distinct_states(facts, {"n": "who"}, ["day"])
    periods = {str(k): F.col("day") >= F.lit(date(2001, 1, 1 + k)) for k in (0, 20, 30)} | {"none": F.col("day") > F.lit(date(2002, 1, 1))}
    got = {r["period"]: r["n"] for r in sk.distinct_by_period(states, "day", ["n"], periods).collect()}
    exact = {r["period"]: r["active"] for r in sk.active_by_period(facts, "who", "day", periods).collect()}
    assert got["none"] == exact["none"] == 0
    for period, condition in periods.items():
        assert exact[period] == facts.filter(condition).select("who").distinct().count()
        assert abs(got[period] - exact[period]) <= exact[period] * sk.distinct_error()
