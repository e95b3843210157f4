"""What the physical plans must and must not contain."""

import pytest

from shelfline.plans.all import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["Q05_parent_rollup", "Q07_inventory_health", "Q71_scorecard", "Q87_overlap_duplicates", "Q92_cumulative_value",
     "Q77_sku_state_cells", "J04_or_left_join", "J10_equi_and_band", "U07_dense_grid"],
)
def test_no_pairwise_joins(tables, name):
    text = plan(QUERIES[name].build(tables))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_no_python_in_the_headline_plans(tables):
    from bench import HEADLINES

    for name in HEADLINES:
        text = QUERIES[name].build(tables)._jdf.queryExecution().analyzed().toString()
        assert "PythonUDF" not in text and "InPandas" not in text and "InArrow" not in text, name


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(QUERIES["Q04_distributor_depletion"].build(tables))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text.replace("\n", " ")
    assert "l_extendedprice" not in text
    text = plan(QUERIES["S03_parameterised_scan"].build(tables))
    assert "o_custkey" not in text and "PushedFilters: [IsNotNull(o_orderdate)" in text


def scans(tables, name, fact):
    """Reads of a table in the whole plan, sub-queries included."""
    return plan(QUERIES[name].build(tables)).count(f"{fact}.parquet")


@pytest.mark.parametrize("name", ["Q68_universe_totals", "Q71_scorecard", "Q71_scorecard_chain", "Q72_variance", "Q103_scorecard_checks"])
def test_scorecards_read_the_lines_once_and_from_a_day_on(tables, name):
    text = plan(QUERIES[name].build(tables)).replace("\n", " ")
    assert scans(tables, name, "lineitem") <= 2
    assert "GreaterThanOrEqual(l_shipdate" in text


@pytest.mark.parametrize(
    "name", ["Q83_customer_lifetime", "Q88_cohort_table", "Q92_cumulative_matrix", "Q92_cumulative_value", "Q93_retention", "Q94_recent_cohort_curves"]
)
def test_only_the_overlap_window_enters_the_duplicate_join(tables, name):
    # The window of either platform, the rest of the history, and the web orders.
    assert scans(tables, name, "orders") <= 4


def test_history_outside_the_window_is_not_shuffled_for_duplicates(tables):
    text = plan(QUERIES["Q83_customer_lifetime"].build(tables)).replace("\n", " ")
    assert text.count("SortMergeJoin") + text.count("BroadcastHashJoin") + text.count("ShuffledHashJoin") <= 1


@pytest.mark.parametrize("name", ["Q01_uom_to_units", "J03_inner_with_flag", "P06_safe_cast_predicate", "F02_parse_date", "Q104_match_rate"])
def test_no_join_for_an_unused_account(tables, name):
    assert scans(tables, name, "orders") == 0


@pytest.mark.parametrize("name", ["Q03_all_channel_revenue", "Q61_weekly_retail_revenue"])
def test_no_join_for_an_unused_customer(tables, name):
    assert scans(tables, name, "customer") == 0


@pytest.mark.parametrize("name", ["Q12_distributor_weekly_trend", "Q73_chain_scorecard", "Q76_sku_summary", "A02_count_distinct"])
def test_distinct_counts_do_not_expand(tables, name):
    assert "Expand" not in plan(QUERIES[name].build(tables))


def test_stockout_risk_reads_the_lines_twice(tables):
    assert scans(tables, "Q14_stockout_risk", "lineitem") <= 2
    assert scans(tables, "Q14_stockout_risk", "orders") <= 2


def test_symmetry_checks_read_half_a_year(tables):
    text = plan(QUERIES["Q103_symmetry_breaks"].build(tables)).replace("\n", " ")
    assert scans(tables, "Q103_symmetry_breaks", "lineitem") == 1
    assert "GreaterThanOrEqual(l_shipdate" in text


def test_lines_of_the_flagship(tables):
    # Sell-through and order lines read the line items once each, the revenue total a third time.
    assert scans(tables, "Q07_inventory_health", "lineitem") <= 3
    assert scans(tables, "Q07_inventory_health", "customer") <= 1


def test_the_door_sheet_reads_the_lines_once(tables):
    assert scans(tables, "Q67_door_fact_sheet", "lineitem") == 1
    assert scans(tables, "Q67_door_fact_sheet", "orders") == 1
