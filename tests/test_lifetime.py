import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from shelfline.operators import lifetime as ltv

ORDERS = "order_id string, email string, ordered_at timestamp, total decimal(18,4), source string, refunded boolean"
START, END = date(2024, 6, 1), date(2024, 10, 1)


def frame(spark, data, source):
    return spark.createDataFrame([(i, e, t, Decimal(str(v)), source, False) for i, e, t, v in data], ORDERS)


def test_duplicates_at_the_edge_of_the_band(spark):
    t = datetime(2024, 7, 1, 9)
    legacy = [("1", "a", t, 10.99), ("2", "a", t, 11.0), ("3", "a", t + timedelta(days=1), 10), ("4", "b", t, 10),
              ("5", "a", datetime(2024, 10, 1), 10), ("6", "a", t, 9.01), ("7", "a", t, 9.0)]
    web = [("w", "a", t + timedelta(hours=3), 10), ("w2", "a", datetime(2024, 10, 1), 10)]
    l, w = frame(spark, legacy, "woocommerce"), frame(spark, web, "shopify")
    found = {r[0] for r in ltv.overlap_duplicates(l, w, START, END).collect()}
    assert found == {"1", "6"}
    kept = {r["order_id"] for r in ltv.deduplicated_orders(l, w, START, END).collect()}
    assert kept == {"2", "3", "4", "5", "7", "w", "w2"}


def test_duplicates_equal_the_pairwise_definition_with_a_hot_address(spark):
    rnd = random.Random(3)
    day = datetime(2024, 7, 1)

    def some(n, prefix):
        out = []
        for i in range(n):
            email = "hot" if i % 3 == 0 else f"e{rnd.randint(0, 20)}"
            when = day + timedelta(days=rnd.randint(0, 3), hours=rnd.randint(0, 23))
            out.append((f"{prefix}{i}", email, when, round(rnd.uniform(0, 60), 2)))
        return out

    legacy, web = some(300, "l"), some(200, "w")
    expected = {
        i for i, e, t, v in legacy
        if any(e == e2 and t.date() == t2.date() and abs(Decimal(str(v)) - Decimal(str(v2))) < 1 for _, e2, t2, v2 in web)
    }
    found = ltv.overlap_duplicates(frame(spark, legacy, "woocommerce"), frame(spark, web, "shopify"), START, END)
    assert {r[0] for r in found.collect()} == expected


def cohorts(spark, data):
    return spark.createDataFrame(
        data, "cohort string, months_since_first int, customers bigint, revenue double, revenue_per_customer double"
    )


def test_mature_value_counts_a_cohort_exactly_old_enough(spark):
    data = [("2024-01", 0, 10, 100.0, 10.0), ("2024-01", 5, 2, 50.0, 25.0), ("2024-01", 6, 1, 999.0, 999.0),
            ("2024-02", 0, 90, 900.0, 10.0)]
    out = ltv.mature_lifetime_value(cohorts(spark, data), 6, date(2024, 7, 15)).collect()[0]
    assert (out["ltv"], out["qualifying_cohorts"], out["latest_cohort"]) == (15.0, 1, "2024-01")
    none = ltv.mature_lifetime_value(cohorts(spark, data), 12, date(2024, 7, 15)).collect()[0]
    assert (none["ltv"], none["qualifying_cohorts"], none["earliest_cohort"]) == (0.0, 0, None)


def test_cumulative_cells_and_unbaked_months(spark):
    data = [("2024-01", 0, 10, 100.0, 10.0), ("2024-01", 2, 2, 50.0, 25.0), ("2024-03", 0, 4, 40.0, 10.0)]
    out = ltv.cumulative_value(cohorts(spark, data), date(2024, 4, 2)).collect()
    cells = {(r["cohort"], r["months_since_first"]): r["cumulative_per_customer"] for r in out}
    assert cells == {("2024-01", 0): 10.0, ("2024-01", 2): 15.0, ("2024-03", 0): 10.0, ("2024-03", 2): None}


def test_retention_needs_more_than_fifty(spark):
    data = [("a", 0, 50, 1.0, 1.0), ("b", 0, 51, 1.0, 1.0), ("b", 1, 17, 1.0, 1.0), ("c", 1, 5, 1.0, 1.0)]
    out = ltv.retention(cohorts(spark, data)).collect()
    cells = {(r["cohort"], r["months_since_first"]): r["retention_pct"] for r in out}
    assert set(cells) == {("b", 0), ("b", 1)} and cells[("b", 0)] == 100.0
    assert round(cells[("b", 1)], 6) == round(100 * 17 / 51, 6)


def test_cohort_folding_equals_first_order_join(spark):
    t = lambda m, d: datetime(2024, m, d, 12)
    data = [("1", "a", t(1, 31), 5), ("2", "a", t(2, 1), 7), ("3", "a", t(2, 9), 1), ("4", "b", t(2, 2), 3)]
    out = {(r["cohort"], r["months_since_first"]): (r["customers"], r["orders"], r["revenue"])
           for r in ltv.cohort_table(frame(spark, data, "shopify")).collect()}
    assert out == {("2024-01", 0): (1, 1, 5.0), ("2024-01", 1): (1, 2, 8.0), ("2024-02", 0): (1, 1, 3.0)}
