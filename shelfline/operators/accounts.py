"""Key-account reports over outlets ("doors"), chains and SKUs.

A door is one outlet (``vip_id``). Windows: last n days are (as_of - n, as_of],
the previous n days come before that; previous-90 is therefore days 91-180.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import col, growth_percent, in_list, ratio, zero_if_null
from shelfline.functions.dates import (
    days_before,
    month_column,
    month_start,
    shift_months,
    trailing_months,
)
from shelfline.functions.joins import grand_total, members_of, top_groups
from shelfline.operators.inventory import depletion_by, in_units, sums_by
from shelfline.sources.storage import materialise

# Fixed values.
ACTIVE_DAYS, AT_RISK_DAYS = 90, 180
HEALTHY_SHARE, AT_RISK_SHARE = 0.7, 0.4
NEW_TRENDS = ["New", "New Activity"]
VOLUME_COLUMNS = {
    "Last 30d": "qty_last_30_days",
    "Last 90d": "qty_last_90_days",
    "YTD": "qty_ytd",
    "Lifetime": "qty_lifetime",
}
KPI_UNITS = [
    ("Depletions", "Case equivs (L90D)"),
    ("Accounts Buying", "Doors w/ sales (L90D)"),
    ("SKUs per Account", "Avg SKUs / door"),
    ("Velocity per Account", "CE / active door (L90D)"),
    ("Off-Premise Buying %", "Off-Prem / Total (L90D)"),
    ("Reorder Rate", "Doors ordering 2x+ (L90D)"),
]


def _units_where(flag: str | Column) -> Column:
    return zero_if_null(F.sum(F.when(col(flag), F.col("units"))))


# -- facts ---------------------------------------------------------------------------

def _fact_windows(as_of: date) -> dict[str, Column]:
    day = F.col("sale_date")
    after = lambda n: day > F.lit(days_before(as_of, n))
    return {
        "ytd": day >= F.lit(date(as_of.year, 1, 1)),
        "l30": after(30),
        "p30": after(60) & ~after(30),
        "l90": after(90),
        "p90": after(180) & ~after(90),
    }


def _door_fact_columns(wanted: Column | None = None) -> list[Column]:
    """Aggregates per door over rows per item, of which only ``wanted`` count."""
    own = lambda c: F.col(c) if wanted is None else F.when(wanted, F.col(c))
    pods = lambda c: F.count_if(own(c) > 0)
    return [
        F.min(own("first_sale")).alias("first_order_date"),
        F.max(own("last_sale")).alias("most_recent_order_date"),
        F.sum(own("units")).alias("qty_lifetime"),
        F.sum(own("ytd")).alias("qty_ytd"),
        F.sum(own("l30")).alias("qty_last_30_days"),
        F.sum(own("p30")).alias("qty_previous_30_days"),
        F.sum(own("l90")).alias("qty_last_90_days"),
        F.sum(own("p90")).alias("qty_previous_90_days"),
        pods("units").alias("pod_lifetime"),
        pods("ytd").alias("pod_ytd"),
        pods("l30").alias("pod_last_30"),
        pods("p30").alias("pod_previous_30"),
    ]


def door_facts(lines: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    """Volume, points of distribution and order dates per door.

    Lines first collapse to door x item with the units of every window side by side;
    items become rows, so a point of distribution is a row with sales and no distinct
    count is needed.
    """
    grain = depletion_by(lines.filter(F.col("sale_date") <= F.lit(as_of)), items, ["acct_code"], _fact_windows(as_of))
    return grain.groupBy(F.col("acct_code").alias("vip_id")).agg(*_door_fact_columns())


def door_facts_with_primary(lines: DataFrame, items: DataFrame, distributors: DataFrame, as_of: date) -> DataFrame:
    """``door_facts`` and ``primary_distributor`` from one pass over the lines.

    Lines collapse to door x distributor x item. Each of these rows counts once for its
    item and once for its distributor, and both kinds fold side by side: a door of many
    distributors has one row per item again, and one per distributor, before its totals.
    """
    windows = _fact_windows(as_of)
    sold = lines.filter(F.col("sale_date") <= F.lit(as_of))
    grain = depletion_by(sold, items, ["acct_code", "dist_code"], windows)
    kept = ["units", *windows, "first_sale", "last_sale"]
    nothing = [F.lit(None).cast(grain.schema[c].dataType).alias(c) for c in kept[1:]]
    rows = F.array(
        F.struct(F.lit(True).alias("of_item"), F.col("item_code").alias("code"), *kept),
        F.struct(F.lit(False).alias("of_item"), F.col("dist_code").alias("code"), "units", *nothing),
    )
    folded = grain.select("acct_code", F.inline(rows)).groupBy("acct_code", "of_item", "code").agg(
        *[F.sum(c).alias(c) for c in ("units", *windows)], F.min("first_sale").alias("first_sale"), F.max("last_sale").alias("last_sale")
    )
    of_item = F.col("of_item")
    most = F.max_by(F.when(~of_item, F.col("code")), F.when(~of_item, F.struct("units", "code")))
    facts = folded.groupBy(F.col("acct_code").alias("vip_id")).agg(*_door_fact_columns(of_item), most.alias("code"))
    names = distributors.select(F.col("distributor_code").alias("code"), F.col("distributor_name").alias("primary_distributor_name"))
    return facts.join(names, "code", "left").drop("code")


def primary_distributor(lines: DataFrame, items: DataFrame, distributors: DataFrame, as_of: date) -> DataFrame:
    """The distributor with the most units per door; ties by code."""
    sold = lines.filter(F.col("sale_date") <= F.lit(as_of))
    per_code = depletion_by(sold, items, ["acct_code", "dist_code"])
    per_code = per_code.groupBy("acct_code", "dist_code").agg(F.sum("units").alias("units"))
    best = per_code.groupBy(F.col("acct_code").alias("vip_id")).agg(
        F.max_by("dist_code", F.struct("units", "dist_code")).alias("code")
    )
    names = distributors.select(
        F.col("distributor_code").alias("code"),
        F.col("distributor_name").alias("primary_distributor_name"),
    )
    return best.join(names, "code", "left").drop("code")


def door_fact_sheet(
    doors: DataFrame, facts: DataFrame, as_of: date, primary: DataFrame | None = None
) -> DataFrame:
    """Q67: attributes and facts per door with status and 30-day trend.

    Active: ordered within 90 days; At Risk: within 180; else Churned. New: first
    order in the last 30 days; New Activity: none in the previous 30 but some now.
    """
    joined = doors.join(facts, "vip_id", "left")
    if primary is not None:
        joined = joined.join(primary, "vip_id", "left")
    counts = [c for c in facts.columns if c.startswith(("qty_", "pod_"))]
    filled = joined.na.fill(0, counts)
    now, before = F.col("qty_last_30_days"), F.col("qty_previous_30_days")
    since = F.date_diff(F.lit(as_of), F.col("most_recent_order_date"))
    status = (
        F.when(F.col("days_since_last_order") <= ACTIVE_DAYS, "Active")
        .when(F.col("days_since_last_order") <= AT_RISK_DAYS, "At Risk")
        .otherwise("Churned")
    )
    trend = (
        F.when(F.col("first_order_date") > F.lit(days_before(as_of, 30)), "New")
        .when((before == 0) & (now > 0), "New Activity")
        .when(now > before, "Growing")
        .when(now < before, "Declining")
        .otherwise("Stable")
    )
    change = F.when(before > 0, (now - before) / before * 100.0)
    return filled.withColumn("days_since_last_order", since).withColumns(
        {
            "qty_delta_30d": now - before,
            "qty_pct_change_30d": change,
            "pod_delta": F.col("pod_last_30") - F.col("pod_previous_30"),
            "customer_status": status,
            "trend_30d": trend,
        }
    )


def recent_door_kpis(doors: DataFrame, lines: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    """Units of the last 90 days and of the 90 before per door, and whether it churned:
    nothing ordered within ``AT_RISK_DAYS``, which is all that needs to be read."""
    day = F.col("sale_date")
    after = lambda n: day > F.lit(days_before(as_of, n))
    recent = lines.filter((day >= F.lit(days_before(as_of, AT_RISK_DAYS))) & (day <= F.lit(as_of)))
    grain = depletion_by(recent, items, ["acct_code"], {"current": after(90), "prior": after(180) & ~after(90)})
    sums = grain.groupBy(F.col("acct_code").alias("vip_id")).agg(F.sum("current").alias("current"), F.sum("prior").alias("prior"))
    joined = doors.select("vip_id").join(sums, "vip_id", "left")
    return joined.select("vip_id", zero_if_null("current").alias("current"), zero_if_null("prior").alias("prior"), F.col("current").isNull().alias("churned"))


def chain_doors(sheet: DataFrame) -> DataFrame:
    """Doors that belong to a chain."""
    return sheet.filter(F.col("chain_code").isNotNull() & (F.col("chain_code") != ""))


def universe_since(end: date) -> date:
    """First day that the universe totals up to ``end`` look at."""
    return min(date(end.year - 1, 1, 1), days_before(end, 180))


def universe_totals(lines: DataFrame, items: DataFrame, end: date) -> DataFrame:
    """Q68: volume and active doors of four windows that end at ``end``, the latest sale.

    The prior-year window is the year to date shifted by twelve months. All bounds are
    literals, so they reach the scan.
    """
    day = F.col("sale_date")
    after = lambda n: day > F.lit(days_before(end, n))
    until = F.add_months(F.lit(end), -12)
    windows = {
        "l90d": after(90),
        "prior_90d": after(180) & ~after(90),
        "ytd": day >= F.lit(date(end.year, 1, 1)),
        "py_ytd": (day >= F.lit(date(end.year - 1, 1, 1))) & (day <= until),
    }
    recent = lines.filter(day >= F.lit(universe_since(end)))
    grain = depletion_by(recent, items, ["acct_code"], windows)
    per_door = grain.groupBy("acct_code").agg(*[F.sum(w).alias(w) for w in windows])
    return per_door.agg(
        *[zero_if_null(F.sum(w)).cast("double").alias(f"{w}_volume") for w in windows],
        *[F.count_if(F.col(w) > 0).alias(f"{w}_active_doors") for w in windows],
    )


def active_doors(sheet: DataFrame, days: int = ACTIVE_DAYS) -> DataFrame:
    """Q62: doors that ordered within ``days``."""
    recent = F.when(F.col("days_since_last_order") <= days, F.col("vip_id"))
    return sheet.agg(F.countDistinct(recent).alias("active_doors"))


def chain_sku_wide(
    lines: DataFrame, items: DataFrame, doors: DataFrame, distributors: DataFrame, as_of: date, named: bool = True
) -> DataFrame:
    """Q69: one row per chain door, SKU and distributor with twelve month columns.

    ``ttm_current`` is their sum, ``ttm_prior`` the twelve months before them. Lines of
    other outlets go first, by a join on the outlet that also deals the lines to their
    fold and to the outlets' attributes. The items come last: reports per SKU fold where
    that join has put the rows. Reports without distributors leave out their names (not
    ``named``), for which all rows would move once more; a code that the master repeats
    repeats its rows all the same.
    """
    months = trailing_months(as_of)
    month = month_start("sale_date")
    windows = {month_column(m): month == F.lit(m) for m in months}
    windows["ttm_current"] = month >= F.lit(months[0])
    windows["ttm_prior"] = (month >= F.lit(shift_months(months[0], -12))) & (month < F.lit(months[0]))
    in_chain = doors.filter("chain_code IS NOT NULL").select(
        "chain_code", "chain_name", "vip_id", "store_name",
        F.col("city").alias("store_city"), F.col("state").alias("store_state"),
    )
    sold = lines.filter(F.col("sale_date") <= F.lit(as_of))
    sold = sold.join(in_chain.select(F.col("vip_id").alias("acct_code")), "acct_code", "left_semi")
    located = sums_by(sold, ["acct_code", "dist_code"], windows).join(in_chain, F.col("acct_code") == F.col("vip_id"))
    code = F.col("distributor_code").alias("dist_code")
    if named:
        located = located.join(distributors.select(code, "distributor_name"), "dist_code", "left")
    else:
        repeated = distributors.groupBy(code).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        counted = located.join(F.broadcast(repeated), "dist_code", "left")
        copies = F.array_repeat(F.lit(True), F.coalesce("copies", F.lit(1)).cast("int"))
        located = counted.withColumn("copies", F.explode(copies))
    return in_units(located, items, list(windows)).select(
        "chain_code", "chain_name", "vip_id", "store_name", "store_city", "store_state",
        *(["distributor_name"] if named else []), "item_code", F.coalesce("item_desc", "item_code").alias("item_name"),
        *windows, F.col("units").alias("total_units_all_time"),
    )


def data_through(sheet: DataFrame, lines: DataFrame) -> DataFrame:
    """S09: latest date per source."""
    facts = sheet.agg(F.max("most_recent_order_date").alias("fact_sheet_through"))
    latest = lines.agg(F.max("sale_date").alias("d")).select("d").scalar()
    return facts.withColumn("sales_through", latest)


# -- owners and filters ----------------------------------------------------------------

def chain_owner(doors: DataFrame) -> DataFrame:
    """Q70: the owner of most doors per chain; unowned doors do not vote, ties go to
    the first name."""
    votes = doors.filter("sf_owner_name IS NOT NULL AND chain_code IS NOT NULL")
    votes = votes.groupBy("chain_code", "sf_owner_name").agg(F.count(F.lit(1)).alias("doors"))
    # The least struct is the most doors, then the first name.
    return votes.groupBy("chain_code").agg(
        F.min_by("sf_owner_name", F.struct(-F.col("doors"), "sf_owner_name")).alias("kam")
    )


def portfolio(
    doors: DataFrame,
    kam: str | None = None,
    chains: Sequence[str] | None = None,
    states: Sequence[str] | None = None,
) -> DataFrame:
    """P10: cascading owner -> chain -> state selection of doors."""
    if kam is not None:
        owned = chain_owner(doors).filter(F.col("kam") == kam)
        doors = doors.join(owned, "chain_code", "left_semi")
    return doors.filter(in_list("chain_name", chains) & in_list("state", states))


# -- scorecard ----------------------------------------------------------------------

def _door_kpis(doors: DataFrame) -> DataFrame:
    """Both periods of the door-based KPIs; per-door flags first, so set overlaps are
    counts of doors with both flags."""
    now, before = F.col("qty_last_90_days"), F.col("qty_previous_90_days")
    slice_60_90 = zero_if_null(before) - zero_if_null("qty_previous_30_days")
    again = (F.col("qty_last_30_days") > 0) & (F.col("qty_previous_30_days") > 0)
    again_before = (F.col("qty_previous_30_days") > 0) & (slice_60_90 > 0)
    per_door = doors.groupBy("vip_id").agg(
        F.sum(now).alias("now"),
        F.sum(before).alias("before"),
        F.count_if(now > 0).alias("active"),
        F.count_if(before > 0).alias("active_before"),
        F.bool_or(F.col("channel_type") == "Off-Premise").alias("off"),
        F.count_if(again).alias("again"),
        F.count_if(again_before).alias("again_before"),
    )
    is_active, was_active = F.col("active") > 0, F.col("active_before") > 0
    return per_door.agg(
        zero_if_null(F.sum("now")).cast("double").alias("depl"),
        zero_if_null(F.sum("before")).cast("double").alias("depl_p"),
        zero_if_null(F.sum("active")).cast("double").alias("active"),
        zero_if_null(F.sum("active_before")).cast("double").alias("active_p"),
        F.count_if(is_active).alias("ids"),
        F.count_if(was_active).alias("ids_p"),
        F.count_if(is_active & F.col("off")).alias("off"),
        F.count_if(was_active & F.col("off")).alias("off_p"),
        zero_if_null(F.sum("again")).alias("again"),
        zero_if_null(F.sum("again_before")).alias("again_p"),
    )


def _skus_per_door(skus: DataFrame, months: Sequence[str]) -> DataFrame:
    """Mean distinct SKUs per door over the last three months and the three before."""
    units = lambda cols: sum((zero_if_null(c) for c in cols[1:]), zero_if_null(cols[0]))
    per_sku = skus.groupBy("vip_id", "item_code").agg(
        F.bool_or(units(months[9:12]) > 0).alias("now"), F.bool_or(units(months[6:9]) > 0).alias("before")
    )
    per_door = per_sku.groupBy("vip_id").agg(
        F.count_if("now").alias("now"), F.count_if("before").alias("before")
    )
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    return per_door.agg(mean("now").alias("skus"), mean("before").alias("skus_p"))


def scorecard(
    doors: DataFrame,
    skus: DataFrame,
    months: Sequence[str],
    universe: DataFrame | None = None,
    chain: str | None = None,
) -> DataFrame:
    """Q71: six KPIs, current against prior, one row each.

    Reorder rate: doors buying in both 30-day windows over active doors; its prior
    form intersects the previous 30 days with (previous 90 - previous 30) > 0, an
    arithmetic kept as given although previous-90 lies further back. Without a chain
    filter, non-zero universe totals replace volume and active doors.
    """
    if chain is not None:
        doors = doors.filter(F.col("chain_name") == chain)
        skus = skus.filter(F.col("chain_name") == chain)
    base = _door_kpis(doors).withColumn(
        "_s", _skus_per_door(skus, months).select(F.struct("skus", "skus_p")).scalar()
    )
    if universe is not None and chain is None:
        names = ["l90d_volume", "prior_90d_volume", "l90d_active_doors", "prior_90d_active_doors"]
        base = base.withColumn("_u", universe.select(F.struct(*names)).scalar())
        base = _replaced(base, [f"_u.{n}" for n in names])
    return _kpi_rows(base)


def _replaced(base: DataFrame, universe: Sequence[str]) -> DataFrame:
    """Volume and active doors of both periods replaced by non-zero universe figures."""
    usable = lambda n: F.when(F.col(n) != 0, F.col(n).cast("double"))
    own = ["depl", "depl_p", "active", "active_p"]
    return base.withColumns({c: F.coalesce(usable(n), F.col(c)) for c, n in zip(own, universe)})


def _kpi_rows(base: DataFrame) -> DataFrame:
    """One row per KPI from the one row of sums."""
    or_zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    share = lambda a, b: or_zero(a, b) * 100
    # Reorder rate stays on the fact sheet's own active doors.
    values = [
        ("depl", "depl_p"),
        ("active", "active_p"),
        ("_s.skus", "_s.skus_p"),
        (or_zero("depl", "active"), or_zero("depl_p", "active_p")),
        (share("off", "ids"), share("off_p", "ids_p")),
        (share("again", "sheet_active"), share("again_p", "sheet_active_p")),
    ]
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("kpi"),
            F.lit(unit).alias("unit"),
            col(current).cast("double").alias("current"),
            col(prior).cast("double").alias("prior"),
        )
        for i, ((name, unit), (current, prior)) in enumerate(zip(KPI_UNITS, values), start=1)
    ]
    kept = base.withColumns({"sheet_active": F.col("ids"), "sheet_active_p": F.col("ids_p")})
    return kept.select(F.inline(F.array(*rows)))


def scorecard_since(as_of: date, end: date | None = None) -> date:
    """First day that a scorecard for ``as_of`` (universe totals up to ``end``) looks at."""
    first = min(days_before(as_of, 180), trailing_months(as_of)[6])
    return first if end is None else min(first, days_before(end, 180))


def scorecard_of_lines(
    lines: DataFrame, items: DataFrame, doors: DataFrame, as_of: date, end: date | None = None, chain: str | None = None
) -> DataFrame:
    """Q71 from the sell-through itself: the same KPIs as ``scorecard`` gives on the
    fact sheet, the SKU table and the universe totals, from one pass over the lines.

    Lines fold to outlet x item with every window side by side, then to outlets;
    ``end`` is the latest sale, where the universe windows end (None: no universe).
    A chain filters the outlets, and only outlets of chains count for SKUs.
    """
    day = F.col("sale_date")
    months = trailing_months(as_of)
    seen = day <= F.lit(as_of)
    between = lambda far, near, last: (day > F.lit(days_before(last, far))) & (day <= F.lit(days_before(last, near)))
    windows = {
        "l30": between(30, 0, as_of),
        "p30": between(60, 30, as_of),
        "l90": between(90, 0, as_of),
        "p90": between(180, 90, as_of),
        "m_now": seen & (day >= F.lit(months[9])),
        "m_before": seen & (day >= F.lit(months[6])) & (day < F.lit(months[9])),
    }
    if end is not None:
        windows |= {"u90": between(90, 0, end), "u180": between(180, 90, end)}
    recent = lines.filter(day >= F.lit(scorecard_since(as_of, end)))
    grain = depletion_by(recent, items, ["acct_code"], windows)
    sums = [w for w in windows if not w.startswith("m_")]
    per_outlet = grain.groupBy("acct_code").agg(
        *[F.sum(w).alias(w) for w in sums],
        F.count_if(F.col("m_now") > 0).alias("skus_now"),
        F.count_if(F.col("m_before") > 0).alias("skus_before"),
    )
    known = doors.select(F.col("vip_id").alias("acct_code"), "channel_type", "chain_name", "chain_code", F.lit(True).alias("known"))
    if chain is not None:
        known = known.filter((F.col("chain_name") == chain) & F.col("chain_code").isNotNull())
    located = per_outlet.join(known, "acct_code", "left" if chain is None else "inner")
    is_door, in_chain = F.col("known").isNotNull(), F.col("chain_code").isNotNull()
    has = lambda w: is_door & (F.col(w) > 0)
    off = F.col("channel_type") == "Off-Premise"
    again_before = zero_if_null("p90") - zero_if_null("p30") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(in_chain & (F.col(c) > 0), F.col(c))), F.lit(0.0))
    total = lambda w: zero_if_null(F.sum(F.when(is_door, F.col(w)))).cast("double")
    universe = {"u_now": "u90", "u_before": "u180"} if end is not None else {}
    base = located.agg(
        total("l90").alias("depl"),
        total("p90").alias("depl_p"),
        F.count_if(has("l90")).cast("double").alias("active"),
        F.count_if(has("p90")).cast("double").alias("active_p"),
        F.count_if(has("l90")).alias("ids"),
        F.count_if(has("p90")).alias("ids_p"),
        F.count_if(has("l90") & off).alias("off"),
        F.count_if(has("p90") & off).alias("off_p"),
        F.count_if(has("l30") & has("p30")).alias("again"),
        F.count_if(has("p30") & again_before).alias("again_p"),
        F.struct(mean("skus_now").alias("skus"), mean("skus_before").alias("skus_p")).alias("_s"),
        *[zero_if_null(F.sum(w)).cast("double").alias(n) for n, w in universe.items()],
        *[F.count_if(F.col(w) > 0).alias(f"{n}_doors") for n, w in universe.items()],
    )
    if universe:
        base = _replaced(base, ["u_now", "u_before", "u_now_doors", "u_before_doors"])
    return _kpi_rows(base)


def variance(kpis: DataFrame) -> DataFrame:
    """Q72: change, percent change, sign class and bar proportions of each KPI."""
    now, before = F.col("current"), F.col("prior")
    has_prior = before.isNotNull() & (before != 0)
    change = now - before
    pct = F.when(has_prior, change / before * 100)
    sign = lambda c: F.when(c > 0, "pos").when(c < 0, "neg").otherwise("neutral")
    bar = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c / F.greatest(before, now) * 100))
    return kpis.withColumns(
        {
            "change": change,
            "change_class": sign(change),
            "pct_change": pct,
            "pct_class": F.when(has_prior, sign(pct)).when(now > 0, "pos").otherwise("neutral"),
            "pct_label": F.when(has_prior, F.lit(None).cast("string")).when(now > 0, "New").otherwise("—"),
            "current_bar": F.when(has_prior, F.when(now != 0, bar(now)).otherwise(0.0))
            .when(now != 0, 100.0)
            .otherwise(0.0),
            "prior_bar": F.when(has_prior, bar(before)).otherwise(0.0),
        }
    )


# -- door and chain reports -------------------------------------------------------------

def _status(name: str) -> Column:
    return F.count_if(F.col("customer_status") == name)


def chain_scorecard(doors: DataFrame, period: str = "Last 30d") -> DataFrame:
    """Q73: stores, volume, states, growth and health per chain. A store is in one state."""
    chain = ["chain_code", "chain_name"]
    sums = {
        "volume": VOLUME_COLUMNS[period],
        "qty_30d": "qty_last_30_days",
        "qty_prev_30d": "qty_previous_30_days",
        "pod_30": "pod_last_30",
    }
    counts = {"active_stores": "Active", "at_risk_stores": "At Risk", "churned_stores": "Churned"}
    # One row per store, then per state: distinct counts become row counts.
    per_store = doors.groupBy(*chain, "state", "vip_id").agg(
        *[_status(s).alias(c) for c, s in counts.items()], *[F.sum(s).alias(c) for c, s in sums.items()]
    )
    per_state = per_store.groupBy(*chain, "state").agg(
        F.count("vip_id").alias("total_stores"), *[F.sum(c).alias(c) for c in [*counts, *sums]]
    )
    out = per_state.groupBy(*chain).agg(
        *[F.sum(c).alias(c) for c in ["total_stores", *counts, *sums]], F.count("state").alias("states")
    )
    stores = F.col("total_stores")
    health = (
        F.when(F.col("active_stores") >= stores * HEALTHY_SHARE, "Healthy")
        .when(F.col("active_stores") >= stores * AT_RISK_SHARE, "At Risk")
        .otherwise("Critical")
    )
    return out.withColumns({"delta_pct": growth_percent("qty_30d", "qty_prev_30d"), "health": health})


def portfolio_kpis(doors: DataFrame, period: str = "Last 30d") -> DataFrame:
    """Q74: headline numbers of a selection of doors."""
    pod = "pod_last_30" if period == "Last 30d" else "pod_ytd"
    out = doors.agg(
        F.countDistinct("chain_code").alias("chains"),
        F.count(F.lit(1)).alias("doors"),
        _status("Active").alias("active_doors"),
        _status("At Risk").alias("at_risk_doors"),
        _status("Churned").alias("churned_doors"),
        zero_if_null(F.sum(VOLUME_COLUMNS[period])).alias("volume"),
        zero_if_null(F.sum(pod)).alias("total_pod"),
        zero_if_null(F.sum("qty_last_30_days")).alias("qty_30d"),
        zero_if_null(F.sum("qty_previous_30_days")).alias("qty_prev_30d"),
    )
    return out.withColumns(
        {
            "growth_pct": growth_percent("qty_30d", "qty_prev_30d"),
            "avg_per_active": F.coalesce(ratio("volume", "active_doors"), F.lit(0.0)),
        }
    )


def store_table(doors: DataFrame, chain: str, period: str = "Last 30d") -> DataFrame:
    """Q74: the stores of one chain by volume."""
    volume = VOLUME_COLUMNS[period]
    return doors.filter(F.col("chain_name") == chain).select(
        "vip_id", "store_name", "city", "state", "customer_status", "trend_30d",
        F.col(volume).alias("volume"), "pod_last_30", "qty_delta_30d", "qty_pct_change_30d",
        "primary_distributor_name",
    ).orderBy(F.col("volume").desc(), "vip_id")


def top_states(doors: DataFrame, period: str = "Last 30d", n: int = 15) -> DataFrame:
    """Q75: largest states by volume."""
    out = doors.groupBy("state").agg(F.sum(VOLUME_COLUMNS[period]).alias("volume"))
    return out.orderBy(F.col("volume").desc(), "state").limit(n)


def _location() -> Column:
    return F.concat(F.col("city"), F.lit(", "), F.col("state"))


def top_cities(doors: DataFrame, period: str = "Last 30d", n: int = 15) -> DataFrame:
    """Q75: largest cities by volume with their doors."""
    out = doors.groupBy("city", "state").agg(
        F.sum(VOLUME_COLUMNS[period]).alias("volume"), F.countDistinct("vip_id").alias("doors")
    )
    out = out.withColumn("location", _location())
    return out.orderBy(F.col("volume").desc(), "location").limit(n)


def new_doors_by_chain(doors: DataFrame) -> DataFrame:
    """Q80: new and reactivated doors per chain."""
    return doors.filter(F.col("trend_30d").isin(NEW_TRENDS)).groupBy("chain_name").agg(
        F.countDistinct("vip_id").alias("new_doors"), F.sum("qty_last_30_days").alias("volume_30d")
    )


def lapsing_doors_by_chain(doors: DataFrame) -> DataFrame:
    """Q80: at-risk and churned doors per chain."""
    lapsing = doors.filter(F.col("customer_status").isin("At Risk", "Churned"))
    wide = lapsing.groupBy("chain_name").pivot("customer_status", ["At Risk", "Churned"]).agg(
        F.countDistinct("vip_id")
    )
    return wide.select(
        "chain_name",
        zero_if_null("At Risk").alias("at_risk"),
        zero_if_null("Churned").alias("churned"),
    )


def city_expansion(doors: DataFrame, n: int = 15) -> DataFrame:
    """Q81: cities with the largest 30-day gain."""
    out = doors.groupBy("city", "state").agg(
        F.countDistinct("vip_id").alias("doors"),
        _status("Active").alias("active"),
        F.count_if(F.col("trend_30d") == "Growing").alias("growing"),
        F.count_if(F.col("trend_30d").isin(NEW_TRENDS)).alias("new_doors"),
        F.sum("qty_last_30_days").alias("volume"),
        F.sum("qty_previous_30_days").alias("prev_volume"),
    )
    out = out.withColumns(
        {"vol_delta": F.col("volume") - F.col("prev_volume"), "location": _location()}
    )
    return out.orderBy(F.col("vol_delta").desc(), "location").limit(n)


def store_map(doors: DataFrame, period: str = "Last 30d") -> DataFrame:
    """Q82: geocoded doors with a log-scaled marker size of at least 5."""
    placed = doors.na.drop(subset=["google_latitude", "google_longitude"])
    volume = F.greatest(F.col(VOLUME_COLUMNS[period]), F.lit(1))
    size = F.greatest(F.log1p(volume) * 3, F.lit(5.0))
    return placed.select(
        "vip_id", "store_name", "city", "state", "customer_status",
        "google_latitude", "google_longitude", size.alias("size"),
    )


# -- SKU reports -------------------------------------------------------------------------

def sku_summary(skus: DataFrame) -> DataFrame:
    """Q76: reach, volume and growth per SKU. A door has one chain and one state."""
    sku = ["item_code", "item_name"]
    sums = {"case_equiv_ttm": "ttm_current", "case_equiv_prior": "ttm_prior", "raw_units": "total_units_all_time"}
    # Fold to doors, then to pairs of chain and state: the sets left are small.
    per_door = skus.groupBy(*sku, "chain_code", "store_state", "vip_id").agg(*[F.sum(s).alias(c) for c, s in sums.items()])
    per_place = per_door.groupBy(*sku, "chain_code", "store_state").agg(
        F.count("vip_id").alias("doors"), *[F.sum(c).alias(c) for c in sums]
    )
    out = per_place.groupBy(*sku).agg(
        F.sum("doors").alias("doors"),
        *[F.sum(c).alias(c) for c in sums],
        F.size(F.collect_set("chain_code")).cast("long").alias("chains"),
        F.size(F.collect_set("store_state")).cast("long").alias("states"),
    )
    return out.withColumn("growth_pct", growth_percent("case_equiv_ttm", "case_equiv_prior"))


def _leading_skus(skus: DataFrame, n: int) -> DataFrame:
    """Names of the ``n`` SKUs with the largest twelve-month volume."""
    totals = skus.groupBy("item_code", "item_name").agg(F.sum("ttm_current").alias("v"))
    best = totals.orderBy(F.col("v").desc(), "item_code").limit(n)
    return best.select("item_name").distinct()


def sku_state_cells(skus: DataFrame, n_skus: int = 10, n_states: int = 20) -> DataFrame:
    """Q77: volume of the top SKUs in the top states, empty cells 0.

    States rank by the total of those SKUs. Long form; a chart pivots it. The SKUs fold
    to their states once, for the leaders and their cells.
    """
    folded = skus.groupBy("item_code", "item_name", "store_state").agg(F.sum("ttm_current").alias("ttm_current"))
    folded = materialise(folded, "sku-states")
    leaders = _leading_skus(folded, n_skus)
    cells = members_of(folded, leaders, "item_name").groupBy("store_state", "item_name").agg(
        F.sum("ttm_current").alias("volume")
    )
    states = top_groups(cells.filter("store_state IS NOT NULL"), "store_state", F.sum("volume"), n_states)
    names = grand_total(leaders, F.sort_array(F.collect_list("item_name")))
    spine = states.select("store_state", F.explode(names).alias("item_name"))
    filled = spine.join(cells, ["store_state", "item_name"], "left")
    return filled.select("store_state", "item_name", zero_if_null("volume").alias("volume"))


def _by_month(one_row: DataFrame, months: Sequence[str], value: str) -> DataFrame:
    """Month columns of an aggregate as rows."""
    ids = [c for c in one_row.columns if c not in months]
    return one_row.unpivot(ids, list(months), "month", value)


def monthly_sku_trend(skus: DataFrame, months: Sequence[str], n: int = 5) -> DataFrame:
    """Q77: monthly volume of the top SKUs, which fold once for leaders and months."""
    folded = skus.groupBy("item_code", "item_name").agg(*[F.sum(c).alias(c) for c in ("ttm_current", *months)])
    folded = materialise(folded, "sku-months")
    sums = members_of(folded, _leading_skus(folded, n), "item_name").groupBy("item_name").agg(
        *[F.sum(m).alias(m) for m in months]
    )
    return _by_month(sums, months, "volume")


def sku_movement(skus: DataFrame, current: str, previous: str, n: int = 10) -> DataFrame:
    """Q78: SKUs that gained or lost most rows with sales between two months."""
    moved = skus.groupBy("item_code", "item_name").agg(
        F.count_if(F.col(current) > 0).alias("doors_current"),
        F.count_if(F.col(previous) > 0).alias("doors_previous"),
    )
    moved = moved.withColumn("door_delta", F.col("doors_current") - F.col("doors_previous"))
    delta = F.col("door_delta")
    gained = moved.filter(delta > 0).orderBy(delta.desc(), "item_code").limit(n)
    lost = moved.filter(delta < 0).orderBy(delta.desc(), "item_code").limit(n)
    label = lambda df, name: df.withColumn("direction", F.lit(name))
    return label(gained, "gained").unionByName(label(lost, "lost"))


def distribution_breadth(skus: DataFrame, months: Sequence[str]) -> DataFrame:
    """Q79: distinct SKUs and doors with sales, and volume, per month.

    Every row counts once for its SKU and once for its door, and both kinds fold side by
    side: to a bit per month with sales, which replaces two distinct counts per month
    column, and for SKUs to the volumes as well.
    """
    sold = sum((F.when(F.col(m) > 0, 1 << i).otherwise(0) for i, m in enumerate(months)), F.lit(0)).alias("sold")
    nothing = [F.lit(None).cast(skus.schema[m].dataType).alias(m) for m in months]
    kinds = F.array(
        F.struct(F.lit(True).alias("of_item"), F.col("item_code").cast("string").alias("code"), sold, *months),
        F.struct(F.lit(False).alias("of_item"), F.col("vip_id").cast("string").alias("code"), sold, *nothing),
    )
    folded = skus.select(F.inline(kinds)).groupBy("of_item", "code").agg(
        F.bit_or("sold").alias("sold"), *[F.sum(m).alias(m) for m in months]
    )
    known = lambda kind, i: kind & F.col("code").isNotNull() & (F.col("sold").bitwiseAND(1 << i) != 0)
    of_item = F.col("of_item")
    rows = [
        F.struct(
            F.lit(m).alias("month"),
            F.count_if(known(of_item, i)).alias("skus"),
            F.count_if(known(~of_item, i)).alias("doors"),
            F.sum(m).alias("volume"),
        )
        for i, m in enumerate(months)
    ]
    return folded.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
