"""Trend and data-quality queries Q95-Q105."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.functions.dates import days_before
from shelfline.operators import accounts as acc
from shelfline.operators import quality as dq
from shelfline.operators import trends as tr
from shelfline.plans.accounts import SHEET_CTES, _kpi_sql, scorecard_kpis
from shelfline.plans.inputs import AS_OF, items, sold_lines
from shelfline.plans.inputs import EVENTS_AS_OF as TODAY
from shelfline.plans.registry import query
from shelfline.sources import clustered, files, roles
from shelfline.sources.storage import scratch_path

FLAVORS, BRANDS = ["flavor", "ingredient"], ["brand"]
EVERYTHING = ["brand", "ingredient", "flavor", "category"]


def _listed(types) -> str:
    return "(" + ", ".join(f"'{x}'" for x in types) + ")"


WINDOW = "CAST(harvested_at AS DATE) > DATE '2024-01-31' - 28 AND CAST(harvested_at AS DATE) <= DATE '2024-01-31'"
GROWTH = f"""SELECT *, CASE WHEN prior_avg_7d > 0 THEN recent_7d / prior_avg_7d - 1 ELSE recent_7d END AS growth_rate
FROM (SELECT entity_name, entity_type, CAST(sum(m) AS BIGINT) AS total_mentions,
  CAST(coalesce(sum(m) FILTER (WHERE day > DATE '2024-01-31' - 7), 0) AS BIGINT) AS recent_7d, avg(p) AS avg_platforms,
  coalesce(sum(m) FILTER (WHERE day <= DATE '2024-01-31' - 7), 0) / CAST(3 AS DOUBLE) AS prior_avg_7d
FROM (SELECT entity_name, entity_type, CAST(harvested_at AS DATE) AS day, count(*) AS m, count(DISTINCT source_engine) AS p
  FROM mention WHERE {WINDOW} GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _trending_sql(types) -> str:
    return f"""SELECT * FROM ({GROWTH}) WHERE entity_type IN {_listed(types)}
ORDER BY growth_rate DESC, entity_name, entity_type LIMIT 10"""


GROWTH_ROUNDED = ["avg_platforms", "prior_avg_7d", "growth_rate"]


def _mentions(t):
    return roles.mention(t)


@query("Q95_trending_flavors", _trending_sql(FLAVORS), rounded=GROWTH_ROUNDED)
def _(t):
    return tr.trending(_mentions(t), TODAY, FLAVORS)


@query("Q95_trending_brands", _trending_sql(BRANDS), rounded=GROWTH_ROUNDED)
def _(t):
    return tr.trending(_mentions(t), TODAY, BRANDS)


VIRAL = f"""SELECT *, coalesce(recent_avg / nullif(baseline, 0), recent_total) AS spike_ratio
FROM (SELECT entity_name, entity_type, count(*) FILTER (WHERE now) / CAST(2 AS DOUBLE) AS recent_avg,
  count(*) FILTER (WHERE NOT now) / CAST(26 AS DOUBLE) AS baseline,
  count(DISTINCT source_engine) FILTER (WHERE now) AS recent_platforms, count(*) FILTER (WHERE now) AS recent_total
FROM (SELECT *, CAST(harvested_at AS DATE) > DATE '2024-01-31' - 2 AS now FROM mention WHERE {WINDOW}) GROUP BY 1, 2)
ORDER BY spike_ratio DESC, entity_name, entity_type LIMIT 10"""


@query("Q96_viral", VIRAL, rounded=["recent_avg", "baseline", "spike_ratio"])
def _(t):
    return tr.viral(_mentions(t), TODAY, EVERYTHING)


@query(
    "Q97_declining",
    f"""SELECT * EXCLUDE (avg_platforms) FROM ({GROWTH}) ORDER BY growth_rate, entity_name, entity_type LIMIT 10""",
    rounded=["prior_avg_7d", "growth_rate"],
)
def _(t):
    return tr.declining(_mentions(t), TODAY, EVERYTHING)


@query(
    "Q98_staying_power",
    f"""WITH m AS (SELECT *, CAST(harvested_at AS DATE) AS day FROM mention WHERE {WINDOW}),
d AS (SELECT entity_name, entity_type, count(*) AS days_observed, CAST(sum(c) AS BIGINT) AS total_mentions,
    stddev_pop(c) / avg(c) AS cv
  FROM (SELECT entity_name, entity_type, day, count(*) AS c FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
e AS (SELECT entity_name, entity_type, count(*) AS platforms, sum(c * c) / (sum(c) * sum(c)) AS conc
  FROM (SELECT entity_name, entity_type, source_engine, count(*) AS c FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT d.entity_name, d.entity_type, days_observed, total_mentions,
    platforms / (SELECT max(platforms) FROM e) AS cross_platform_score, 1 - least(1, cv) AS stability_score,
    1 - conc AS diversity_score
  FROM d JOIN e ON d.entity_name = e.entity_name AND d.entity_type = e.entity_type)
SELECT *, 100 * (cross_platform_score + stability_score + diversity_score) / 3 AS staying_power_score,
  cross_platform_score >= 0.5 AS is_cross_platform, stability_score >= 0.5 AS is_stable, diversity_score >= 0.5 AS is_broad
FROM s ORDER BY staying_power_score DESC, total_mentions DESC, entity_name, entity_type LIMIT 10""",
    rounded=["cross_platform_score", "stability_score", "diversity_score", "staying_power_score"],
)
def _(t):
    return tr.staying_power(_mentions(t), TODAY)


DICTIONARY = r"""SELECT array_to_string(l[i:i + k - 1], ' ') FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM benchmark)), (SELECT unnest([2, 3]) AS k) WHERE i + k - 1 <= len(l)"""


PHRASES = rf"""WITH w AS (SELECT CAST(harvested_at AS DATE) > DATE '2024-01-31' - 14 AS recent,
    list_filter(string_split_regex(lower(snippet), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS l FROM text_mention
    WHERE {WINDOW}),
g AS (SELECT recent, array_to_string(l[i:i + k - 1], ' ') AS ngram
  FROM (SELECT recent, l, unnest(range(1, len(l) + 1)) AS i FROM w), (SELECT unnest([2, 3]) AS k) WHERE i + k - 1 <= len(l)),
c AS (SELECT ngram, count(*) FILTER (WHERE recent) AS f_recent, count(*) FILTER (WHERE NOT recent) AS f_prior FROM g GROUP BY 1)
SELECT *, (f_recent + 1) / (f_prior + 1) AS growth_ratio FROM c WHERE f_recent >= 5
  AND ngram NOT IN ({DICTIONARY})
ORDER BY growth_ratio DESC, ngram LIMIT 10"""


@query(
    "Q99_emerging_phrases",
    PHRASES,
    rounded=["growth_ratio"],
)
def _(t):
    # The dictionary is an input of its own: every phrase of the benchmark texts.
    known = tr.phrase_rows(t.benchmark, "text").select(F.col("ngram").alias("phrase"))
    return tr.emerging_phrases(roles.text_mention(t), known, TODAY, days=14)


@query("Q99_bounded_state", PHRASES, rounded=["growth_ratio"])
def _(t):
    known = tr.phrase_rows(t.benchmark, "text").select(F.col("ngram").alias("phrase"))
    return tr.emerging_phrases_bounded(roles.text_mention(t), known, TODAY, days=14)


@query(
    "Q100_headline_mover",
    f"""SELECT entity_name, entity_type, growth_rate * 100 AS growth_pct, recent_7d AS mentions,
  CAST(round_even(avg_platforms, 0) AS INTEGER) AS platforms, abs(growth_rate * 100 - recent_7d * 100) < 1 AS is_bootstrap
FROM ({GROWTH}) ORDER BY growth_rate DESC, entity_name, entity_type LIMIT 1""",
    rounded=["growth_pct"],
    digits=4,
)
def _(t):
    return tr.headline_mover(_mentions(t), TODAY)


@query(
    "Q101_sources_for_entity",
    """SELECT upper(source_engine[1]) || source_engine[2:] AS engine_label, url, title, left(snippet, 240) AS snippet, harvested_at
FROM text_mention WHERE entity_name = 'en' AND CAST(harvested_at AS DATE) >= DATE '2024-01-31' - 14
ORDER BY harvested_at DESC, url LIMIT 5""",
)
def _(t):
    return tr.sources_for(roles.text_mention(t), "en", TODAY)


#: Files of the clustered layout in the queries; a load job takes one per few hundred MB.
CLUSTERED_FILES = 8


def _clustered(t, rows, name):
    """The layout, written once as a load job would."""
    return clustered.write_clustered(rows, scratch_path(t.spark, name), CLUSTERED_FILES)


@query("Q95_trending_flavors_on_clustered", _trending_sql(FLAVORS), rounded=GROWTH_ROUNDED)
def _(t):
    return tr.trending(_clustered(t, _mentions(t), "clustered-mentions"), TODAY, FLAVORS)


@query(
    "Q101_sources_on_clustered",
    """SELECT upper(source_engine[1]) || source_engine[2:] AS engine_label, url, title, left(snippet, 240) AS snippet, harvested_at
FROM text_mention WHERE entity_name = 'en' AND CAST(harvested_at AS DATE) >= DATE '2024-01-31' - 14
ORDER BY harvested_at DESC, url LIMIT 5""",
)
def _(t):
    return tr.sources_for(_clustered(t, roles.text_mention(t), "clustered-texts"), "en", TODAY)


@query(
    "Q101_mentions_at_addresses",
    """SELECT entity_name, entity_type, source_engine, url, harvested_at FROM mention
WHERE url IN ('https://example.org/m/7', 'https://example.org/m/400', 'https://example.org/m/none')""",
)
def _(t):
    wanted = ["https://example.org/m/7", "https://example.org/m/400", "https://example.org/m/none"]
    return clustered.mentions_at(_clustered(t, _mentions(t), "clustered-mentions"), wanted).drop(clustered.DAY)


@query(
    "Q102_growth_display",
    f"""SELECT *, CASE WHEN abs(growth_rate - recent_7d) < 0.5 THEN 'mentions' ELSE 'percent' END AS display_kind,
  CASE WHEN abs(growth_rate - recent_7d) < 0.5 THEN recent_7d ELSE growth_rate * 100 END AS display_value
FROM ({_trending_sql(FLAVORS)})""",
    rounded=[*GROWTH_ROUNDED, "display_value"],
    digits=4,
)
def _(t):
    return tr.growth_display(tr.trending(_mentions(t), TODAY, FLAVORS))


@query(
    "Q102_spike_display",
    f"""SELECT *, CASE WHEN baseline = 0 THEN 'mentions' ELSE 'multiple' END AS display_kind,
  CASE WHEN baseline = 0 THEN recent_total ELSE spike_ratio END AS display_value FROM ({VIRAL})""",
    rounded=["recent_avg", "baseline", "spike_ratio", "display_value"],
)
def _(t):
    return tr.spike_display(tr.viral(_mentions(t), TODAY, EVERYTHING))


@query(
    "S09_last_refresh",
    """SELECT max(harvested_at) AS last_refresh FROM mention
WHERE CAST(harvested_at AS DATE) >= DATE '2024-01-31' - 3""",
)
def _(t):
    return tr.last_refresh(_mentions(t), TODAY)


@query(
    "U03_first_of_each",
    f"""SELECT * EXCLUDE (src, rn) FROM (SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY src) AS rn FROM (
  SELECT *, 0 AS src FROM ({_trending_sql(FLAVORS)}) UNION ALL SELECT *, 1 FROM ({_trending_sql(EVERYTHING)}))) WHERE rn = 1""",
    rounded=GROWTH_ROUNDED,
)
def _(t):
    some = tr.trending(_mentions(t), TODAY, FLAVORS)
    rest = tr.trending(_mentions(t), TODAY, EVERYTHING)
    return tr.first_of_each([some, rest], "entity_name")


# -- data quality ------------------------------------------------------------------------

DOOR_KPIS = "SELECT vip_id AS name, qty_last_90_days AS current, qty_previous_90_days AS prior, 'doors' AS source, customer_status = 'Churned' AS allow_missing_prior FROM sheet"


def _door_kpis(t):
    lines = sold_lines(t, days_before(AS_OF, acc.AT_RISK_DAYS))
    kpis = acc.recent_door_kpis(roles.door(t), lines, items(t), AS_OF)
    return kpis.select(
        F.col("vip_id").alias("name"),
        "current",
        "prior",
        F.lit("doors").alias("source"),
        F.col("churned").alias("allow_missing_prior"),
    )


@query(
    "Q103_symmetry_breaks",
    f"WITH {SHEET_CTES} SELECT * FROM ({DOOR_KPIS}) WHERE NOT allow_missing_prior AND current <> 0 AND prior = 0",
)
def _(t):
    return dq.symmetry_breaks(_door_kpis(t))


def _trend_check(t, name, types):
    grown = tr.trending(_mentions(t), TODAY, types)
    return grown.agg(
        F.sum("recent_7d").cast("double").alias("current"), F.sum("prior_avg_7d").alias("prior")
    ).withColumn("name", F.lit(name))


@query(
    "Q103_scorecard_checks",
    f"""SELECT name, current, prior, coalesce(current <> 0, FALSE) AND NOT coalesce(prior <> 0, FALSE) AS is_broken FROM (
  SELECT kpi AS name, current, prior FROM ({_kpi_sql(None)})
  UNION ALL SELECT 'trending flavors', sum(recent_7d), sum(prior_avg_7d) FROM ({_trending_sql(FLAVORS)})
  UNION ALL SELECT 'trending brands', sum(recent_7d), sum(prior_avg_7d) FROM ({_trending_sql(BRANDS)}))""",
    rounded=["current", "prior"],
)
def _(t):
    kpis = scorecard_kpis(t).select(F.col("kpi").alias("name"), "current", "prior")
    both = kpis.unionByName(_trend_check(t, "trending flavors", FLAVORS))
    both = both.unionByName(_trend_check(t, "trending brands", BRANDS))
    guarded = both.withColumns({"source": F.lit("tables"), "allow_missing_prior": F.lit(False)})
    return dq.check_symmetry(guarded).select("name", "current", "prior", "is_broken")


@query(
    "Q103_all_checks_pass",
    f"""WITH {SHEET_CTES} SELECT count(*) AS checks,
  count(*) FILTER (WHERE NOT allow_missing_prior AND current <> 0 AND prior = 0) AS broken,
  count(*) FILTER (WHERE NOT allow_missing_prior AND current <> 0 AND prior = 0) = 0 AS passed FROM ({DOOR_KPIS})""",
)
def _(t):
    return dq.all_checks_pass(_door_kpis(t))


@query(
    "Q103_published_with_guard",
    f"""WITH {SHEET_CTES}, k AS ({DOOR_KPIS}), g AS (SELECT count(*) AS checks, count(*) FILTER (WHERE bad) AS broken,
  min(name) FILTER (WHERE bad) AS first_broken FROM (SELECT *, NOT allow_missing_prior AND current <> 0 AND prior = 0 AS bad FROM k))
SELECT name, current, prior, checks, broken, first_broken, broken = 0 AS passed FROM k, g""",
)
def _(t):
    published, report = dq.publish_guarded(_door_kpis(t))
    counts = {c: F.lit(report[c]).cast("long") for c in ("checks", "broken")}
    found = {"first_broken": F.lit(report["first_broken"]).cast("string"), "passed": F.lit(report["passed"])}
    return published.select("name", "current", "prior").withColumns(counts | found)


def _code_accounts(t):
    states = roles.distributor_state(t).withColumnRenamed("distributor_id", "code")
    names = roles.distributor(t).selectExpr("distributor_code AS code", "distributor_name AS account_name")
    sold = roles.sell_through_raw(t, with_account=False).select(F.col("dist_code").alias("code")).distinct()
    return sold.join(names, "code", "left").join(states, "code", "left")


def _code_mapping(t):
    known = roles.distributor(t).filter("NOT is_parent_rollup")
    return known.select(
        F.col("distributor_code").alias("code"),
        F.when(F.col("total_retailers") > 5000, F.col("sf_account_id")).alias("account_id"),
        F.when(F.col("total_retailers") > 3000, F.col("parent_sf_account_id")).alias("parent_account_id"),
    )


CODES = """SELECT s.code, distributor_name AS account_name, state,
  NOT is_parent_rollup AND total_retailers > 3000 AS matched
FROM (SELECT DISTINCT dist_code AS code FROM sell_through_raw) s
  LEFT JOIN distributor ON code = distributor_code LEFT JOIN distributor_state ON code = distributor_id"""


@query(
    "Q104_match_rate",
    f"""SELECT state, count(*) AS accounts, count(*) FILTER (WHERE matched) AS matched,
  100 * count(*) FILTER (WHERE matched) / CAST(count(*) AS DOUBLE) AS match_rate_pct FROM ({CODES}) GROUP BY state""",
    rounded=["match_rate_pct"],
)
def _(t):
    return dq.match_rate(_code_accounts(t), _code_mapping(t), "state")


@query(
    "Q104_unmatched_accounts",
    f"""SELECT account_name, code, 'Which account receives orders for this code?' AS question FROM ({CODES}) WHERE NOT matched""",
)
def _(t):
    return dq.unmatched_accounts(_code_accounts(t), _code_mapping(t))


@query(
    "Q105_duplicate_groups",
    r"""SELECT trim(regexp_replace(lower("desc"), '[^\p{L}\p{N}]+', ' ', 'g')) AS name_key, count(*) AS copies,
  count(DISTINCT supplier_item) AS codes, min(supplier_item) AS first_code, max(supplier_item) AS last_code
FROM item GROUP BY 1 HAVING count(*) > 1""",
)
def _(t):
    return dq.duplicate_groups(roles.item(t), "desc", "supplier_item")


NAMES = r"""SELECT key, count(*) AS copies, min(code) AS first_code FROM (
  SELECT trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, page_id AS code FROM pages) WHERE key <> '' GROUP BY 1"""


@query(
    "Q105_near_names",
    f"""WITH n AS ({NAMES}),
g AS (SELECT DISTINCT key, substr(p, i, 3) AS gram FROM (
  SELECT key, p, unnest(range(1, greatest(length(p) - 2, 1) + 1)) AS i FROM (SELECT key, ' ' || key || ' ' AS p FROM n))),
size AS (SELECT key, count(*) AS m FROM g GROUP BY 1),
pairs AS (SELECT a.key AS left_key, b.key AS right_key, count(*) AS o FROM g a JOIN g b USING (gram) WHERE a.key < b.key GROUP BY 1, 2)
SELECT left_key, right_key, l.copies AS left_copies, r.copies AS right_copies, l.first_code AS left_first_code,
  r.first_code AS right_first_code, round(o * 100 / (x.m + y.m - o), 2) AS similarity_pct
FROM pairs JOIN size x ON x.key = left_key JOIN size y ON y.key = right_key
  JOIN n l ON l.key = left_key JOIN n r ON r.key = right_key
WHERE o * 100 >= 80 * (x.m + y.m - o)""",
)
def _(t):
    return dq.near_names(t.pages, "url", "page_id")
