"""Nearly equal names, phrases with bounded state, and the three forecast models."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.operators import forecasting as fc
from shelfline.operators import quality as dq
from shelfline.operators import trends as tr


def grams(key):
    padded = f" {key} "
    return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}


def brute_force(names, percent):
    keys = sorted(set(names))
    out = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = grams(a), grams(b)
            if len(x & y) * 100 >= percent * len(x | y):
                out.append((a, b, names.count(a), names.count(b)))
    return sorted(out)


@pytest.mark.parametrize("percent", [50, 80])
def test_near_names_equal_brute_force(spark, percent):
    r = random.Random(4)
    words = ["adams", "atlanta", "beverage", "eagle", "rock", "distributing", "inc", "llc", "co", "st", "x"]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(120)]
    names += [n.replace("e", "a", 1) for n in names[:40]] + [n + " s" for n in names[:40]]
    names += ["the same name"] * 100  # a third of all records
    rows = [(n.title().replace(" ", " - ") if i % 3 else n, i) for i, n in enumerate(names)] + [(None, 900), ("", 901), ("-!", 902)]
    got = dq.near_names(spark.createDataFrame(rows, "name string, code long"), "name", "code", percent)
    found = sorted((r["left_key"], r["right_key"], r["left_copies"], r["right_copies"]) for r in got.collect())
    assert found == brute_force(names, percent) and found


def test_names_are_never_paired_with_all(spark):
    names = spark.range(300).select(F.concat(F.lit("common words of a name "), F.sha1(F.col("id").cast("string"))).alias("name"), "id")
    plan = dq.near_names(names, "name", "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert dq.near_names(names, "name", "id").count() == 0


@pytest.mark.parametrize("buckets", [1, 7, 1 << 20])
def test_bounded_phrases_equal_exact_ones(spark, buckets):
    r = random.Random(buckets)
    vocabulary = [f"w{i}" for i in range(25)]
    start = datetime(2024, 1, 4)
    rows = []
    for i in range(400):
        day = start + timedelta(days=r.randrange(28))
        favourite = vocabulary[:5] if day > datetime(2024, 1, 17) else vocabulary[5:10]
        text = " ".join(r.choice(favourite if r.random() < 0.5 else vocabulary) for _ in range(r.randint(0, 25)))
        rows.append((f"u{i}", text or None, day))
    texts = spark.createDataFrame(rows, "url string, snippet string, harvested_at timestamp_ntz")
    known = spark.createDataFrame([("w0 w1",), (" W2 w3 ",)], "phrase string")
    as_of = date(2024, 1, 31)
    one = tr.emerging_phrases(texts, known, as_of, 14, 8).collect()
    two = tr.emerging_phrases_bounded(texts, known, as_of, 14, 8, buckets).collect()
    assert list(map(tuple, one)) == list(map(tuple, two)) and len(one) == 8
    assert tr.emerging_phrases_bounded(texts.limit(0), known, as_of, 14).collect() == []


def test_three_models(spark):
    r = np.random.default_rng(3)
    series = {"long": r.integers(0, 90, 13).tolist(), "six": [5, 9, 2, 40, 7, 1], "four": [3, 3, 3, 3], "three": [1, 2, 3], "falling": [90, 70, 50, 30, 20, 10, 5, 1]}
    monday = date(2001, 1, 1)
    rows = [(k, monday + timedelta(weeks=i), v) for k, values in series.items() for i, v in enumerate(values)] + [("six", monday + timedelta(weeks=50), None)]
    got = fc.three_model_forecast(spark.createDataFrame(rows, "name string, week date, v long"), "week", "v", ["name"], 3).collect()
    assert {r["name"] for r in got} == set(series) - {"three"}
    for row in got:
        v = np.array(series[row["name"]], float)
        slope, start = np.polyfit(np.arange(len(v)), v, 1)
        level = v[0]
        for x in v[1:]:
            level = level * 0.7 + x * 0.3
        drift = (v[-4:].mean() - v[-8:-4].mean()) / 4 if len(v) >= 8 else 0
        expected = [max(0, x) for x in (start + slope * (len(v) - 1 + row["step"]), level, v[-4:].mean() + drift * row["step"])]
        assert [row["lr"], row["es"], row["mat"]] == pytest.approx(expected, abs=1e-9)
        assert row["ensemble"] == pytest.approx(np.mean(expected), abs=1e-9)
        assert row["last_time"] == monday + timedelta(weeks=len(v) - 1)


def made_rows(df):
    """The most rows that one operator of the plan made, after running it."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        todo, most = [df._jdf.queryExecution().executedPlan()], 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    while todo:
        node = todo.pop()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_near_names_drops_unlike_pairs_inside_the_join(spark):
    r = random.Random(9)
    names = [f"https shop example com en {r.randint(1, 10**6)} page 2 ref x" for _ in range(400)]
    got = dq.near_names(spark.createDataFrame(list(enumerate(names)), "id long, name string"), "name", "id")
    assert made_rows(got) < 20_000  # 400 names of some 45 grams; pairs of names are 79,800
    found = {(x["left_key"], x["right_key"]) for x in got.collect()}
    assert found == {(a, b) for a, b, *_ in brute_force(names, 80)} and found
