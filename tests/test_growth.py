"""What must not grow faster than the input: exchanges, buckets, and the phrases of a task."""

import re
from datetime import date, datetime

import pytest
from shelfline.operators import trends as tr
from shelfline.plans.all import QUERIES
from shelfline.sources import layout

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcasts(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["Q76_sku_summary", "Q77_monthly_sku_trend", "Q79_distribution_breadth"])
def test_lines_move_no_more_often_than_needed(spark, no_broadcasts, name, monkeypatch):
    from shelfline.operators import accounts

    plans = []
    whole = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def written(df, name):
        plans.append(whole(df))
        return df

    monkeypatch.setattr(accounts, "materialise", written, raising=False)
    plan = whole(QUERIES[name].run(spark, SMALL))
    lines = [p for p in plans or [plan]]
    assert len(lines) == 1
    # Of the lines: by order, by outlet (one exchange for choice, fold and attributes), by item. The rest are small tables.
    made = [e for e in re.findall(r"Exchange hashpartitioning\((\w+)", lines[0])]
    assert len(made) <= 12, made  # 14, 19 and 26 with a move for every join and fold
    assert lines[0].count("lineitem.parquet") == 1


def test_buckets_follow_the_files(spark, tables, monkeypatch):
    seen, write = [], layout.write_bucketed
    monkeypatch.setattr(layout, "BUCKET_BYTES", 10_000, raising=False)
    monkeypatch.setattr(layout, "write_bucketed", lambda t, n: seen.append(n) or write(t, n))
    assert QUERIES["Q02_on_buckets"].run(spark, SMALL).count() > 0
    assert seen[0] > 8 and layout.buckets_for(tables, 99) == 99


def test_phrases_of_a_task_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(tr, "TEXT_BYTES", 100, raising=False)
    at = {True: datetime(2024, 1, 30), False: datetime(2024, 1, 10)}
    texts = [(f"u{i % 50}" if i % 7 else None, f"one new thing number {i % 3}" if i % 4 else None, at[i % 5 > 0]) for i in range(200)]
    known = spark.createDataFrame([("one new",)], "phrase string")
    rows = spark.createDataFrame(texts, "url string, snippet string, harvested_at timestamp")
    found = tr.emerging_phrases(rows, known, date(2024, 1, 31), days=14, n=100)
    dealt = re.findall(r"hashpartitioning\(ngram#\d+, (\d+)", found._jdf.queryExecution().executedPlan().toString())
    size = sum(len(s) for _, s, _ in texts if s)
    assert max(map(int, dealt)) >= size // 100
    counts = {}
    for _, text, day in texts:
        words = (text or "").split()
        for k in (2, 3):
            for i in range(len(words) - k + 1):
                counts.setdefault(" ".join(words[i : i + k]), [0, 0])[day == at[False]] += 1
    expected = {(p, a, b) for p, (a, b) in counts.items() if a >= 5 and p != "one new"}
    assert {(r["ngram"], r["f_recent"], r["f_prior"]) for r in found.collect()} == expected


def test_no_texts_have_no_phrases(spark):
    rows = spark.createDataFrame([], "url string, snippet string, harvested_at timestamp")
    assert tr.emerging_phrases(rows, spark.createDataFrame([], "phrase string"), date(2024, 1, 31)).count() == 0


def test_texts_are_not_read_a_third_time_for_buckets_already_counted(spark, monkeypatch):
    at = {True: datetime(2024, 1, 30), False: datetime(2024, 1, 10)}
    often = [(f"u{i}", f"top{i % 4} word " * 20, at[True]) for i in range(40)]
    seldom = [(f"v{i}", f"some other{i % 50} words x{i % 9}", at[i % 3 > 0]) for i in range(300)]
    stale = [(f"w{i}", "one two three four five six " * 30, at[i % 2 == 0]) for i in range(40)]
    rows = spark.createDataFrame(often + seldom + stale, "url string, snippet string, harvested_at timestamp")
    known = spark.createDataFrame([("word top1",)], "phrase string")
    as_of = date(2024, 1, 31)
    expected = list(map(tuple, tr.emerging_phrases(rows, known, as_of, 14, 5).collect()))
    cuts = {}
    for fullest, share in ((64, 1.0), (1, 0.0)):
        monkeypatch.setattr(tr, "FULLEST", fullest)
        monkeypatch.setattr(tr, "BAR_SHARE", share, raising=False)
        found = tr.emerging_phrases_bounded(rows, known, as_of, 14, 5)
        cuts[fullest] = "split(" in found._jdf.queryExecution().optimizedPlan().toString()
        assert list(map(tuple, found.collect())) == expected
    assert cuts == {64: False, 1: True}
