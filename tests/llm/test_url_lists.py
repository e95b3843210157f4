import datetime as dt

import pytest
from pyspark.sql import functions as F
from shelfline.llm import url_lists as u

D = lambda n: dt.date(2024, 1, n)
T = lambda n, h=12: dt.datetime(2024, 1, n, h)
ENTRY = "at date, seq long, kind string, key string, category string, action string"
CAPTURE = "page_id long, url string, fetched timestamp, rules int"


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        (D(2), 1, "host", "a.example.com", "ads", "add"), (D(5), 2, "host", "a.example.com", "ads", "remove"), (D(9), 3, "host", "a.example.com", "ads", "add"),
        (D(9), 4, "host", "a.example.com", "ads", "add"), (D(3), 5, "domain", "example.com", "adult", "add"), (D(3), 6, "domain", "example.com", "adult", "remove"),
        (D(4), 7, "domain", "example.org", "bad", "add"), (D(1), 8, "prefix", "b.example.net/x", "spam", "add"), (None, 9, "host", "c.example.com", "ads", "add"),
        (D(1), 10, None, "c.example.com", "ads", "add"), (D(1), 11, "host", None, "ads", "add"), (D(6), 12, "host", "a.example.com", "ads", "remove"),
    ]
    return spark.createDataFrame(rows, ENTRY)


@pytest.mark.parametrize(
    ("url", "at", "rules"),
    [
        ("http://a.example.com/", T(1), []), ("http://A.Example.com:80/q", T(2, 0), ["host:a.example.com:ads"]), ("http://a.example.com/", T(4, 23), ["host:a.example.com:ads"]),
        ("http://a.example.com/", T(5, 0), []), ("http://a.example.com/", T(8), []), ("https://u:p@a.example.com?x", T(20), ["host:a.example.com:ads"]),
        ("http://x.y.example.org/z", T(4), ["domain:example.org:bad"]), ("http://notexample.org/z", T(9), []), ("http://b.example.net/x/y?q#f", T(2), ["prefix:b.example.net/x:spam"]),
        ("http://b.example.net/xy", T(2), []), ("http://b.example.net//x", T(2), ["prefix:b.example.net/x:spam"]), (None, T(4), []), ("", T(4), []), ("no url", T(4), []), ("http://a.example.com/", None, []),
        ("http://c.example.com/" + "s/" * 300, T(4), []),
    ],
)
def test_as_of(spark, entries, url, at, rules):
    frame = spark.createDataFrame([(1, url, at, 0), (1, url, at, 0), (None, url, at, 0)], CAPTURE)
    got = u.evaluate(frame, entries).collect()
    assert [list(r["rules"]) for r in got] == [rules] * 3
    assert all(r["blocked"] == bool(rules) and r["n_active"] == len(rules) for r in got)


def test_entries_hold_from_their_time_of_day(spark):
    rows = [(T(2, 18), 1, "host", "a.example.com", "ads", "add"), (T(4, 6), 2, "host", "a.example.com", "ads", "remove")]
    entries = spark.createDataFrame(rows, ENTRY.replace("at date", "at timestamp"))
    times = [T(2, 9), T(2, 18), T(3, 0), T(4, 5), T(4, 6), T(4, 20)]
    frame = spark.createDataFrame([(i, "http://a.example.com/", at, 0) for i, at in enumerate(times)], CAPTURE)
    assert {r["page_id"]: r["blocked"] for r in u.evaluate(frame, entries).collect()} == dict(enumerate([False, True, True, True, False, False]))


def test_times_without_a_zone_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            frame = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.25' AS ts")
            assert frame.select(F.unix_micros(u._utc(F.col("ts")))).first()[0] == 1_704_164_645_250_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_allowed_and_empty(spark, entries):
    frame = spark.createDataFrame([(1, "http://a.example.com/", T(3), 0), (1, "http://a.example.com/", T(6), 0), (2, None, T(3), 0)], CAPTURE)
    left = u.allowed(frame, entries)
    assert left.columns == frame.columns
    assert sorted((r["page_id"], r["fetched"]) for r in left.collect()) == [(1, T(6)), (2, T(3))]
    assert u.allowed(frame, entries.limit(0)).count() == 3
    assert u.evaluate(frame.limit(0), entries).count() == 0


def test_a_hot_host_does_not_multiply(spark):
    flips = [(D(1 + n // 2), n, "host", "hot.example.com", "ads", "add" if n % 4 < 2 else "remove") for n in range(56)]
    listed = spark.createDataFrame(flips, ENTRY)
    frame = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("http://hot.example.com/p").alias("url"), F.lit(T(3)).alias("fetched"))
    assert u.evaluate(frame, listed).agg(F.count("*"), F.sum("n_active")).first() == (2000, 2000)
    assert u.validity(listed).count() == 1
