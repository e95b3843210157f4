"""URL filters from dated lists, DataFrame functions only.

List entries carry a date or a time, an action (add or remove), a kind and a key. Their history
becomes validity intervals ``[from, to)`` per kind, key and category. A capture is
looked up under every key its URL answers to (its host, the domains above it, the path
prefixes of its host) and is judged by the entries that were active when it was
fetched, not by the latest list.

Entries of a moment are folded to the last action first, then those of a day to its
changes, so a key has at most one row per day before its window, and one row with its
intervals after it. Captures join that one
row by equality: a host with a third of all captures never multiplies rows, and its
side can be split.

Defined results: a null or unparsable URL has no host and no active entry; a capture
without a fetch time likewise has none; entries without date, kind or key are ignored;
of several actions at the same instant the one with the largest number counts;
repeated captures get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
KINDS = ("host", "domain", "prefix")


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def keys_of(url: Column) -> Column:
    """(kind, key) pairs that may list a URL; none without a host."""
    host = host_of(url)
    labels = F.split(host, r"\.", -1)
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda s: s != "")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")),
    )
    prefixes = F.transform(
        steps,
        lambda s, i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")).alias("key")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")))
    return F.when(host.isNotNull(), F.concat(own, domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """A row per ``kind`` and ``key`` with ``active``: its intervals (``category``,
    ``from``, ``to``; ``to`` null while listed). ``entries``: ``at`` (a timestamp; a
    date is its first moment), ``seq`` (order within the list), ``kind``, ``key``,
    ``category``, ``action``."""
    dated = entries.withColumn("at", F.col("at").cast("timestamp"))
    known = dated.where("at IS NOT NULL AND kind IS NOT NULL AND key IS NOT NULL")
    states = known.groupBy("kind", "key", "category", "at").agg(F.max_by("action", "seq").alias("action"))
    # The changes of a day first, then days against each other: a key that much of the
    # list is about is dealt out by its days, and a window has a row per day of it.
    per_day = states.groupBy("kind", "key", "category", F.to_date("at").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("at", "action"))).alias("all")
    )
    changed = F.filter("all", lambda x, i: (i == 0) | (x["action"] != F.get("all", i - 1)["action"]))
    over = "OVER (PARTITION BY kind, key, category ORDER BY day)"
    before = F.expr(f"coalesce(lag(element_at(all, -1).action) {over}, 'remove')")
    days = per_day.withColumn("changes", changed).withColumn("before", before)
    same = F.col("changes")[0]["action"] == F.col("before")
    days = days.withColumn("changes", F.when(same, F.expr("slice(changes, 2, size(changes))")).otherwise(F.col("changes")))
    days = days.where("size(changes) > 0").withColumn("next", F.expr(f"lead(changes[0].at) {over}"))
    spans = F.transform(
        "changes",
        lambda x, i: F.struct("category", x["at"].alias("from"), F.coalesce(F.get("changes", i + 1)["at"], F.col("next")).alias("to"), x["action"].alias("action")),
    )
    listed = days.select("kind", "key", F.explode(F.filter(spans, lambda x: x["action"] == "add")).alias("span"))
    return listed.groupBy("kind", "key").agg(F.sort_array(F.collect_list(F.struct("span.category", "span.from", "span.to"))).alias("active"))


def _capture_key(identity: str, url: str, fetched: str) -> list[Column]:
    return [F.col(identity).alias("__id"), F.col(url).alias("__url"), F.col(fetched).alias("__at")]


def _same_capture(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & left["__url"].eqNullSafe(right["__url"]) & left["__at"].eqNullSafe(right["__at"])


def active_rules(captures: DataFrame, entries: DataFrame, identity: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Captures that were listed when fetched, with their ``rules`` (kind:key:category, sorted)."""
    spread = captures.select(*_capture_key(identity, url, fetched)).select("*", F.inline(keys_of(F.col("__url"))))
    at = F.col("__at").cast("timestamp")
    now = F.filter("active", lambda a: (a["from"] <= at) & (a["to"].isNull() | (at < a["to"])))
    return (
        spread.join(validity(entries), ["kind", "key"])
        .select("__id", "__url", "__at", "kind", "key", F.explode(now).alias("entry"))
        .select("__id", "__url", "__at", F.concat_ws(":", "kind", "key", "entry.category").alias("rule"))
        .groupBy("__id", "__url", "__at")
        .agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    )


def evaluate(captures: DataFrame, entries: DataFrame, identity: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row per capture row: id, ``fetched``, ``host``, ``rules``, ``n_active`` and ``blocked``."""
    hits = active_rules(captures, entries, identity, url, fetched)
    rows = captures.select(*_capture_key(identity, url, fetched))
    none = F.array().cast("array<string>")
    joined = rows.join(hits, _same_capture(rows, hits), "left").select(rows["__id"], rows["__url"], rows["__at"], F.coalesce("rules", none).alias("rules"))
    return joined.select(
        F.col("__id").alias(identity),
        F.col("__at").alias(fetched),
        host_of(F.col("__url")).alias("host"),
        "rules",
        F.size("rules").cast("long").alias("n_active"),
        (F.size("rules") > 0).alias("blocked"),
    )


def allowed(captures: DataFrame, entries: DataFrame, identity: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` without those that an entry blocked when they were fetched."""
    hits = active_rules(captures, entries, identity, url, fetched).select("__id", "__url", "__at")
    keyed = captures.select("*", *_capture_key(identity, url, fetched))
    return keyed.join(hits, _same_capture(keyed, hits), "left_anti").select(*captures.columns)


# ---- the inputs of the registered query, derived from the given tables ----


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time spread over the month that the events cover."""
    second = F.pmod(F.col("page_id") * 7919, F.lit(30 * 86_400))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + second).alias("fetched"))


def _utc(ts: Column) -> Column:
    """A timestamp without a zone as the moment it names in UTC, whatever the session's zone."""
    day = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400
    return F.timestamp_seconds(day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts))


def entries_of(events: DataFrame, pages: DataFrame) -> DataFrame:
    """A dated list: each event names a page; its type decides what of the page's URL
    is listed, an ``error`` takes the host off the list."""
    n = pages.agg(F.max("page_id").alias("last")).first()["last"]
    n = 1 if n is None else n + 1
    chosen = events.select(
        _utc(F.col("ts")).alias("at"), F.col("event_id").alias("seq"), F.pmod(F.col("event_id"), F.lit(n)).alias("page_id"), "event_type",
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(3)).cast("string")).alias("category"),
    )
    labels = F.split(host_of(F.col("url")), r"\.", -1)
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.size(labels)), ".")
    prefix = F.concat(host_of(F.col("url")), F.lit("/"), F.get(F.split(F.regexp_extract("url", PATH, 1), "/", -1), F.lit(1)))
    kind = F.when(F.col("event_type") == "signup", "domain").when(F.col("event_type") == "purchase", "prefix").otherwise("host")
    key = F.when(kind == "domain", domain).when(kind == "prefix", prefix).otherwise(host_of(F.col("url")))
    action = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    return chosen.join(pages.select("page_id", "url"), "page_id").select("at", "seq", kind.alias("kind"), key.alias("key"), "category", action.alias("action"))
