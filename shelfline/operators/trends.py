"""Trends over harvested mentions: growth, spikes, staying power, new phrases.

Windows end at ``as_of`` and exclude day ``as_of - n`` itself. Mentions fold to
entity x engine x day before anything else, so distinct engines are row counts and
an entity with a third of all mentions costs no more than its days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import in_list, ratio, zero_if_null
from shelfline.functions.dates import days_before
from shelfline.functions.joins import grand_total
from shelfline.sources.storage import materialise

# Fixed values.
WINDOW_DAYS = 28
RECENT_DAYS = 7
VIRAL_DAYS = 2
SIGNAL_FROM = 0.5
MIN_PHRASE_COUNT = 5
SNIPPET_LENGTH = 240
ENTITY = ["entity_name", "entity_type"]
#: Counters of the bounded phrase count, the fullest of them per row of the answer that set its bar at
#: least, and the part of all recent phrases that those which set it may hold besides.
PHRASE_BUCKETS, FULLEST, BAR_SHARE = 1 << 20, 64, 0.125
#: Bytes of texts whose phrases one task counts: each word begins two phrases, so the
#: counts of a task take some tens of times that.
TEXT_BYTES = 8 << 20


def _day(mentions: DataFrame) -> Column:
    """Day of a mention: a column of the clustered layout, whose files are skipped by it."""
    return F.col("harvested_day") if "harvested_day" in mentions.columns else F.col("harvested_at").cast("date")


def _daily(mentions: DataFrame, as_of: date, days: int, types: Sequence[str] | None) -> DataFrame:
    day = _day(mentions)
    window = mentions.filter(
        (day > F.lit(days_before(as_of, days))) & (day <= F.lit(as_of)) & in_list("entity_type", types)
    )
    return window.groupBy(*ENTITY, "source_engine", day.alias("day")).agg(
        F.count(F.lit(1)).alias("mentions")
    )


def entity_growth(mentions: DataFrame, as_of: date, types: Sequence[str] | None = None) -> DataFrame:
    """Mentions of the last 7 days against the weekly average of the 21 days before.

    ``growth_rate`` falls back to the raw recent count while there is no prior.
    """
    per_day = _daily(mentions, as_of, WINDOW_DAYS, types).groupBy(*ENTITY, "day").agg(
        F.sum("mentions").alias("mentions"), F.count("source_engine").alias("platforms")
    )
    recent = F.col("day") > F.lit(days_before(as_of, RECENT_DAYS))
    out = per_day.groupBy(*ENTITY).agg(
        F.sum("mentions").alias("total_mentions"),
        zero_if_null(F.sum(F.when(recent, F.col("mentions")))).alias("recent_7d"),
        zero_if_null(F.sum(F.when(~recent, F.col("mentions")))).alias("_prior"),
        F.avg("platforms").alias("avg_platforms"),
    )
    weeks = (WINDOW_DAYS - RECENT_DAYS) / RECENT_DAYS
    prior = F.col("_prior") / F.lit(weeks)
    growth = F.when(prior > 0, F.col("recent_7d") / prior - 1).otherwise(F.col("recent_7d").cast("double"))
    return out.withColumns({"prior_avg_7d": prior, "growth_rate": growth}).drop("_prior")


def trending(mentions: DataFrame, as_of: date, types: Sequence[str], n: int = 10) -> DataFrame:
    """Q95: fastest growing entities of the given types."""
    grown = entity_growth(mentions, as_of, types)
    return grown.orderBy(F.col("growth_rate").desc(), *ENTITY).limit(n)


def declining(mentions: DataFrame, as_of: date, types: Sequence[str], n: int = 10) -> DataFrame:
    """Q97: entities losing most."""
    grown = entity_growth(mentions, as_of, types).drop("avg_platforms")
    return grown.orderBy("growth_rate", *ENTITY).limit(n)


def viral(mentions: DataFrame, as_of: date, types: Sequence[str], n: int = 10) -> DataFrame:
    """Q96: daily mean of the last two days against the 26 days before.

    Without a baseline the ratio falls back to the recent count.
    """
    per_engine = _daily(mentions, as_of, WINDOW_DAYS, types).groupBy(*ENTITY, "source_engine")
    recent = F.col("day") > F.lit(days_before(as_of, VIRAL_DAYS))
    counted = per_engine.agg(
        zero_if_null(F.sum(F.when(recent, F.col("mentions")))).alias("now"),
        zero_if_null(F.sum(F.when(~recent, F.col("mentions")))).alias("before"),
    )
    out = counted.groupBy(*ENTITY).agg(
        (F.sum("now") / F.lit(float(VIRAL_DAYS))).alias("recent_avg"),
        (F.sum("before") / F.lit(float(WINDOW_DAYS - VIRAL_DAYS))).alias("baseline"),
        F.count_if(F.col("source_engine").isNotNull() & (F.col("now") > 0)).alias("recent_platforms"),
        F.sum("now").alias("recent_total"),
    )
    spike = F.coalesce(ratio("recent_avg", "baseline"), F.col("recent_total").cast("double"))
    return out.withColumn("spike_ratio", spike).orderBy(F.col("spike_ratio").desc(), *ENTITY).limit(n)


def staying_power(mentions: DataFrame, as_of: date, n: int = 10) -> DataFrame:
    """Q98: score 0-100 from reach over engines, steady days and mixed sources.

    Reach: engines over the most engines any entity has. Steadiness: one minus the
    variation of the daily counts, not below 0. Diversity: one minus the sum of the
    squared engine shares.
    """
    daily = _daily(mentions, as_of, WINDOW_DAYS, None)
    days = daily.groupBy(*ENTITY, "day").agg(F.sum("mentions").alias("m")).groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("days_observed"),
        F.sum("m").alias("total_mentions"),
        F.try_divide(F.stddev_pop("m"), F.avg("m")).alias("_cv"),
    )
    engines = daily.groupBy(*ENTITY, "source_engine").agg(F.sum("mentions").alias("m"))
    engines = engines.groupBy(*ENTITY).agg(
        F.count("source_engine").alias("_platforms"),
        (F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m"))).alias("_concentration"),
    )
    most = grand_total(engines, F.max("_platforms"))
    joined = days.join(engines, ENTITY)
    scored = joined.withColumns(
        {
            "cross_platform_score": ratio("_platforms", most),
            "stability_score": 1 - F.least(F.lit(1.0), F.col("_cv")),
            "diversity_score": 1 - F.col("_concentration"),
        }
    )
    parts = ["cross_platform_score", "stability_score", "diversity_score"]
    mean = (F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2])) / 3
    scored = scored.withColumn("staying_power_score", 100 * mean)
    best = scored.orderBy(
        F.col("staying_power_score").desc(), F.col("total_mentions").desc(), *ENTITY
    ).limit(n)
    signal = lambda c: F.col(c) >= SIGNAL_FROM
    return best.select(
        *ENTITY, "days_observed", "total_mentions", *parts, "staying_power_score",
        signal(parts[0]).alias("is_cross_platform"),
        signal(parts[1]).alias("is_stable"),
        signal(parts[2]).alias("is_broad"),
    )


# -- phrases ------------------------------------------------------------------------------

def words(text: str) -> Column:
    """Lower-cased words of a text: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def phrase_rows(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per phrase occurrence."""
    triples = _word_triples(texts, text, *keep)
    pair = F.concat_ws(" ", "a", "b")
    triple = F.when(F.col("c").isNotNull(), F.concat_ws(" ", "a", "b", "c"))
    return triples.select(*keep, F.stack(F.lit(2), pair, triple).alias("ngram")).filter("ngram IS NOT NULL")


def _word_triples(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """Each word with the next and, if there is one, the one after it.

    The word array is zipped with itself shifted by one and by two, which stays in
    generated code and needs no window over word positions.
    """
    worded = texts.select(*keep, words(text).alias("w"))
    size = F.greatest(F.size("w"), F.lit(1))
    shifted = F.arrays_zip(
        F.col("w").alias("a"),
        F.slice("w", 2, size).alias("b"),
        F.slice("w", 3, size).alias("c"),
    )
    return worded.select(*keep, F.inline(shifted).alias("a", "b", "c")).filter("b IS NOT NULL")


def _hashed_phrases(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per phrase occurrence: its words (``c`` is null in a pair) and a hash of them."""
    pair, triple = F.xxhash64("a", "b"), F.when(F.col("c").isNotNull(), F.xxhash64("a", "b", "c"))
    both = F.stack(F.lit(2), pair, F.lit(None).cast("string"), triple, F.col("c")).alias("hash", "third")
    rows = _word_triples(texts, text, *keep).select(*keep, "a", "b", both).filter("hash IS NOT NULL")
    return rows.withColumnRenamed("third", "c")


def emerging_phrases(
    texts: DataFrame, dictionary: DataFrame, as_of: date, days: int = RECENT_DAYS, n: int = 10
) -> DataFrame:
    """Q99: two- and three-word phrases up on the period before and not in the
    dictionary (column ``phrase``); ratio (recent + 1) / (prior + 1)."""
    day = F.col("harvested_at").cast("date")
    window = texts.filter((day > F.lit(days_before(as_of, 2 * days))) & (day <= F.lit(as_of)))
    # Each text becomes thousands of phrases: texts are dealt out by their address, to as
    # many tasks as their bytes need, so that neither the files' splits nor copies of a text
    # decide who does that work. A task counts its own phrases before they are dealt out.
    size = window.agg(F.sum(F.octet_length("snippet"))).first()[0] or 0
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))
    part = F.pmod(F.xxhash64("url"), F.lit(tasks)).cast("int")
    dated = window.withColumns({"recent": day > F.lit(days_before(as_of, days)), "part": part}).repartitionById(tasks, "part")
    counts = {"f_recent": F.count_if("recent"), "f_prior": F.count_if(~F.col("recent"))}
    own = phrase_rows(dated, "snippet", "recent", "part").groupBy("part", "ngram").agg(*[c.alias(n) for n, c in counts.items()])
    counted = own.repartition(tasks, "ngram").groupBy("ngram").agg(*[F.sum(n).alias(n) for n in counts])
    known = dictionary.select(F.lower(F.trim("phrase")).alias("ngram")).distinct()
    fresh = counted.filter(F.col("f_recent") >= MIN_PHRASE_COUNT).join(known, "ngram", "left_anti")
    growth = (F.col("f_recent") + 1) / (F.col("f_prior") + 1)
    return fresh.withColumn("growth_ratio", growth).orderBy(F.col("growth_ratio").desc(), "ngram").limit(n)


def emerging_phrases_bounded(
    texts: DataFrame, dictionary: DataFrame, as_of: date, days: int = RECENT_DAYS, n: int = 10, buckets: int = PHRASE_BUCKETS
) -> DataFrame:
    """Q99 with bounded state: the same rows, without counting every phrase by its text.

    Pass one counts recent phrases by ``buckets`` hash values: as many numbers whatever
    the number of phrases, and never below the count of a phrase in the bucket. Pass two
    counts the phrases of the fullest buckets exactly; its n-th growth ratio is a bar
    that the answer must reach. As a ratio is at most the recent count plus one, only
    buckets full enough to reach the bar can hold other phrases of the answer. Pass three
    counts those of them that pass two has not; where there are none, it is left out."""
    day = F.col("harvested_at").cast("date")
    window = texts.filter((day > F.lit(days_before(as_of, 2 * days))) & (day <= F.lit(as_of)))
    dated = window.withColumn("recent", day > F.lit(days_before(as_of, days)))
    rows = _hashed_phrases(dated, "snippet", "recent").withColumn("bucket", F.pmod("hash", F.lit(buckets))).drop("hash")
    known = dictionary.select(F.lower(F.trim("phrase")).alias("ngram")).distinct()

    def first(fresh: DataFrame) -> DataFrame:
        return fresh.orderBy(F.col("growth_ratio").desc(), "ngram").limit(n)

    def counted(kept: DataFrame) -> DataFrame:
        """Exact counts of the phrases of some buckets; the key set is bounded, so it is broadcast."""
        some = rows.join(F.broadcast(kept.select("bucket")), "bucket", "left_semi")
        phrases = some.select("recent", F.concat_ws(" ", "a", "b", "c").alias("ngram"))
        exact = phrases.groupBy("ngram").agg(F.count_if("recent").alias("f_recent"), F.count_if(~F.col("recent")).alias("f_prior"))
        fresh = exact.filter(F.col("f_recent") >= MIN_PHRASE_COUNT).join(known, "ngram", "left_anti")
        growth = (F.col("f_recent") + 1) / (F.col("f_prior") + 1)
        return first(fresh.withColumn("growth_ratio", growth))

    recent = rows.filter("recent").groupBy("bucket").agg(F.count(F.lit(1)).alias("most"))
    full = materialise(recent.filter(F.col("most") >= MIN_PHRASE_COUNT), "phrase-buckets")
    # The fullest buckets: by number, or as many more as hold a bounded part of all phrases.
    levels = full.groupBy("most").agg(F.count(F.lit(1)).alias("held"), F.sum("most").alias("phrases"))
    down = Window.orderBy(F.col("most").desc())
    above = levels.select("most", "held", F.sum("held").over(down).alias("number"), F.sum("phrases").over(down).alias("part"), F.sum("phrases").over(Window.partitionBy()).alias("all"))
    enough = (F.col("number") - F.col("held") < FULLEST * n) | (F.col("part") <= BAR_SHARE * F.col("all"))
    floor = above.filter(enough).agg(F.min("most").alias("most")).first()["most"] or MIN_PHRASE_COUNT
    best = materialise(counted(full.filter(F.col("most") >= F.lit(floor))), "phrases-of-full-buckets")
    bar = best.agg(F.count(F.lit(1)).alias("found"), F.min("growth_ratio").alias("ratio")).first()
    least = bar["ratio"] - 1 if bar["found"] == n else MIN_PHRASE_COUNT
    rest = full.filter((F.col("most") < F.lit(floor)) & (F.col("most") >= F.lit(least)))
    return first(best.unionByName(counted(rest)) if rest.limit(1).count() else best)


# -- cards ------------------------------------------------------------------------------------

def headline_mover(mentions: DataFrame, as_of: date) -> DataFrame:
    """Q100: the entity that grew most; ``is_bootstrap`` marks a raw-count growth."""
    best = entity_growth(mentions, as_of).filter("growth_rate IS NOT NULL")
    best = best.orderBy(F.col("growth_rate").desc(), *ENTITY).limit(1)
    growth = F.col("growth_rate") * 100
    return best.select(
        "entity_name",
        "entity_type",
        growth.alias("growth_pct"),
        F.col("recent_7d").alias("mentions"),
        F.rint(F.coalesce("avg_platforms", F.lit(0.0))).cast("int").alias("platforms"),
        (F.abs(growth - F.col("recent_7d") * 100) < 1).alias("is_bootstrap"),
    )


def sources_for(
    mentions: DataFrame, entity: str, as_of: date, days: int = 14, n: int = 5, snippet_length: int = SNIPPET_LENGTH
) -> DataFrame:
    """Q101: latest mentions of one entity with display title, engine and snippet."""
    kept = mentions.filter(
        (F.col("entity_name") == entity)
        & (_day(mentions) >= F.lit(days_before(as_of, days)))
    )
    newest = kept.orderBy(F.col("harvested_at").desc(), "url").limit(n)
    engine = F.coalesce("source_engine", F.lit("web"))
    plain = F.replace(F.replace(engine, F.lit("_noapi"), F.lit("")), F.lit("_"), F.lit(" "))
    return newest.select(
        F.initcap(plain).alias("engine_label"),
        "url",
        F.coalesce("title", F.lit("(no title)")).alias("title"),
        F.substring(F.coalesce("snippet", F.lit("")), 1, snippet_length).alias("snippet"),
        "harvested_at",
    )


def growth_display(trend: DataFrame) -> DataFrame:
    """Q102: show a growth that is really the raw count as mentions, else as percent."""
    bootstrap = F.abs(F.col("growth_rate") - F.col("recent_7d")) < 0.5
    return trend.withColumns(
        {
            "display_kind": F.when(bootstrap, "mentions").otherwise("percent"),
            "display_value": F.when(bootstrap, F.col("recent_7d").cast("double")).otherwise(
                F.col("growth_rate") * 100
            ),
        }
    )


def spike_display(spikes: DataFrame) -> DataFrame:
    """Q102: a spike without a baseline shows as mentions, else as a multiple."""
    bootstrap = F.coalesce("baseline", F.lit(0.0)) == 0
    return spikes.withColumns(
        {
            "display_kind": F.when(bootstrap, "mentions").otherwise("multiple"),
            "display_value": F.when(bootstrap, F.col("recent_total").cast("double")).otherwise(
                F.col("spike_ratio")
            ),
        }
    )


def last_refresh(mentions: DataFrame, as_of: date, days: int = 3) -> DataFrame:
    """S09: latest harvest of the last days, NULL if there was none."""
    recent = mentions.filter(F.col("harvested_at").cast("date") >= F.lit(days_before(as_of, days)))
    return recent.agg(F.max("harvested_at").alias("last_refresh"))


def first_of_each(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """U03: frames stacked in order, keeping the first row of every key."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    stacked = tagged[0]
    for frame in tagged[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in (key, "_source")]
    first = F.min_by(F.struct(*rest), F.struct("_source", *rest)).alias("_row")
    picked = stacked.groupBy(key).agg(first)
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
