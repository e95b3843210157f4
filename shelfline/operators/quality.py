"""Data-quality guards: broken priors, unmatched accounts, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfline.functions.columns import percent
from shelfline.sources.storage import scratch_path


def is_populated(c: str) -> Column:
    """A number other than zero; text that is no number does not count."""
    number = F.col(c).try_cast("double")
    return F.coalesce(number != 0, F.lit(False))


def check_symmetry(kpis: DataFrame) -> DataFrame:
    """Q103: marks KPIs whose current value is populated while the prior is not.

    ``kpis`` has ``name``, ``current``, ``prior``, ``source`` and
    ``allow_missing_prior``, which opts a KPI out.
    """
    opted_out = F.coalesce("allow_missing_prior", F.lit(False))
    return kpis.withColumn(
        "is_broken", ~opted_out & is_populated("current") & ~is_populated("prior")
    )


def symmetry_breaks(kpis: DataFrame) -> DataFrame:
    """Q103: only the broken ones."""
    return check_symmetry(kpis).filter("is_broken").drop("is_broken")


def all_checks_pass(kpis: DataFrame) -> DataFrame:
    """Q103: one row, true when nothing is broken."""
    return check_symmetry(kpis).agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("is_broken").alias("broken"),
        (F.count_if("is_broken") == 0).alias("passed"),
    )


class GuardFailed(ValueError):
    """KPIs were published whose prior is broken; ``report`` has the counts."""

    def __init__(self, report: dict):
        super().__init__(f"{report['broken']} of {report['checks']} KPIs have a value but no prior, the first is {report['first_broken']}")
        self.report = report


def guarded(kpis: DataFrame) -> tuple[DataFrame, Observation]:
    """Q103: ``kpis`` as they are, with the guard counted by whatever job reads them.

    The observation has ``checks``, ``broken`` and ``first_broken`` (the least name, or
    NULL) once an action on the frame is through; ``get`` waits for it. Spark counts a
    row again if a lost executor's shuffle stage is run again, so observe where rows
    leave the job, as ``publish_guarded`` does, and not below a shuffle.
    """
    observation = Observation()
    marked = check_symmetry(kpis)
    watched = marked.observe(
        observation,
        F.count(F.lit(1)).alias("checks"),
        F.count_if("is_broken").alias("broken"),
        F.min(F.when(F.col("is_broken"), F.col("name"))).alias("first_broken"),
    )
    return watched.drop("is_broken"), observation


def publish_guarded(kpis: DataFrame, path: str | None = None, strict: bool = False) -> tuple[DataFrame, dict]:
    """Q103: writes ``kpis`` to ``path`` (default: the shared folder) and guards them in
    the same job; the written table and the report, which also has ``passed``.

    A ``strict`` caller gets ``GuardFailed`` and the folder is left for inspection. An
    empty table passes with no checks.
    """
    watched, observation = guarded(kpis)
    path = path or scratch_path(kpis.sparkSession, "guarded-kpis")
    watched.write.parquet(path)
    report = dict(observation.get)
    report["passed"] = report["broken"] == 0
    if strict and not report["passed"]:
        raise GuardFailed(report)
    return kpis.sparkSession.read.schema(watched.schema).parquet(path), report


def _matched_codes(mapping: DataFrame) -> DataFrame:
    """Codes mapped to an account or a parent account."""
    mapped = mapping.filter(F.col("account_id").isNotNull() | F.col("parent_account_id").isNotNull())
    return mapped.select("code").distinct()


def match_rate(accounts: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    """Q104: share of account codes the other system knows, per group."""
    flagged = accounts.join(
        _matched_codes(mapping).withColumn("_hit", F.lit(True)), "code", "left"
    )
    out = flagged.groupBy(group).agg(
        F.count(F.lit(1)).alias("accounts"), F.count("_hit").alias("matched")
    )
    return out.withColumn("match_rate_pct", percent("matched", "accounts"))


def unmatched_accounts(accounts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Q104: accounts without a counterpart and the question to ask about them."""
    missing = accounts.join(_matched_codes(mapping), "code", "left_anti")
    return missing.select(
        "account_name", "code", F.lit("Which account receives orders for this code?").alias("question")
    )


def normalised_name(c: str) -> Column:
    """Lower-cased name without punctuation and with single spaces."""
    plain = F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " ")
    return F.trim(plain)


def duplicate_groups(records: DataFrame, name: str, code: str) -> DataFrame:
    """Q105: names that occur more than once after normalisation.

    Groups report counts and their first and last code instead of a member list, so
    a name shared by a third of the records stays one small row.
    """
    out = records.groupBy(normalised_name(name).alias("name_key")).agg(
        F.count(F.lit(1)).alias("copies"),
        F.countDistinct(code).alias("codes"),
        F.min(code).alias("first_code"),
        F.max(code).alias("last_code"),
    )
    return out.filter("copies > 1")


# -- nearly equal names ---------------------------------------------------------------

#: Characters of a gram, and the least similarity of two sets of grams in per cent.
GRAM, NEAR_PERCENT = 3, 80
#: Numbers of 64 bits in the bit map of a name's grams, and tasks of the join on grams:
#: its rows are few bytes and much work, so sizes do not tell how to deal them.
BIT_WORDS, GRAM_TASKS = 4, 200


def name_grams(key: Column, size: int = GRAM) -> Column:
    """Distinct runs of ``size`` characters of a name with a blank on either side."""
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(size))))


def gram_bits(grams: str) -> Column:
    """Bit map of a set of grams: each sets one of the bits of ``BIT_WORDS`` numbers."""
    bit = F.transform(F.col(grams), lambda g: F.pmod(F.xxhash64(g), F.lit(64 * BIT_WORDS)))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))

    def word(i: int) -> Column:
        own = F.filter(bit, lambda b: F.floor(b / 64) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(one(b)))

    return F.struct(*[word(i).alias(f"b{i}") for i in range(BIT_WORDS)])


def near_names(records: DataFrame, name: str, code: str, percent: int = NEAR_PERCENT, size: int = GRAM) -> DataFrame:
    """Q105: pairs of different normalised names with a Jaccard similarity of their
    grams of ``percent`` or more, with copies and first code of either.

    A name counts once however many records share it. Its grams are ordered by how many
    names hold them, rarest first. Of two names that similar the smaller one, of n grams,
    shares 2p / (100 + p) of its own, and the larger one p per cent: one of the first grams
    that this leaves is common to both, so only these are joined. A bit map of the grams
    differs in no more bits than the sets do in grams, which drops nearly all other pairs
    inside the join; what is left once per pair is compared by whole sets.
    """
    names = records.groupBy(normalised_name(name).alias("key")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(code).alias("first_code")
    )
    names = names.filter("key <> ''").withColumn("grams", name_grams(F.col("key"), size))
    spread = names.select("key", F.explode("grams").alias("gram"))
    held = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    ranked = spread.join(held.filter("names > 1"), "gram").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("names", "gram"))).alias("shared")
    )
    # Grams of one name come first in the order and match nothing: they only use up the prefix.
    n, shared = F.size("grams"), F.size("shared")
    prefix = lambda needed: (shared - needed + 1).cast("int")
    as_larger, as_smaller = F.ceil(F.lit(percent) * n / 100), F.ceil(F.lit(2 * percent) * n / (100 + percent))
    sized = names.join(ranked, "key").select(
        "key", n.alias("n"), gram_bits("grams").alias("bits"), "shared",
        prefix(as_larger).alias("as_larger"), prefix(as_smaller).alias("as_smaller"),
    ).filter("as_larger > 0")
    first = F.slice("shared", F.lit(1), F.col("as_larger"))
    index = sized.select("key", "n", "bits", "as_smaller", F.posexplode(first).alias("at", "g")).select("*", "g.gram").repartition(GRAM_TASKS, "gram")
    row = lambda s: F.struct("n", "key", "bits").alias(s)
    small = index.filter("at < as_smaller").select("gram", row("small"))
    large = index.select("gram", row("large"))
    differ = sum((F.bit_count(F.col(f"small.bits.b{i}").bitwiseXOR(F.col(f"large.bits.b{i}"))) for i in range(BIT_WORDS)), F.lit(0))
    # |A| + |B| less twice the least overlap, p / (100 + p) of the sum
    possible = (F.col("small.n") * 100 >= F.col("large.n") * percent) & (
        differ * (100 + percent) <= (F.col("small.n") + F.col("large.n")) * (100 - percent)
    )
    ordered = F.struct("small.n", "small.key") < F.struct("large.n", "large.key")
    found = small.join(large, "gram").filter(possible & ordered)
    pairs = found.select(
        F.least("small.key", "large.key").alias("left_key"), F.greatest("small.key", "large.key").alias("right_key")
    ).distinct()
    side = lambda s: names.select(*[F.col(c).alias(f"{s}_{c}") for c in ("key", "copies", "first_code", "grams")])
    whole = pairs.join(side("left"), "left_key").join(side("right"), "right_key")
    overlap = F.size(F.array_intersect("left_grams", "right_grams"))
    union = F.size("left_grams") + F.size("right_grams") - F.col("overlap")
    near = whole.withColumn("overlap", overlap).withColumn("union", union).filter(F.col("overlap") * 100 >= F.col("union") * percent)
    return near.select(
        "left_key", "right_key", "left_copies", "right_copies", "left_first_code", "right_first_code",
        percent_of("overlap", "union").alias("similarity_pct"),
    )


def percent_of(part: str, whole: str) -> Column:
    return F.round(F.col(part) * 100 / F.col(whole), 2)
