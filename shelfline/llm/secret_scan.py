"""Secret scans with corpus-wide ownership frequency, DataFrame functions only.

Candidates are found per text by pattern. The hashes of their values are counted by
distinct repositories and owners over the whole corpus: a value that many owners hold
is a widely copied example, one that few hold looks like a live credential. Besides
the three base kinds, long mixed runs outside any base span (kind ``live``) become
spans if they are owner-specific; base spans always stay.

Offsets are code points, end exclusive. They come from the lengths of the pieces
between matches, summed up per text, so the work is linear in the text.

Defined results: a null text is empty; a row without an owner counts as owned by one
unnamed owner; rows with equal id and text get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import key_side, row_key, same_row
from shelfline.sources.storage import materialise

# The kinds in their order, their patterns, and the least characters of
# what the pattern's last group (or the whole match) holds.
KINDS = ["assign", "access", "hex", "live"]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # Runs below the least length cannot match later inside themselves, so the bound is part of the pattern.
    "access": r"(AKIA[A-Z0-9]{16,})",
    "hex": r"((?<![0-9a-f])[0-9a-f]{24,})",
    "live": r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,})",
}
LEAST = {"assign": 6, "access": 20, "hex": 24, "live": 20}
#: A value under so many distinct owners is a widely copied example.
EXAMPLE_OWNERS = 5
#: Distinct characters a mixed run needs to look like a credential.
LIVE_VARIETY = 10
MASK = "[SECRET]"


def _matches(text: Column, kind: str) -> Column:
    """The matches of a kind in order: length of the piece before, of the match and of
    its value, and the value."""
    pattern = F.lit(PATTERNS[kind])
    whole, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1))
    zipped = F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(whole)).alias("p"), whole.alias("m"), value.alias("v"))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("at"),
            F.length(x["p"]).alias("gap"),
            F.length(x["m"]).alias("size"),
            F.length(x["v"]).alias("value_size"),
            x["v"].alias("value"),
        ),
    )
    return F.when(text.rlike(PATTERNS[kind]), rows).otherwise(F.array().cast(_ROW))


_ROW = "array<struct<kind:string,at:int,gap:int,size:int,value_size:int,value:string>>"


def candidates(docs: DataFrame, identity: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """A row per pattern match of a text; values leave this step as hashes only."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*row_key(identity, text), F.col(owner).cast("string").alias("owner"), body.alias("body"))
    spread = found.select("__id", "__hash", "owner", F.inline(F.concat(*(_matches(F.col("body"), k) for k in KINDS))))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= LIVE_VARIETY)
    least = F.create_map(*(F.lit(x) for kind in LEAST.items() for x in kind))[F.col("kind")]
    return spread.select(
        "__id",
        "__hash",
        "owner",
        "kind",
        "at",
        "gap",
        "size",
        "value_size",
        F.sha2("value", 256).alias("value_hash"),
        ((F.col("value_size") >= least) & ((F.col("kind") != "live") | mixed)).alias("valid"),
    )


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``value_hash`` with its distinct ``repositories`` (documents) and ``owners`` and
    whether it is a widely copied ``example``. Counted level by level, so that one
    value in a third of all rows is summed up before each shuffle."""
    return (
        found.where("valid")
        .groupBy("value_hash", "owner", "__id", "__hash")
        .agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("value_hash")
        .agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
        .withColumn("example", F.col("owners") >= example_owners)
    )


def _located(found: DataFrame) -> DataFrame:
    """Valid matches with their offsets, once for each distinct row."""
    once = found.groupBy("__id", "__hash", "kind", "at").agg(
        *(F.first(c).alias(c) for c in ("gap", "size", "value_size", "value_hash", "valid"))
    )
    in_text = "OVER (PARTITION BY __id, __hash, kind ORDER BY at ROWS UNBOUNDED PRECEDING)"
    return (
        once.withColumn("end", F.expr(f"sum(gap + size) {in_text}"))
        .where("valid")
        .select("__id", "__hash", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value_size", "value_hash")
    )


def spans(docs: DataFrame, identity: str = "doc_id", text: str = "text", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """All spans: row key, ``kind``, ``start``, ``end``, ``value_start``, ``value_hash``,
    ``repositories``, ``owners``, ``example``."""
    found = materialise(candidates(docs, identity, text, owner), "secrets")
    near = "PARTITION BY __id, __hash ORDER BY start RANGE BETWEEN"
    base = "kind <> 'live'"
    apart = (
        f"{base} OR NOT (coalesce(max(CASE WHEN {base} THEN end END) OVER ({near} UNBOUNDED PRECEDING AND CURRENT ROW) > start, false)"
        f" OR coalesce(min(CASE WHEN {base} THEN start END) OVER ({near} CURRENT ROW AND UNBOUNDED FOLLOWING) < end, false))"
    )
    located = _located(found).withColumn("apart", F.expr(apart)).where("apart")
    return (
        located.join(ownership(found, example_owners), "value_hash")
        .where(f"{base} OR NOT example")
        .select("__id", "__hash", "kind", "start", "end", (F.col("end") - F.col("value_size")).alias("value_start"), "value_hash", "repositories", "owners", "example")
    )


def span_text(entries: Column) -> Column:
    """``kind:start:end`` of structs (start, order, end), comma-joined in that order."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(entries), lambda s: F.concat_ws(":", F.get(name, s["order"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, identity: str = "doc_id", text: str = "text", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document row: id, spans per kind, ``base`` and ``spans`` as text,
    ``n_live`` (spans that look like live credentials) and ``n_example``."""
    found = spans(docs, identity, text, owner, example_owners)
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    entry = F.struct("start", order.alias("order"), "end")
    per_row = found.groupBy("__id", "__hash").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS[:3]),
        F.count_if(~F.col("example")).alias("n_live"),
        F.count_if("example").alias("n_example"),
        span_text(F.collect_list(F.when(F.col("kind") != "live", entry))).alias("base"),
        span_text(F.collect_list(entry)).alias("spans"),
    )
    rows = docs.select(*row_key(identity, text))
    counts = [c for c in per_row.columns if c.startswith("n_")]
    return rows.join(per_row, same_row(rows, per_row), "left").select(
        rows["__id"].alias(identity),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")),
    )


def mask(docs: DataFrame, identity: str = "doc_id", text: str = "text", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with the values of live-looking credentials masked; examples and all
    other text stay. An ``n_chars`` column follows the new text."""
    values = spans(docs, identity, text, owner, example_owners).where("NOT example").groupBy("__id", "__hash", F.col("value_start").alias("start")).agg(F.max("end").alias("end"))
    per_row = "OVER (PARTITION BY __id, __hash ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = (
        values.withColumn("from", F.coalesce(F.expr(f"max(end) {per_row}"), F.lit(0)))
        .groupBy("__id", "__hash")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "from"))).alias("__parts"))
    )
    parts = key_side(materialise(parts, "masks"))
    id_now, hash_now = row_key(identity, text)
    keyed = docs.select("*", id_now, hash_now)
    joined = keyed.join(parts, same_row(keyed, parts), "left").select(*(keyed[c] for c in docs.columns), "__parts")
    # A value that overlaps the one before it adds nothing but the text's further reach.
    body, cuts = F.col(text), F.col("__parts")
    pieces = F.transform(
        cuts,
        lambda p: F.when(
            p["start"] >= p["from"],
            F.concat(F.substring(body, p["from"] + 1, p["start"] - p["from"]), F.lit(MASK)),
        ).otherwise(""),
    )
    reach = F.array_max(F.transform(cuts, lambda p: p["end"]))
    masked = F.concat(F.array_join(pieces, ""), F.substring(body, reach + 1, F.length(body)))
    out = joined.withColumn(text, F.when(cuts.isNull(), body).otherwise(masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cuts.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))
    return out.select(*docs.columns)
