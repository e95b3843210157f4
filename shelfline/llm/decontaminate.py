"""Benchmark decontamination with DataFrame functions only.

Every window of ``size`` consecutive normalised words of a benchmark item (an item
with fewer words is one window) is stored under its *anchor*, the longest of its
words. Documents are split into words once; a word that is an anchor of the
broadcast window set is a candidate, and the words around it are compared with the
whole window. Only verified hits are shuffled. A window set above
``BROADCAST_WINDOWS`` is joined by a shuffle instead, of a hash and a position per word
and window length, not of texts; the rows hit are then joined with their texts to
verify whole windows. Results are the same.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; an item without an id contributes hits but is not listed;
rows with equal id and text get equal results; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import ascii_lower, key_side, row_key, same_row
from shelfline.sources.storage import materialise

#: What separates words: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows that may be broadcast.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """Words in their own case; no words for null."""
    return F.coalesce(F.array_remove(F.split(text, GAP, -1), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``anchor``, ``before`` (words ahead of it in the window),
    ``window`` and the sorted ``items`` that hold it."""
    split = benchmark.select(F.col(item).cast("string").alias("item"), words_of(ascii_lower(F.col(text))).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    windows = (
        split.where(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("start"))
        .select("item", F.slice("w", F.col("start"), F.lit(size)).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    longest = F.array_max(F.transform("window", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"))))
    before = -longest["at"]
    return windows.select(F.get("window", before).alias("anchor"), before.alias("before"), "window", "items")


def window_positions(docs: DataFrame, lengths: list[int], identity: str, text: str) -> DataFrame:
    """Row key, ``start``, ``length`` and the hash ``h`` of every run of words of one of the lengths."""
    worded = docs.select(*row_key(identity, text), words_of(ascii_lower(F.col(text))).alias("w"))
    at = F.explode(F.expr("sequence(0, size(w) - 1)")).alias("start")
    length = F.explode(F.array(*map(F.lit, lengths))).alias("length")
    spread = worded.where("size(w) > 0").select("*", at).select("*", length).where("start + length <= size(w)")
    return spread.select("__id", "__hash", "start", "length", F.xxhash64(F.expr("slice(w, start + 1, length)")).alias("h"))


def _hits_by_hash(docs: DataFrame, windows: DataFrame, identity: str, text: str) -> DataFrame:
    hashed = windows.select(F.size("window").alias("length"), F.xxhash64("window").alias("h"), "window", "items")
    lengths = [r["length"] for r in hashed.select("length").distinct().collect()]  # at most the window's size of them
    if not lengths:
        return docs.select(*row_key(identity, text), F.lit(0).alias("start"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("items")).limit(0)
    found = window_positions(docs, lengths, identity, text).join(hashed.select("length", "h").distinct(), ["length", "h"])
    per_row = found.groupBy("__id", "__hash").agg(F.collect_set(F.struct("start", "length", "h")).alias("found"))
    side = key_side(materialise(per_row, "window-candidates"))
    worded = docs.select(*row_key(identity, text), words_of(ascii_lower(F.col(text))).alias("w"))
    again = worded.join(side, same_row(worded, side)).select(worded["__id"], worded["__hash"], "w", F.explode("found").alias("f"))
    shown = again.select("__id", "__hash", "f.*", F.expr("slice(w, f.start + 1, f.length)").alias("window"))
    return shown.join(hashed.select("h", "window", "items"), ["h", "window"]).select("__id", "__hash", "start", "length", "items").distinct()


def window_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    identity: str = "doc_id",
    text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Verified occurrences: row key, ``start`` (from 0), ``length`` in words, ``items``."""
    windows = benchmark_windows(benchmark, size)
    if windows.limit(broadcast_windows + 1).count() > broadcast_windows:
        return _hits_by_hash(docs, windows, identity, text)
    windows = F.broadcast(windows)
    # The outer form keeps the word array from being computed a second time for an inferred filter.
    spread = docs.select(*row_key(identity, text), words_of(ascii_lower(F.col(text))).alias("w")).select(
        "__id", "__hash", "w", F.posexplode_outer("w").alias("at", "word")
    )
    start = F.col("at") - F.col("before")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.size("w"))
    found = F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("window")
    return (
        spread.join(windows, spread["word"] == windows["anchor"])
        .where(inside & found)
        .select("__id", "__hash", start.alias("start"), length.alias("length"), "items")
        .distinct()
    )


def hit_spans(hits: DataFrame) -> DataFrame:
    """Hits of a row merged into runs of words ``[start, end)`` that do not overlap."""
    per_row = "PARTITION BY __id, __hash ORDER BY start, end"
    reached = f"max(end) OVER ({per_row} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        hits.groupBy("__id", "__hash", "start")
        .agg(F.max(F.col("start") + F.col("length")).alias("end"))
        .withColumn("reached", F.expr(reached))
        .select("__id", "__hash", F.greatest("start", F.coalesce("reached", "start")).alias("start"), "end")
        .where("end > start")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: its id, ``n_words``, ``n_hit``, sorted ``items``, ``spans``."""
    hits = materialise(window_hits(docs, benchmark, size, identity, text), "hits")
    spans = (
        hit_spans(hits)
        .groupBy("__id", "__hash")
        .agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    listed = (
        hits.select("__id", "__hash", F.explode_outer("items").alias("item"))
        .groupBy("__id", "__hash")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    found = spans.join(listed, same_row(spans, listed)).select(
        spans["__id"], spans["__hash"], "n_hit", "items", "spans"
    )
    # No lower case here: the number of words does not depend on it.
    rows = docs.select(*row_key(identity, text), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    return rows.join(found, same_row(rows, found), "left").select(
        rows["__id"].alias(identity),
        rows["__hash"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    size: int = WINDOW,
    identity: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, or (``remove``
    = "spans") with the words of every occurrence cut out of the text."""
    spans = hit_spans(window_hits(docs, benchmark, size, identity, text))
    identity_now, hash_now = row_key(identity, text)
    keyed = docs.select("*", identity_now, hash_now)
    if remove == "documents":
        dirty = key_side(materialise(spans.select("__id", "__hash").distinct(), "contaminated"))
        return keyed.join(dirty, same_row(keyed, dirty), "left_anti").select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    dirty = spans.groupBy("__id", "__hash").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    dirty = key_side(materialise(dirty, "contaminated"))
    words, gaps = words_of(F.col(text)), F.split(F.col(text), WORD, -1)
    clean = F.transform(
        F.arrays_zip(words.alias("w"), gaps.alias("g")),
        lambda x, i: F.concat(
            x["g"],
            F.when(F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["end"])), "").otherwise(F.coalesce(x["w"], F.lit(""))),
        ),
    )
    joined = keyed.join(dirty, same_row(keyed, dirty), "left").select(*(keyed[c] for c in docs.columns), "__spans")
    cut = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.array_join(clean, ""))
    return joined.withColumn(text, cut).select(*docs.columns)
