"""Mixing sources to target weights.

Every source's words form one stream, dealt to chunks by a hash of id and text and
packed into blocks of a fixed number of words; each chunk ends in one short block.
Target shares (a weight per source, none above ``most`` times its source's words) give
each source a quota of words: whole passes over all its blocks, then a pass that ends
where the words still owed are met, in the middle of its last slot if need be. Output
shards draw multinomial counts of slots per source; what the draws exceed quotas by goes
to sources they left short, so quotas are met to the word. The r-th slot that the mix
takes from a source holds the block at r of a pseudorandom index permutation of its
full blocks, anew for each pass; the short ones follow. A pass takes a block once and
there are at most ``most`` passes, so no document exceeds ``most`` times its size.

All of this is decided from sizes alone. Only then are the texts dealt out, once: a
chunk's texts meet the slots that want its blocks, joined by index, and leave as blocks
of the mix. Chunks hold a bounded number of rows and words, so a source with a third of
all rows is still dealt over many tasks. The driver and each task that draws hold a few
numbers per source: sources are meant to be origins of a corpus, up to some 100,000.

Defined results: null and empty texts have size 0 and are taken 0 words; rows without
a source form one source, last in order; repeated rows are separate rows of their
stream (those with equal id and text share a chunk); the result depends on the rows and
the seed only. A source takes its target rounded to whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import utf8
from shelfline.sources.storage import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block, slots of an output shard, rows and expected words of a chunk of a source.
BLOCK_WORDS, SHARD_SLOTS, CHUNK_ROWS, CHUNK_WORDS = 64, 4096, 1_000, 500_000
SEED = 20_240_501
#: Sources up to which tables of a row per source are broadcast; beyond, they are shuffled.
BROADCAST_SOURCES = 100_000
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SLOT = "shard long, number int, rank long, short boolean, index long, words long, limit long"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, SPACE, -1), ""), F.array().cast("array<string>"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: ``number`` in code point order (null last), ``rows``, ``source_size``
    and ``target`` words. ``sizes`` has ``source`` and ``size``.

    Sharing the excess of capped sources again and again ends where a common level
    per weight fills up all sources; sorted by size per weight, the capped ones come
    first. One row per source takes part in the windows."""
    per_source = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights)).cast("int"))
    ordered = per_source.withColumn("number", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST) - 1").cast("int"))
    by_level = "ORDER BY source_size / weight, number"
    filled = (
        ordered.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.expr("sum(source_size) OVER ()"))
        .withColumn("used", F.expr(f"coalesce(sum(cap) OVER ({by_level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
        .withColumn("rest", F.expr(f"sum(weight) OVER ({by_level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
        .withColumn("capped", F.col("cap") * F.col("rest") <= F.col("weight") * (F.col("total") - F.col("used")))
    )
    open_weight = F.expr("sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()")
    capped_words = F.expr("sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()")
    shared = F.col("weight") * (F.col("total") - F.col("capped_words")) / F.col("open_weight")
    return (
        filled.withColumn("open_weight", open_weight)
        .withColumn("capped_words", capped_words)
        .select("source", "number", "rows", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))
    )


def running_total(df: DataFrame, key: str, chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, per ``key``, in the order
    of ``chunk`` and then ``order``: first over chunk sums, then inside each chunk."""
    per_chunk = df.groupBy(key, chunk).agg(F.sum(value).alias("chunk_sum"))
    before = f"coalesce(sum(chunk_sum) OVER (PARTITION BY {key} ORDER BY {chunk} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    inside = f"coalesce(sum({value}) OVER (PARTITION BY {key}, {chunk} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    placed = df.withColumn("chunk_inside", F.expr(inside))
    offsets = per_chunk.select(key, chunk, F.expr(before).alias("chunk_before"))
    return placed.join(offsets, [key, chunk]).withColumn(name, F.col("chunk_before") + F.col("chunk_inside")).drop("chunk_before", "chunk_inside")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), chosen by ``key``, at ``index``: a
    Feistel network over the next even number of bits, walked until it is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.uint64) // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    limit, salt = n.astype(np.uint64), key.astype(np.uint64)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    while todo.any():
        h, m, k = half[todo], mask[todo], salt[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mixed(right + mixed(k + np.uint64(turn))) & m)
        out[todo] = (left << h) | right
        todo = out >= limit
    return out.astype(np.int64)


def _small(per_source: DataFrame, count: int) -> DataFrame:
    """A table of a row per source, broadcast while it is known to be small."""
    return F.broadcast(per_source) if count <= BROADCAST_SOURCES else per_source


def _keyed(docs: DataFrame, identity: str, text: str, source: str) -> DataFrame:
    """``id``, ``source``, ``text``, and two hashes that order the rows of a chunk; rows equal in both are equal."""
    rows = docs.select(F.col(identity).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("k2", F.xxhash64("text")).withColumn("k1", F.xxhash64("id", "k2"))


def _chunked(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """``rows`` with the ``number`` of their source and their ``chunk`` of it."""
    few = _small(sources.select(F.col("source").alias("of"), "number", "chunks"), count)
    placed = rows.join(few, F.col("source").eqNullSafe(F.col("of")))
    return placed.withColumn("chunk", F.pmod("k1", "chunks")).drop("of", "chunks", "source")


def chunk_blocks(sizes: DataFrame, block_words: int) -> DataFrame:
    """Per chunk with words its ``full`` blocks and the words of its ``short`` one, and
    where they start among its source's: ``full_at``, ``short_no`` (its number) and
    ``short_at`` (words of the short blocks before)."""
    words = sizes.groupBy("number", "chunk").agg(F.sum("size").alias("n"))
    cut = words.select("number", "chunk", F.expr(f"n div {block_words}").alias("full"), (F.col("n") % block_words).alias("short"))
    cut = cut.withColumns({"part": F.expr("chunk div 1000"), "one": F.when(F.col("short") > 0, 1).otherwise(0).cast("long")})
    for value, name in (("full", "full_at"), ("one", "short_no"), ("short", "short_at")):
        cut = running_total(cut, "number", "part", ["chunk"], value, name)
    return cut.drop("part", "one")


def quotas(chunks: DataFrame, sources: DataFrame, count: int, block_words: int) -> DataFrame:
    """Per source with words: ``full`` and ``blocks`` (with the short ones), whole
    ``passes``, words ``owed`` after them, and slots in all."""
    owed = F.round("target").cast("long")
    facts = sources.where("source_size > 0").select(
        "number", F.expr("CAST(round(target) AS BIGINT) div source_size").alias("passes"), (owed % F.col("source_size")).alias("owed")
    )
    blocks = chunks.groupBy("number").agg(F.sum("full").alias("full"), F.count_if(F.col("short") > 0).alias("shorts"))
    plan = facts.join(_small(blocks, count), "number").withColumn("beyond", F.col("owed") - F.col("full") * block_words)
    needed = chunks.select("number", "short", "short_at").join(_small(plan.select("number", "beyond"), count), "number")
    needed = needed.where("short > 0 AND short_at < beyond").groupBy("number").agg(F.count("*").alias("some"))
    last = F.least("full", F.ceil(F.col("owed") / block_words)) + F.coalesce("some", F.lit(0))
    every = F.col("full") + F.col("shorts")
    return plan.join(needed, "number", "left").select(
        "number", "full", every.alias("blocks"), "passes", "owed", (F.col("passes") * every + last).alias("quota")
    )


def slots(spark, plan: list[tuple[int, int, int, int, int, int]], block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix: ``shard``, ``number`` of the source and ``rank`` of every slot, the
    ``index`` of the block it holds among its source's full or ``short`` blocks, and
    its ``words`` (of a short block at most those before ``limit``). ``plan``: rows of
    ``quotas``."""
    columns = [np.array(x, np.int64) for x in zip(*plan, strict=True)] if plan else [np.zeros(0, np.int64)] * 6
    number, _, _, _, _, quota = columns
    total = int(quota.sum())
    shape = "shard long, number int, drawn long"
    if not total:
        return spark.createDataFrame([], SLOT)
    share = quota / total
    shards = -(-total // shard_slots)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = np.random.default_rng([seed, shard]).multinomial(min(shard_slots, total - shard * shard_slots), share)
                some = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(np.full(len(some), shard)), pa.array(number[some].astype(np.int32)), pa.array(counts[some])], names=["shard", "number", "drawn"])

    drawn = materialise(spark.range(shards).mapInArrow(draw, shape), "drawn")
    got = dict(drawn.groupBy("number").agg(F.sum("drawn")).collect())
    taken = np.array([got.get(int(i), 0) for i in number], np.int64)
    above, short = np.maximum(taken - quota, 0), np.maximum(quota - taken, 0)
    start = lambda x: np.cumsum(x) - x
    # A row per source; joins of exploded rows state their strategy, as their estimated
    # size knows nothing of the rows that explode() adds.
    facts = spark.createDataFrame(
        list(zip(*(x.tolist() for x in (*columns, taken, start(above), short, start(short))), strict=True)),
        "number int, full long, blocks long, passes long, owed long, quota long, taken long, above_at long, short long, short_at long",
    )
    ranked = (
        running_total(drawn.withColumn("part", F.expr("shard div 1000")), "number", "part", ["shard"], "drawn", "first")
        .select("shard", "number", F.explode(F.expr("sequence(first, first + drawn - 1)")).alias("rank"))
        .join(_small(facts, len(plan)).select("number", "quota", "above_at"), "number")
    )
    kept = ranked.where("rank < quota").select("shard", "number", "rank")
    gaps = facts.where("short > 0").select(
        F.col("number"), "taken", "short_at", F.explode(F.expr("sequence(short_at, short_at + short - 1)")).alias("spare")
    ).select("number", F.expr("taken + spare - short_at").alias("rank"), "spare")
    moved = ranked.where("rank >= quota").select("shard", F.expr("above_at + rank - quota").alias("spare")).hint("merge").join(gaps, "spare").select("shard", "number", "rank")
    shape = ["full", "blocks", "passes", "owed"]
    ready = kept.unionByName(moved).join(_small(facts, len(plan)).select("number", *shape), "number").select("shard", "number", "rank", *shape)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rank, full, blocks, passes, owed = (batch.column(i).to_numpy().astype(np.int64) for i in range(1, 7))
            turn, at = rank // blocks, rank % blocks
            short, last = at >= full, turn == passes
            index = at - full
            index[~short] = permuted(at[~short], full[~short], (seed + source[~short]) * 1_000_003 + turn[~short])
            words = np.where(last & ~short, np.minimum(block_words, owed - at * block_words), block_words)
            limit = np.where(last, owed - full * block_words, np.int64(2**62))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(x) for x in (short, index, words, limit))],
                names=["shard", "number", "rank", "short", "index", "words", "limit"],
            )

    return ready.mapInArrow(place, SLOT)


def _wanted(mix: DataFrame, chunks: DataFrame) -> DataFrame:
    """The slots by the ``chunk`` that holds their block and its ``block`` in there."""
    full = chunks.where("full > 0").select("number", "chunk", "full_at", F.explode(F.expr("sequence(full_at, full_at + full - 1)")).alias("index"))
    full = mix.where("NOT short").hint("merge").join(full, ["number", "index"])
    full = full.select("number", "chunk", (F.col("index") - F.col("full_at")).alias("block"), "shard", "rank", "words")
    short = chunks.where("short > 0").select("number", F.col("chunk"), F.col("short_no").alias("index"), "full", F.col("short").alias("n"), "short_at")
    short = mix.where("short").hint("merge").join(short, ["number", "index"])
    cut = F.least("n", F.col("limit") - F.col("short_at"))
    return full.unionByName(short.select("number", "chunk", F.col("full").alias("block"), "shard", "rank", cut.alias("words")))


def _blocks(docs: DataFrame, mix: DataFrame, chunks: DataFrame, sources: DataFrame, count: int, block_words: int) -> DataFrame:
    """A row per slot of ``mix``: its ``text``, and the ``parts`` of rows in it."""
    kind = dict(docs.dtypes)["id"]

    def pack(key: tuple, rows: pa.Table, wanted: pa.Table) -> pa.Table:
        order = np.lexsort((rows["k2"].to_numpy(), rows["k1"].to_numpy()))
        words: list[bytes] = []
        ends = np.zeros(len(order), np.int64)
        for i, text in enumerate(utf8(rows["text"].take(pa.array(order)))):
            words += text.split()  # bytes: ASCII white space
            ends[i] = len(words)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        low = wanted["block"].to_numpy() * block_words
        high = low + wanted["words"].to_numpy()
        texts = [b" ".join(words[a:b]).decode("utf-8", "replace") for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left")
        n = last - first + 1
        offsets = np.concatenate(([0], np.cumsum(n)))
        row = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, n)
        begin, end = np.maximum(np.repeat(low, n), starts[row]), np.minimum(np.repeat(high, n), ends[row])
        fields = [rows["id"].take(pa.array(order[row])).combine_chunks()]
        fields += [pa.array(x) for x in (row, begin - starts[row], end - begin, begin - np.repeat(low, n))]
        parts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["id", "row", "skip", "words", "offset"]))
        named = {"shard": wanted["shard"], "number": wanted["number"], "chunk": wanted["chunk"], "block": wanted["block"], "rank": wanted["rank"]}
        return pa.table({**named, "parts": parts, "text": pa.array(texts, pa.string())})

    schema = f"shard long, number int, chunk long, block long, rank long, parts array<struct<id: {kind}, row: bigint, skip: bigint, words: bigint, offset: bigint>>, text string"
    dealt = _chunked(docs.where(F.col("text").rlike(WORD)), sources, count).select("number", "chunk", "id", "k1", "k2", "text")
    grouped = dealt.groupBy("number", "chunk").cogroup(_wanted(mix, chunks).groupBy("number", "chunk"))
    return grouped.applyInArrow(pack, schema)


def _prepared(docs, block_words, shard_slots, chunk_rows, seed, identity, text, source):
    """All rows with their place, the sources, their number, and the blocks of the mix."""
    keyed = _keyed(docs, identity, text, source)
    sizes = materialise(keyed.select("id", "source", "k1", "k2", F.size(words_of(F.col("text"))).cast("long").alias("size")), "sizes")
    by_words = F.ceil(F.col("source_size") / CHUNK_WORDS)
    sources = materialise(targets(sizes).withColumn("chunks", F.greatest(F.ceil(F.col("rows") / chunk_rows), by_words)), "sources")
    count = sources.count()
    rows = _chunked(sizes, sources, count)
    chunks = materialise(chunk_blocks(rows.where("size > 0"), block_words), "chunks")
    plan = [tuple(r) for r in quotas(chunks, sources, count, block_words).orderBy("number").collect()]
    mix = slots(docs.sparkSession, plan, block_words, shard_slots, seed)
    return rows, sources, count, _blocks(keyed, mix, chunks, sources, count, block_words)


def mixture(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    chunk_rows: int = CHUNK_ROWS,
    seed: int = SEED,
    identity: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document row: its id, ``size``, ``source_size``, ``target`` of its
    source, ``taken``, the words of it that the mix holds, repeats counted, and
    ``taken_hash``, a sum of hashes of these words as they stand in the mix.

    The mix is written to the shared folder, parts and texts; ``taken`` and
    ``taken_hash`` are read from it. Chunk and row in it tell rows apart."""
    rows, sources, count, blocks = _prepared(docs, block_words, shard_slots, chunk_rows, seed, identity, text, source)
    written = materialise(blocks, "mix")
    key = ["number", "chunk", "row"]
    part = written.select("number", "chunk", words_of(F.col("text")).alias("w"), F.explode("parts").alias("part")).select(
        "number", "chunk", "part.row", "part.skip", "part.words", F.slice("w", F.col("part.offset").cast("int") + 1, F.col("part.words").cast("int")).alias("own")
    )
    # 40 bits of each hash, so that the sum stays a long.
    hashed = F.shiftrightunsigned(F.xxhash64("skip", F.array_join("own", " ")), 24)
    taken = part.groupBy(*key).agg(F.sum("words").alias("taken"), F.sum(hashed).alias("taken_hash"))
    none = F.lit(0).cast("long")
    place = F.expr("row_number() OVER (PARTITION BY number, chunk ORDER BY k1, k2) - 1").cast("long")
    counted = rows.where("size > 0").withColumn("row", place).join(taken, key, "left").select("number", "id", "size", "taken", "taken_hash")
    empty = rows.where("size = 0").select("number", "id", "size", none.alias("taken"), none.alias("taken_hash"))
    return (
        counted.unionByName(empty)
        .join(_small(sources, count), "number")
        .select(F.col("id").alias(identity), "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("taken_hash", none).alias("taken_hash"))
    )


def mixed_blocks(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    chunk_rows: int = CHUNK_ROWS,
    seed: int = SEED,
    identity: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself, a row per slot: ``shard``, ``number`` of the source, ``chunk``
    and ``block`` in it, ``rank`` among the source's slots, ``parts`` (id, ``row`` in
    the chunk, words skipped, words taken, their offset in the text) and ``text``."""
    return _prepared(docs, block_words, shard_slots, chunk_rows, seed, identity, text, source)[3]
