"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is cut into ``distance + 1`` segments on a ring. If two fingerprints
differ in at most ``distance`` bits, then some segment starts a chain of which every
prefix of l segments differs in at most floor(l * distance / segments) bits: its first
segment is equal, its first two differ in at most one bit in all, and so on.
Fingerprints are grouped by such a first segment and by one half of the second, one
of whose halves must be equal as well (one bit cannot change both). Inside a group
the chain is checked prefix by prefix before the full Hamming distance.

Only distinct fingerprints are compared, and a group returns a spanning forest of its
links instead of its pairs. A group of more than ``block`` fingerprints is dealt as
pairs of blocks to several tasks, so no task ever holds more than two blocks.

Defined results: null and empty texts have fingerprint zero, linked like any other;
a row without an id takes part in linking and its component is the smallest id
reachable from it (null if none); repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import key_side, row_key, same_row, utf8
from shelfline.llm.components import components
from shelfline.sources.storage import materialise

SHINGLE, DISTANCE, SEED = 3, 3, 42
BITS = 64
#: Fingerprints of a group that one task compares with those of another block.
BLOCK = 4096
#: Shingles whose bits are added up at once; bounds memory for very long texts.
AT_ONCE = 65_536


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, AT_ONCE):
        spans = zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE], strict=True)
        h = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``hash`` of the text, and ``fp`` (the fingerprint's bits as a signed long) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t, shingle) for t in utf8(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bits.view(np.int64))], names=["id", "hash", "fp"])

    key = [c.alias(n) for c, n in zip(row_key(identity, text), ("id", "hash"), strict=True)]
    rows = docs.select(F.col(identity).cast("long").alias(identity), F.col(text).alias(text))
    return rows.select(*key, F.col(text).alias("text")).mapInArrow(task, "id long, hash long, fp long")


def _segments(distance: int) -> tuple[int, int]:
    n = distance + 1
    if BITS % (2 * n):
        raise ValueError("the bits of a fingerprint do not divide into distance + 1 segments of two halves")
    return n, BITS // n


def _groups(fps: DataFrame, distance: int) -> DataFrame:
    """A row per fingerprint, ring position and half of the next segment: ``at`` and
    ``part``, the bits that both members of a candidate pair must share."""
    n, width = _segments(distance)
    half, mask = width // 2, (1 << width // 2) - 1
    keys = []
    for i in range(n):
        first = F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))
        for j in range(2):
            second = F.shiftrightunsigned("fp", (i + 1) % n * width + j * half).bitwiseAND(F.lit(mask))
            keys.append(F.struct(F.lit(2 * i + j).alias("at"), (first * (1 << half) + second).alias("part")))
    return fps.select("fp", "node", F.inline(F.array(*keys)))


def chain_links(a: np.ndarray, b: np.ndarray, at: int, distance: int) -> np.ndarray:
    """Which pairs of fingerprints pass the chain that starts at ring segment ``at``
    and then the full Hamming check. ``a`` and ``b`` broadcast against each other."""
    n, width = _segments(distance)
    differ = a ^ b
    ok = np.ones(differ.shape, bool)
    total = np.zeros(differ.shape, np.uint8)
    for step in range(n):
        shift = np.uint64((at + step) % n * width)
        total += np.bitwise_count((differ >> shift) & np.uint64((1 << width) - 1))
        ok &= total <= (step + 1) * distance // n
        if not ok.any():
            break
    return ok


def forest(fp: np.ndarray, at: int, distance: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links among ``fp``: a breadth-first
    search that compares each fingerprint with those not reached yet only."""
    edges, rest = [], np.arange(len(fp))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            u = front.pop()
            near = chain_links(fp[u], fp[rest], at, distance)
            if near.any():
                found = rest[near].tolist()
                edges += [(u, v) for v in found]
                front += found
                rest = rest[~near]
    return edges


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` between nodes that connect all fingerprints at ``distance``
    or fewer bits. ``fps``: distinct ``fp`` with their ``node`` ids."""
    grouped = _groups(fps, distance)
    sizes = grouped.groupBy("at", "part").count().where("count > 1")
    # Members of a large group go to every pair of blocks that holds their own block.
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(F.least(k, own).alias("r"), F.greatest(k, own).alias("c")),
    )
    tiled = grouped.join(sizes, ["at", "part"]).select("fp", "node", "at", "part", F.inline(tiles))

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        fp, node = frame["fp"].to_numpy().view(np.uint64), frame["node"].to_numpy()
        pairs = forest(fp, int(key[0]) // 2, distance)
        u, v = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return pd.DataFrame({"a": node[u], "b": node[v]}, dtype="int64")

    return tiled.groupBy("at", "part", "r", "c").applyInPandas(task, "a long, b long").distinct()


def _labelled(docs: DataFrame, shingle: int, distance: int, identity: str, text: str, block: int) -> DataFrame:
    """``id``, ``hash``, ``fp`` and ``root`` of every row: rows that links connect share a root."""
    rows = materialise(fingerprints(docs, shingle, identity, text), "fingerprints")
    # A fingerprint is a node itself and stands for all its copies.
    nodes = rows.select("fp", F.col("fp").alias("node")).distinct()
    found = components(links(materialise(nodes, "nodes"), distance, block))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("root"))
    return rows.join(roots, "fp").select("id", "hash", "fp", "root")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    identity: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per document row: ``id``, ``fp`` and ``component``, the smallest id
    that links of ``distance`` or fewer differing bits reach."""
    rows = materialise(_labelled(docs, shingle, distance, identity, text, block), "labelled")
    least = rows.groupBy("root").agg(F.min("id").alias("component"))
    return rows.join(least, "root").select("id", "fp", "component")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id (rows without an
    id last; of equal ids that with the smallest text hash), once if it is repeated.

    Only rows that go, or are repeated, are joined with the texts."""
    rows = materialise(_labelled(docs, shingle, distance, identity, text, BLOCK), "labelled")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "hash")
    kept = rows.groupBy("root").agg(F.min(order).alias("kept")).select("root", F.col("kept.id").alias("k_id"), F.col("kept.hash").alias("k_hash"))
    marked = rows.join(kept, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
    keys = marked.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n"))
    odd = materialise(keys.where("NOT stays OR n > 1"), "not-kept")
    id_now, hash_now = row_key(identity, text)
    keyed = docs.select("*", id_now.cast("long").alias("__id"), hash_now)
    gone, repeated = key_side(odd), odd.where("stays")
    single = keyed.join(gone, same_row(keyed, gone), "left_anti")
    if repeated.isEmpty():
        return single.select(*docs.columns)
    side = key_side(repeated)
    once = keyed.join(side, same_row(keyed, side), "left_semi").dropDuplicates(["__id", "__hash"])
    return single.unionByName(once).select(*docs.columns)
