"""Jaccard similarity join of documents over word n-grams, by blocked sparse products.

The incidence matrix (documents x n-grams) is cut into blocks of columns. Per column
block the columns of one document only are discarded, the others get their document
frequency. A document of n n-grams can only link if at least need(n) = ceil(t * n) of
its columns are shared at all; of those it keeps the rarest, c - need(n) + 1 of them:
two linked documents share one of the kept columns (size-derived bounds).

The product over the kept columns is taken in three steps. First every document is
multiplied with two pivots of each of its columns, which links groups of near-copies
in one go. Columns whose documents are then connected are done. For the others the
products between different components are counted: where they are few for the members
of a column, they are listed as pairs; otherwise the column's documents are dealt as
pairs of row blocks, and a task accumulates the overlap counts of two blocks. A pair
is discarded where its overlap is below t / (1 + t) of the summed sizes.

Documents with the same set are one node throughout; in the matrix, copies in several
row blocks count once while the keys of all copies are few enough to be broadcast. A column that many documents of
one batch share is marked as hot there: it is sent once a batch, not once a document,
and comes last in the order of all columns, so no task gathers its documents.

N-grams and sets are told apart by 64-bit hashes. Two different n-grams of a pair of
documents with 20,000 words each collide with a probability below 3e-11.

Defined results: null texts and texts without a word have no n-grams and link with
nothing, their component is their own id; a text of fewer than ``shingle`` words has
one; a row without an id takes part, its component is the smallest id reachable (null
if none); repeated rows give repeated results. Columns aside from id and text are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import by_bytes, row_key, utf8
from shelfline.llm.components import components
from shelfline.sources.storage import materialise

#: Words of an n-gram, and the least similarity in per cent.
SHINGLE, PERCENT = 5, 80
#: Bytes of texts that form one row block, and of n-grams that form one column block.
ROW_BYTES, COLUMN_BYTES = 8 << 20, 8 << 20
#: Documents of one row block from which on a column they share is hot.
HOT = 32
#: Listed pairs per member of a column; a column with more is multiplied in blocks.
LISTED = 64
#: Documents in a row block of such a column.
BLOCK = 512
#: Documents of a row block at most, and what their positions are written as.
OWNERS, OWNER = 1 << 16, np.uint16
#: Documents that may be broadcast when their texts are read again (24 bytes each).
BROADCAST_ROWS = 500_000
#: Words whose hash a task remembers.
MEMO = 400_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def ngrams(text: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(hashes) > MEMO:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    # The length enters the hash, so a short text never equals an n-gram.
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = mixed * MULTIPLIER + h[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * FINAL
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a document of ``n`` n-grams with any that it links to."""
    return -(-percent * n // 100)


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _six(values: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each: steps from one to the next, lowest bytes first. The
    steps of sorted numbers are small, so their high bytes are runs of zeros for the shuffle's codec."""
    steps = np.diff(values.astype("<u8"), prepend=np.uint64(0))
    return _blob(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(6, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64) & np.uint64((1 << 48) - 1)


def _block_of(token: np.ndarray, blocks: int) -> np.ndarray:
    """Column block of each column: a range of the hashes, so its columns lie close together."""
    return ((token >> np.uint64(16)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    if len(values):
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)


def _sets(docs: DataFrame, shingle: int, identity: str, text: str, blob: bool) -> DataFrame:
    """Per row its key, its node (null without n-grams), ``n``, and the set as a blob if asked for."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, nodes, blobs = [], [], []
            for value in utf8(batch.column(2)):
                grams = ngrams(value, shingle, hashes)
                sizes.append(len(grams))
                nodes.append(_node(grams) if len(grams) else None)
                if blob:
                    blobs.append(grams.tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())]
            names = ["__id", "__hash", "node", "n"]
            if blob:
                columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "grams"]
            yield pa.record_batch(columns, names=names)

    source = docs.select(F.col(identity).cast("long").alias(identity), F.col(text).alias(text))
    keyed = source.select(*row_key(identity, text), F.col(text).alias("text"))
    return keyed.mapInArrow(task, "__id long, __hash long, node long, n long" + (", grams binary" if blob else ""))


def _column_blocks(docs: DataFrame, shingle: int, percent: int, text: str, blocks: int, hot: int) -> DataFrame:
    """The incidence matrix by (row block, column block). A column is the first 48 bits
    of an n-gram's hash, ``run`` a hash of the row block's nodes, ``owner`` a document's
    position among them: an entry takes the same bytes however many column blocks there are.
    ``token`` and ``owner`` have a value per entry, ``hot`` the columns marked here. Blocks above
    ``blocks`` pass on what only the row block itself needs again: ``node`` and ``least`` of
    its documents, and the entries of its hot columns."""

    def rows(run: list[bytes], hashes: WordHashes) -> Iterator[tuple]:
        nodes, least, parts = [], [], []
        seen = set()
        for value in run:
            grams = ngrams(value, shingle, hashes)
            node = _node(grams) if len(grams) else None
            if node is None or node in seen:
                continue
            seen.add(node)
            tokens = np.unique(grams >> np.uint64(16))
            nodes.append(node)
            # n-grams that fell together in 48 bits may all have been shared
            least.append(need(len(grams), percent) - (len(grams) - len(tokens)))
            parts.append(tokens)
        if not parts:
            return
        token = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts), dtype=OWNER), [len(p) for p in parts])
        node, least = np.array(nodes, np.int64), np.array(least, np.int64)
        name = _node(node)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        _, first, times = np.unique(token, return_index=True, return_counts=True)
        many = np.repeat(times >= hot, times)
        marked = token[first[times >= hot]]
        yield blocks + name % blocks, name, _blob(node), _blob(least), _blob(owner[many]), _six(token[many]), b""
        token, owner = token[~many], owner[~many]
        place, home = _block_of(token, blocks), _block_of(marked, blocks)
        for a, b in _runs(place):
            yield int(place[a]), name, b"", b"", _blob(owner[a:b]), _six(token[a:b]), _six(marked[home == place[a]])
        for p in np.setdiff1d(home, place):
            yield int(p), name, b"", b"", b"", b"", _six(marked[home == p])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        texts = (value for batch in batches for value in utf8(batch.column(0)))
        for run in by_bytes(texts, ROW_BYTES):
            for start in range(0, len(run), OWNERS):
                found = list(rows(run[start : start + OWNERS], hashes))
                if found:
                    columns = list(zip(*found, strict=True))
                    arrays = [pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(c, pa.binary()) for c in columns[2:]]
                    yield pa.record_batch(arrays, names=["place", "run", "node", "least", "owner", "token", "hot"])

    schema = "place long, run long, node binary, least binary, owner binary, token binary, hot binary"
    return docs.select(text).mapInArrow(task, schema)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _tokens(table: pa.Table, name: str = "token") -> list[np.ndarray]:
    return [_from_six(b) for b in table[name].to_pylist()] or [np.empty(0, np.uint64)]


#: Frequency that stands for hot columns: above any that is counted.
HOTTEST = np.int32(2**31 - 1)


def _shared(blocks_table: DataFrame, blocks: int) -> DataFrame:
    """What a row block gets back: its entries of columns that have another entry elsewhere, with the
    columns' frequencies, and what was passed on. Copies of a document in several row blocks count
    each; that changes the order of columns, for all documents alike, and keeps some more."""

    def task(key: tuple, table: pa.Table) -> pa.Table:
        tokens = _tokens(table)
        token = np.concatenate(tokens)
        if key[0].as_py() >= blocks:
            frequency = np.full(len(token), HOTTEST)
        else:
            hot = np.unique(np.concatenate(_tokens(table, "hot")))
            _, at, times = np.unique(token, return_inverse=True, return_counts=True)
            frequency = np.minimum(times[at], HOTTEST - 1).astype(np.int32)
            frequency[np.isin(token, hot)] = HOTTEST
        out, start = [], 0
        for row, own in zip(table.select(["run", "node", "least", "owner"]).to_pylist(), tokens, strict=False):
            often = frequency[start : start + len(own)]
            start += len(own)
            kept = often > 1
            if row["node"] or kept.any():
                owner = np.frombuffer(row["owner"], OWNER)[kept]
                out.append((row["run"], row["node"], row["least"], _blob(owner), _six(own[kept]), _blob(often[kept])))
        columns = list(zip(*out, strict=True)) or [()] * 6
        arrays = [pa.array(columns[0], pa.int64())] + [pa.array(c, pa.binary()) for c in columns[1:]]
        return pa.table(arrays, names=["run", "node", "least", "owner", "token", "frequency"])

    schema = "run long, node binary, least binary, owner binary, token binary, frequency binary"
    return blocks_table.groupBy("place").applyInArrow(task, schema)


def _kept_columns(shared: DataFrame) -> DataFrame:
    """``token`` and ``node``: the rarest c - least + 1 shared columns of every document with
    c >= least of them. A document copied to several row blocks has its rows several times."""

    def task(table: pa.Table) -> pa.Table:
        # row blocks of one name have the same documents in the same order
        heads = [(n, x) for n, x in zip(table["node"].to_pylist(), table["least"].to_pylist(), strict=True) if n]
        nodes, needs = (np.frombuffer(blob, np.int64) for blob in heads[0])
        owner, token = _joined(table, "owner", OWNER), np.concatenate(_tokens(table))
        frequency = _joined(table, "frequency", np.int32)
        order = np.lexsort((token, frequency, owner))
        owner, token = owner[order], token[order]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        owner, token = owner[once], token[once]
        _, starts, count = np.unique(owner, return_index=True, return_counts=True)
        rank = np.arange(len(owner)) - np.repeat(starts, count)
        kept = rank <= np.repeat(count, count) - needs[owner]
        return pa.table({"token": token[kept].view(np.int64), "node": nodes[owner[kept]]})

    return shared.groupBy("run").applyInArrow(task, "token long, node long")


def _first_copies(docs: DataFrame, rows: DataFrame, identity: str, text: str) -> DataFrame:
    """``docs`` without rows whose set an earlier row has, if these are few enough to be broadcast."""
    least = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("__id", "__hash")).alias("row"), F.count("*").alias("copies"))
    again = rows.join(least.where("copies > 1"), "node").where(~F.struct("__id", "__hash").eqNullSafe(F.col("row")))
    again = materialise(again.select("__id", "__hash").distinct(), "ngram-copies")
    if again.count() > BROADCAST_ROWS:
        return docs
    return _rows_of(docs, F.broadcast(again), identity, text, "left_anti")


def _rows_of(docs: DataFrame, keys: DataFrame, identity: str, text: str, how: str) -> DataFrame:
    """The rows of ``docs`` that have one of ``keys`` (``left_semi``) or none (``left_anti``)."""
    source = docs.select(F.col(identity).cast("long").alias(identity), F.col(text).alias(text))
    key = [c.alias(n) for c, n in zip(row_key(identity, text), ("k_id", "k_hash"), strict=True)]
    same = F.col("k_id").eqNullSafe(F.col("__id")) & (F.col("k_hash") == F.col("__hash"))
    return source.select(*key, identity, text).join(keys, same, how)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes that link, from their whole sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            kept = []
            for x, y in zip(left, right, strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                overlap = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                kept.append(bool(linked(overlap, len(x), len(y), percent)))
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("left"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("right"))
    sizes = pairs.join(a.drop("left"), "a").join(b.drop("right"), "b")
    sized = sizes.where(F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100).select("a", "b")
    return sized.join(a, "a").join(b, "b").select("a", "b", "left", "right").mapInArrow(task, "a long, b long")


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links among ``sets``: overlap counts are
    accumulated column by column into the product of the block with itself."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    overlap = np.zeros((len(sets), len(sets)), np.int32)
    for a, b in _runs(token):
        if b - a > 1:
            here = owner[a:b]
            overlap[here[:, None], here] += 1
    links = linked(overlap, size[:, None], size, percent)
    edges, rest = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if rest[start]:
            rest[start], front = False, [start]
            while front:
                u = front.pop()
                found = np.flatnonzero(links[u] & rest).tolist()
                rest[found] = False
                edges += [(u, v) for v in found]
                front += found
    return edges


def _block_products(columns: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links among the documents of each column of ``columns`` (``token``, ``node``,
    ``members``), found per pair of row blocks."""
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(F.least(k, own).alias("r"), F.greatest(k, own).alias("c")),
    )
    tiled = columns.select("token", "node", F.inline(tiles)).join(sets.select("node", "grams"), "node")

    def task(key: tuple, table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        found = block_links([np.frombuffer(g.as_buffer(), np.uint64) for g in table["grams"]], percent)
        a, b = (np.array([e[k] for e in found], np.int64) for k in (0, 1))
        return pa.table({"a": node[a], "b": node[b]})

    return tiled.groupBy("token", "r", "c").applyInArrow(task, "a long, b long").distinct()


def links(index: DataFrame, sets: DataFrame, percent: int = PERCENT, listed: int = LISTED, block: int = BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` that connect all documents linked through a shared column.
    ``index``: ``token``, ``node`` of the kept columns; ``sets``: ``node``, ``n``, ``grams``."""
    shared = index.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    pivot = F.explode(F.array("low", "high")).alias("pivot")
    spokes = index.join(shared, "token").select("node", pivot).where("node <> pivot")
    pairs = spokes.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    first = materialise(_verified(pairs, sets, percent), "pivot-links")

    component = components(first)
    named = index.join(component, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("token", "component").count()
    square = F.sum(F.col("count") * F.col("count"))
    open_columns = sizes.groupBy("token").agg(
        F.sum("count").alias("members"), ((F.sum("count") * F.sum("count") - square) / 2).alias("pairs")
    )
    rest = materialise(named.join(open_columns.where("pairs > 0"), "token"), "open-columns")

    few = F.col("pairs") <= F.col("members") * listed
    x = rest.where(few).select("token", F.col("node").alias("a"), F.col("component").alias("p"))
    y = rest.where(few).select("token", F.col("node").alias("b"), F.col("component").alias("q"))
    apart = x.join(y, "token").where("a < b and p <> q").select("a", "b").distinct()
    second = _verified(apart, sets, percent)
    third = _block_products(rest.where(~few).select("token", "node", "members"), sets, percent, block)
    return first.unionByName(second).unionByName(third)


def similarity_classes(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    identity: str = "doc_id",
    text: str = "text",
    hot: int = HOT,
    listed: int = LISTED,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document row: ``id``, ``n`` (its distinct n-grams) and ``component``,
    the smallest id that links of ``percent`` or more Jaccard similarity reach."""
    rows = materialise(_sets(docs, shingle, identity, text, blob=False), "ngram-rows")
    entries = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(16, -(-entries * 8 // COLUMN_BYTES))
    once = _first_copies(docs, rows, identity, text)
    shared = _shared(_column_blocks(once, shingle, percent, text, blocks, hot), blocks)
    index = materialise(_kept_columns(shared), "ngram-index")

    # The sets of candidate documents alone are made again, from one row of each.
    several = index.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    candidates = index.join(several.select("token"), "token").distinct()
    wanted = rows.join(candidates.select("node").distinct(), "node", "left_semi")
    one = wanted.groupBy("node").agg(F.min(F.struct("__id", "__hash")).alias("row")).select("row.*")
    one = materialise(one, "ngram-candidates")
    if one.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    found = _rows_of(docs, one, identity, text, "left_semi")
    sets = _sets(found, shingle, identity, text, blob=True).groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = materialise(sets, "ngram-sets")

    component = components(links(materialise(candidates.select("token", "node"), "ngram-columns"), sets, percent, listed, block))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("__id").alias("least"))
    labelled = nodes.join(component, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = labelled.join(smallest, "root").select("node", "component")
    alone = rows.where("node is null").withColumn("component", F.col("__id"))
    return rows.join(named, "node").unionByName(alone).select(F.col("__id").alias("id"), "n", "component")
