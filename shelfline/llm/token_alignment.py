"""Alignment of two tokenizers' tokens over the same bytes, by merge-path partitioning.

Both tokenizers cut the bytes of a space and the text. Their token ends, A's and B's,
are two sorted lists; walking their merge meets every overlap of an A and a B token,
and an end that both share closes a group. The merge of all tokens of a run of texts is
one path, whatever the lengths of the texts: diagonals at equal steps of work are
searched for the point where the path crosses them, and each piece between two of them
is walked on its own. A piece emits the overlaps that end in it and the shared ends;
groups are stitched from the shared ends of all pieces, as a group may span several.

Texts are encoded and aligned in chunks that start at a space after a character that is no white
space. No token of either vocabulary has a space after such a character, so none
crosses such a cut (checked when the vocabularies are loaded; without that property
texts are encoded whole). A chunk met before is not aligned again: a document's groups
are those of its chunks in turn.

How often two ids are linked is summed over the whole corpus, per document before any
shuffle; the counts are joined back by broadcast while their number is below
``BROADCAST_PAIRS``, beyond it by a shuffle on the pair.

Defined results: null and empty texts and texts whose joined token bytes of A or B
differ from a space and the text have no tokens: all numbers are zero, lists and
digest are empty. Repeated rows are counted as often as they occur and get equal
results; a null id stays null. Columns aside from id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import by_bytes, utf8
from shelfline.sources.storage import materialise

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts whose merge is one path, ends that one piece of it merges, and chunks remembered.
RUN_BYTES, PIECE, MEMO = 4 << 20, 16_384, 500_000
#: Characters of chunks remembered, and chunks per call of the libraries.
MEMO_BYTES, CALL = 16 << 20, 1000
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
#: Linked id pairs that may be broadcast, 16 bytes each.
BROADCAST_PAIRS = 2_000_000

#: A space after white space, where no chunk starts; Python's notion of white space includes both tokenizers'.
UNCUT = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")


# --- tokens -------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for the bytes in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the other bytes from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Ids and byte lengths of both tokenizers' tokens of a text with a space before it."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = np.array([len(t) for t in self.bytes_a])
        self.size_b = np.array([len(t) for t in self.bytes_b])
        self.cuttable = not any(CUT.search(t.decode("utf-8", "replace")) for t in chain(self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of chunks (their first space left out); none where bytes are not given back."""
        for at in range(0, len(chunks), CALL):
            call = chunks[at : at + CALL]
            spaced = [" " + c for c in call]
            all_a = self.a.encode_batch_fast(spaced, add_special_tokens=False)
            for chunk, whole, a, b in zip(call, spaced, all_a, self.b.encode(call, num_threads=1), strict=True):
                a = a.ids
                if not chunk:  # the library adds its space to a text that has something in it only
                    b = [self.b.piece_to_id("▁")]
                plain = whole.encode()
                same = b"".join([self.bytes_a[i] for i in a]) == plain and b"".join([self.bytes_b[i] for i in b]) == plain
                yield (a, b) if same else ([], [])

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each without the space it starts with."""
        if not text:
            return []
        if not self.cuttable:
            return [text]
        # the space that is put before the text is the first chunk's, so it is no place to cut
        return CUT.split(text) if UNCUT.search(" " + text) else text.split(" ")


# --- merge path ---------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> np.ndarray:
    """Where the merge path of two sorted lists crosses every ``piece``-th diagonal and
    the last: how many of ``a`` lie before it. On a tie, a's element comes first.
    All diagonals are searched at once."""
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        i = np.where(open_, middle, 0)
        j = np.where(open_, at - 1 - middle, 0)
        # a[i] belongs before the crossing while it is not above b[j]
        before = open_ & (a[np.minimum(i, len(a) - 1)] <= b[np.clip(j, 0, len(b) - 1)])
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


def walk(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[np.ndarray, ...]:
    """One piece: the ends a[a0:a1] and b[b0:b1] merged. Every end closes an overlap of
    the A and the B token that are open there. Returns per overlap the A token, the B
    token, its end, and whether both end there."""
    ends = np.concatenate((a[a0:a1], b[b0:b1]))
    order = np.argsort(ends, kind="stable")
    from_a = order < a1 - a0
    ends = ends[order]
    i = a0 + np.cumsum(from_a) - from_a  # open tokens before each end
    j = b0 + np.cumsum(~from_a) - ~from_a
    # b's end equal to the a's end before it closes nothing more: that overlap is closed
    previous = a[np.maximum(i - 1, 0)]
    again = ~from_a & (i > 0) & (previous == ends)
    kept = ~again
    i, j, ends = i[kept], j[kept], ends[kept]
    both = (a[i] == ends) & (b[j] == ends)
    return i, j, ends, both


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Overlaps of the tokens that end at ``a`` and ``b`` (both rising, with the same
    last end): A token, B token, end, and whether the two end together."""
    i = diagonals(a, b, piece)
    j = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b)) - i
    pieces = [walk(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)]
    if not pieces:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, bool))
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


class Alignment:
    """Units of tokens that follow each other on one merge path. The end of each unit is
    an end of both lists, so groups and overlaps never span two units. ``units``: ids of
    A and B, of the same bytes."""

    def __init__(self, units: list[tuple[list[int], list[int]]], tokenizers: Tokenizers, piece: int):
        self.ids_a = np.fromiter(chain.from_iterable([a for a, _ in units]), np.int64)
        self.ids_b = np.fromiter(chain.from_iterable([b for _, b in units]), np.int64)
        self.last_a = np.cumsum([len(a) for a, _ in units], dtype=np.int64)
        self.last_b = np.cumsum([len(b) for _, b in units], dtype=np.int64)
        self.a, self.b, _, self.both = align(np.cumsum(tokenizers.size_a[self.ids_a]), np.cumsum(tokenizers.size_b[self.ids_b]), piece)
        # stitching: a group runs from one shared end to the next, whichever pieces found them
        self.group_a, self.group_b = self.a[self.both] + 1, self.b[self.both] + 1
        self.pairs = (self.ids_b[self.b[self.both]] << 32) + self.ids_a[self.a[self.both]]
        self.groups = np.searchsorted(self.group_a, self.last_a, side="right")  # groups up to the end of each unit

    def texts(self) -> list[str]:
        """The groups of each unit as ``a1,a2|b1;a3|b2,b3``."""
        a, b = list(map(str, self.ids_a.tolist())), list(map(str, self.ids_b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(self.group_a.tolist(), self.group_b.tolist(), strict=True):
            groups.append(",".join(a[i:x]) + "|" + ",".join(b[j:y]))
            i, j = x, y
        ends = self.groups.tolist()
        return [";".join(groups[x:y]) for x, y in zip([0, *ends], ends, strict=False)]


class ChunkTable:
    """The alignment of every distinct chunk a task has met, by number."""

    def __init__(self, tokenizers: Tokenizers, piece: int):
        self.tokenizers, self.piece = tokenizers, piece
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.sizes = np.empty((0, 3), np.int64)  # tokens of A, tokens of B, groups
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.empty(0, np.int64)
        self.held = 0

    def _add(self, chunks: list[str]) -> None:
        units = list(self.tokenizers.encode(chunks))
        found = Alignment(units, self.tokenizers, self.piece)
        self.number.update(zip(chunks, range(len(self.text), len(self.text) + len(chunks)), strict=True))
        self.text += found.texts()
        sizes = np.stack([np.diff(x, prepend=0) for x in (found.last_a, found.last_b, found.groups)], axis=1)
        self.sizes = np.concatenate((self.sizes, sizes))
        self.starts = np.concatenate((self.starts, self.starts[-1] + found.groups))
        self.pairs = np.concatenate((self.pairs, found.pairs))
        self.held += sum(map(len, chunks))

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """Of each text: ``NUMBERS``, the digest, its distinct pairs and their counts."""
        if len(self.text) > MEMO or self.held > MEMO_BYTES:
            self._clear()
        split = [self.tokenizers.chunks(t) for t in texts]
        new = list({c for chunks in split for c in chunks if c not in self.number})
        if new:
            self._add(new)
        for chunks in split:
            numbers = list(map(self.number.__getitem__, chunks))
            sizes = self.sizes[numbers]
            if not chunks or not sizes[:, 0].all():
                yield 0, 0, 0, 0, "", [], []
                continue
            a, b, groups = sizes.sum(axis=0).tolist()
            digest = hashlib.sha256(";".join([self.text[i] for i in numbers]).encode()).hexdigest()
            each, times = np.unique(numbers, return_counts=True)
            first, count = self.starts[each], self.sizes[each, 2]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pairs, place = np.unique(self.pairs[np.repeat(first, count) + offset], return_inverse=True)
            yield a, b, groups, groups, digest, pairs, np.bincount(place, np.repeat(times, count)).astype(np.int64)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    return path_a, path_b


def overlaps(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, identity: str = "doc_id", text: str = "text", piece: int = PIECE
) -> DataFrame:
    """Every overlap of an A and a B token: ``id``, positions ``a`` and ``b`` in the
    document, ids ``a_id`` and ``b_id``, and ``together`` where both end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizers = Tokenizers(*_paths(path_a, path_b))
        for batch in batches:
            done = 0
            for run in by_bytes(utf8(batch.column(1)), RUN_BYTES):
                units = []
                for value in run:
                    ids = list(tokenizers.encode(tokenizers.chunks(value.decode("utf-8", "replace"))))
                    whole = all([a for a, _ in ids])
                    units.append(tuple(list(chain.from_iterable([x[k] for x in ids])) if whole else [] for k in (0, 1)))
                found = Alignment(units, tokenizers, piece)
                unit = np.searchsorted(found.last_a, found.a, side="right")
                first_a, first_b = (np.concatenate(([0], x[:-1])) for x in (found.last_a, found.last_b))
                columns = [
                    batch.column(0).slice(done, len(run)).take(pa.array(unit)),
                    *(pa.array(x) for x in (found.a - first_a[unit], found.b - first_b[unit])),
                    *(pa.array(x) for x in (found.ids_a[found.a], found.ids_b[found.b], found.both)),
                ]
                done += len(run)
                yield pa.record_batch(columns, names=["id", "a", "b", "a_id", "b_id", "together"])

    schema = "id long, a long, b long, a_id long, b_id long, together boolean"
    return docs.select(F.col(identity).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(task, schema)


def alignments(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, identity: str = "doc_id", text: str = "text", piece: int = PIECE
) -> DataFrame:
    """A row per document: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups_sha256``, its distinct linked id pairs with their counts, and ``row``, a
    random number that with the id tells rows apart once they are written."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = ChunkTable(Tokenizers(*_paths(path_a, path_b)), piece)
        for batch in batches:
            done = 0
            for run in by_bytes(utf8(batch.column(1)), RUN_BYTES):
                texts = [t.decode("utf-8", "replace") for t in run]
                rows = [(random.getrandbits(63), *d) for d in known.documents(texts)]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                arrays = [batch.column(0).slice(done, len(rows))] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                done += len(rows)
                yield pa.record_batch(arrays, names=["id", "row", *NUMBERS, "groups_sha256", "pairs", "counts"])

    schema = "id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"
    return docs.select(F.col(identity).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(task, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` (B id * 2^32 + A id), ``total`` links over all documents, ``best``: no A
    id is linked to that B id more often."""
    listed = aligned.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("counts").alias("n"))))
    totals = listed.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.shiftright("pair", 32))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def token_alignment(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    identity: str = "doc_id",
    text: str = "text",
    piece: int = PIECE,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``alignments`` without the pairs, with ``n_best`` (links whose pair is the most
    frequent of its B id) and ``count_sum`` (corpus-wide counts summed over links)."""
    aligned = materialise(alignments(docs, path_a, path_b, identity, text, piece), "alignments")
    counted = materialise(pair_counts(aligned), "pair-counts")
    if counted.count() <= broadcast_pairs:
        counted = F.broadcast(counted)
    pairs = F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("counts").alias("n")))
    summed = (
        aligned.select("row", F.col("id").alias("key"), pairs)
        .join(counted, "pair")
        .groupBy("row", "key")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
        .withColumnRenamed("row", "key_row")
    )
    joined = aligned.drop("pairs", "counts").join(summed, (F.col("row") == F.col("key_row")) & F.col("id").eqNullSafe(F.col("key")), "left")
    return joined.select(
        "id",
        *NUMBERS,
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
