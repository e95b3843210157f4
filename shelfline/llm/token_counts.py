"""Token counts in Arrow batches, lengths only.

White space ends a token in the given tokenizer and is dropped, so a text may be cut
at any ASCII white space without changing its count: the chunks between are the safe
pieces. A digit is a token of its own, so a long chunk is cut beside ASCII digits as
well, where the other side is an ASCII letter or digit. Chunks are encoded in library batches balanced by bytes, each distinct chunk
of a task once; a bounded memo keeps the lengths, and only they leave the task.

Defined results: a null text has no bytes and no tokens; a long run without white space
or such digits is encoded whole; rows are counted one by one, repeated or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import by_bytes, utf8

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of texts counted together, and bytes of chunks per call of the library.
TEXT_BYTES, CALL_BYTES = 4 << 20, 256 << 10
#: Bytes from which on a chunk is cut beside digits, and the least bytes of its parts.
LONG_CHUNK, PART = 64 << 10, 16 << 10
BESIDE_DIGIT = re.compile(rb"(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
#: Distinct chunks a task remembers, and the longest chunk that is remembered.
MEMO, MEMO_CHUNK = 400_000, 64


def parts(chunk: bytes) -> Iterator[bytes]:
    """A long chunk in parts whose counts add up to its own."""
    start = 0
    for cut in BESIDE_DIGIT.finditer(chunk):
        if cut.start() - start >= PART:
            yield chunk[start : cut.start()]
            start = cut.start()
    yield chunk[start:]


def chunks_of(text: bytes) -> list[bytes]:
    chunks = text.split()  # bytes: ASCII white space
    if len(text) >= LONG_CHUNK and max(map(len, chunks), default=0) >= LONG_CHUNK:
        return list(chain.from_iterable(parts(c) if len(c) >= LONG_CHUNK else (c,) for c in chunks))
    return chunks


def lengths(texts: Iterator[bytes], encode, memo: dict[bytes, int]) -> Iterator[int]:
    """Tokens of each text. ``encode`` gives the lengths of a list of chunks."""
    for run in by_bytes(texts, TEXT_BYTES):
        split = [chunks_of(text) for text in run]
        if len(memo) > MEMO:
            memo.clear()
        new = {chunk for chunks in split for chunk in chunks if chunk not in memo}
        long = {}
        for call in by_bytes(new, CALL_BYTES):
            for chunk, n in zip(call, encode([c.decode("utf-8", "replace") for c in call]), strict=True):
                (memo if len(chunk) <= MEMO_CHUNK else long)[chunk] = n
        known = memo | long if long else memo
        for chunks in split:
            yield sum(map(known.__getitem__, chunks))


def token_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs``' id columns aside from the text with ``n_bytes``, ``n_tokens`` and
    ``over_limit`` added. ``vocabulary``: path of a tokenizer file, found by name
    on the executors where not given."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def encode(chunks: list[str]) -> list[int]:
            return [len(e.ids) for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        memo: dict[bytes, int] = {}
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            column = batch.column(at)
            counts = pa.array(lengths(utf8(column), encode, memo), pa.int64())
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.record_batch([*kept, counts], names=[*(n for n in batch.schema.names if n != "__text"), "n_tokens"])

    added = ("n_bytes", "n_tokens", "over_limit", "__text")
    others = [c for c in docs.columns if c != text and c.lower() not in added]
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    inner = docs.select(*others, size.alias("n_bytes"), F.col(text).alias("__text"))
    fields = ", ".join(f"`{n}` {t}" for n, t in inner.dtypes if n != "__text")
    counted = inner.mapInArrow(task, f"{fields}, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
