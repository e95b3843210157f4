import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from shelfline.llm import token_alignment as t
from tokenizers import Tokenizer

A = Tokenizer.from_file(P.path(t.VOCABULARY_A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path(t.VOCABULARY_B))
ALPHABET = t.byte_alphabet()


def tokens(text):
    """[(id, bytes)] of both tokenizers, of the whole text at once; none where bytes differ."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    a = [(i, bytes(ALPHABET[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    same = all(b"".join(x for _, x in side) == whole for side in (a, b))
    return (a, b) if same else ([], [])


def ranges(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute_force(rows):
    per, counts = [], Counter()
    for i, text in rows:
        a, b = map(ranges, tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(k) for k, _, z in side if start < z <= e) for side in (a, b)))
            start = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        counts.update(links)
        per.append((i, len(a), len(b), len(groups), links, digest))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return sorted(
        [
            (i, na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest)
            for i, na, nb, ng, links, digest in per
        ],
        key=repr,
    )


TEXTS = [
    None,
    "",
    " ",
    "  ",
    "a",
    "abc ",
    " abc",
    "  abc  def   g ",
    "line one\nline two\n\n  indented\tcell \r\n end\n",
    "don't   we'll   ",
    "nbsp\xa0 here   wide \x1c sep \x85 nel",
    "literal ▁ block ▁▁x",
    "<|endoftext|> </s> <s><unk> <0x41>",
    "Zürich 東京 здравствуйте 👩‍👩‍👧 é é ½",
    "\x00 nul \x07",
    "x" * 5000,
    " " * 3000,
    "word " * 3000,
    "The quick brown fox; 12,345.67 + 89 == x[0] ... `code`",
]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ID", F.lit("x")).withColumn("row", F.lit(1)).withColumn("pairs", F.lit(2))


@pytest.mark.parametrize("piece", [3, t.PIECE])
@pytest.mark.parametrize("broadcast", [0, t.BROADCAST_PAIRS])
def test_equals_brute_force(spark, piece, broadcast):
    rows = list(enumerate(TEXTS)) + [(4, "a"), (4, "a"), (None, "abc "), (None, None), (4, "another text")]
    out = t.token_alignment(table(spark, rows).repartition(3), piece=piece, broadcast_pairs=broadcast)
    assert out.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_force(rows)


def test_empty_table(spark):
    assert t.token_alignment(table(spark, [])).collect() == []


def test_chunks_give_the_ids_of_whole_texts():
    r = random.Random(3)
    own = t.Tokenizers(P.path(t.VOCABULARY_A), P.path(t.VOCABULARY_B))
    assert own.cuttable
    pieces = ["a", "the", "ing", " ", " ", "  ", "\n", "\t", ".", "'s", "1", "é", "▁", "\xa0", "　", "X", "\x1f", "👍"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        found = list(own.encode(own.chunks(text)))
        whole = all(a for a, _ in found)
        x, y = tokens(text)
        assert ([i for i, _ in x], [i for i, _ in y]) == tuple([i for f in found for i in f[k]] if whole else [] for k in (0, 1)), repr(text)


def test_forgetting_chunks_changes_nothing(monkeypatch):
    own = t.Tokenizers(P.path(t.VOCABULARY_A), P.path(t.VOCABULARY_B))
    texts = [x or "" for x in TEXTS] * 2
    results = []
    for memo in (t.MEMO, 3):
        monkeypatch.setattr(t, "MEMO", memo)
        table = t.ChunkTable(own, 5)
        results.append([[np.asarray(v).tolist() for v in d] for text in texts for d in table.documents([text])])
    assert results[0] == results[1]


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_merge_path(piece):
    r = np.random.default_rng(piece)
    for _ in range(50):
        end = int(r.integers(1, 60))
        a, b = (np.unique(np.append(r.integers(1, end + 1, r.integers(0, 30)), end)) for _ in range(2))
        cuts = t.diagonals(a, b, piece)
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        steps = [*range(0, len(merged), piece), len(merged)]
        assert cuts.tolist() == [sum(k == 0 for _, k in merged[:s]) for s in steps]
        starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        expected = [
            (i, j, min(a[i], b[j]), a[i] == b[j])
            for i in range(len(a))
            for j in range(len(b))
            if max(starts_a[i], starts_b[j]) < min(a[i], b[j])
        ]
        assert [tuple(x) for x in zip(*t.align(a, b, piece), strict=True)] == expected


def test_overlaps_cover_every_byte_once(spark):
    rows = [(1, "an alignment of tokenizers"), (2, None), (3, "über  alles")]
    out = t.overlaps(table(spark, rows), piece=4).collect()
    for i, text in rows:
        a, b = map(ranges, tokens(text))
        mine = [(r["a"], r["b"], r["a_id"], r["b_id"], r["together"]) for r in out if r["id"] == i]
        assert mine == [
            (x, y, a[x][0], b[y][0], a[x][2] == b[y][2])
            for x in range(len(a))
            for y in range(len(b))
            if max(a[x][1], b[y][1]) < min(a[x][2], b[y][2])
        ]
