import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.llm import ngram_join as g

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_force(rows, percent=80):
    """[(id, n, component)] sorted, by comparing all pairs of different sets."""
    sets = [grams(t) for _, t in rows]
    kinds = sorted(set(sets) - {frozenset()}, key=sorted)
    group = list(range(len(kinds)))
    for i in range(len(kinds)):
        for j in range(i):
            if 100 * len(kinds[i] & kinds[j]) >= percent * len(kinds[i] | kinds[j]):
                a, b = group[i], group[j]
                group = [b if x == a else x for x in group]
    place = dict(zip(kinds, group, strict=True))
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[place[s]] = min(i, least.get(place[s], i))
    return sorted(((i, len(s), least.get(place[s]) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def corpus(seed, n):
    """Texts with near-copies in chains, a passage that most share, copies and short ones."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 400))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.45 and texts:
            base = r.choice(texts).split()
            for _ in range(r.randint(0, 2)):
                if base:
                    base[r.randrange(len(base))] = word()
            texts.append(" ".join(base))
        elif kind < 0.7:
            texts.append(" ".join(passage + [word() for _ in range(r.randint(0, 40))]))
        elif kind < 0.8:
            texts.append(" ".join(word() for _ in range(r.randint(0, 6))))
        else:
            texts.append(" ".join(word() for _ in range(r.randint(5, 120))))
    return list(enumerate(texts))


EDGES = [
    (None, "Only Row Without Any Id Here x"),
    (7, None),
    (8, ""),
    (9, " \t\n\x0b"),
    (10, "One"),
    (11, "one"),
    (12, "one two"),
    (12, "one two"),
    (None, None),
    (13, "É é É x y z"),
    (14, "é É É x y z"),
    (2**63 - 1, "a b c d e f g"),
    (-5, "A B\x0cC d e\x85f g"),
    (15, "w " * 50_000),
    (16, "W " * 60_000 + "w w"),
    (17, "x" * 200_000),
    (None, "one two"),
    (3, "only row without any id here x"),
]


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("N", F.lit("x"))
    return sorted(map(tuple, g.similarity_classes(docs.repartition(3), **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "listed": 0, "block": 8}, {"hot": 4, "listed": 1}])
def test_classes_equal_brute_force(spark, options):
    rows = corpus(5, 260)
    assert found(spark, rows, **options) == brute_force(rows)


def test_edge_cases(spark):
    assert found(spark, EDGES) == brute_force(EDGES)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_column_of_a_third_of_all_documents_is_sent_once_a_batch(spark):
    rows = [(i, "the same five words here " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sent = g._column_blocks(docs, 5, 80, "text", 16, g.HOT).where("place < 16").toPandas()
    entries = np.concatenate([g._from_six(b) for b in sent["token"]])
    assert np.unique(entries, return_counts=True)[1].max() < g.HOT


@pytest.mark.parametrize("seed", range(3))
def test_block_product_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    group = list(range(60))
    for a, b in g.block_links(sets, 60):
        group = [group[a] if x == group[b] else x for x in group]
    for i in range(60):
        for j in range(i):
            overlap = len(np.intersect1d(sets[i], sets[j]))
            if 100 * overlap >= 60 * (len(sets[i]) + len(sets[j]) - overlap):
                assert group[i] == group[j]


def test_an_entry_takes_the_same_bytes_in_any_number_of_blocks(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(100)], "doc_id long, text string").coalesce(1)
    size = {}
    for blocks in (16, 4096):
        sent = g._column_blocks(docs, 5, 80, "text", blocks, g.HOT).collect()
        size[blocks] = sum(len(v) for row in sent for v in row if isinstance(v, (bytes, bytearray)))
    assert size[4096] <= 1.05 * size[16]


def test_six_byte_numbers_come_back_in_any_order():
    values = np.random.default_rng(1).integers(0, 1 << 48, 500).astype(np.uint64)
    for x in (values, np.sort(values), np.repeat(values[:3], 4), values[:0]):
        assert (g._from_six(g._six(x)) == x).all() and len(g._six(x)) == 6 * len(x)


def test_copies_that_are_too_many_to_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(g, "BROADCAST_ROWS", 0)
    rows = corpus(6, 120)
    rows += [(i + 1000, t.upper()) for i, t in rows[:60]]
    assert found(spark, rows, hot=3) == brute_force(rows)
