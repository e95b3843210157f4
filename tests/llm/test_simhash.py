import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from shelfline.llm import simhash as s

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def labels(nodes, distance=3):
    """Smallest reachable node per node; nodes: {node: fingerprint}."""
    out = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (nodes[a] ^ nodes[b]).bit_count() <= distance and out[b] < out[a]:
                    out[a], changed = out[b], True
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b c D\x1fe f", "É é É x " * 50, "w " * 200_000, "x" * 100_000])
def test_fingerprints(text):
    assert s.fingerprint((text or "").encode()) == fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == signed(xxhash.xxh64_intdigest("a b c", 42))


@pytest.mark.parametrize("block", [3, 4096])
def test_links_equal_brute_force(spark, block):
    r = random.Random(1)
    centres = [r.getrandbits(64) for _ in range(6)] + [0]
    points = set(centres)
    for c in centres:
        for _ in range(25):
            points.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    nodes = dict(enumerate(sorted(points)))
    fps = spark.createDataFrame([(signed(f), n) for n, f in nodes.items()], "fp long, node long")
    found = dict(map(tuple, s.components(s.links(fps, block=block)).collect()))
    assert {n: found.get(n, n) for n in nodes} == labels(nodes)


def test_chain_filter_loses_no_pair():
    r = random.Random(2)
    import numpy as np

    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5)))
        near = (a ^ b).bit_count() <= 3
        chains = [s.chain_links(np.uint64(a), np.array([b], np.uint64), i, 3)[0] for i in range(4)]
        assert any(chains) == near


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until it is " * 8
    rows = [(5, base), (3, base.upper()), (9, None), (7, ""), (8, "  "), (None, base), (None, "alone in the dark"), (11, "alone in the dark here"), (5, base), (20, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0, "q") for i, t in rows], "doc_id long, text string, fp int, component string")
    got = [(r["id"], r["fp"], r["component"]) for r in s.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    assert {c for i, _, c in got if i in (3, 5)} == {3}
    assert {c for i, _, c in got if i in (7, 8, 9)} == {7}
    assert sorted(((i, c) for i, _, c in got if i is None), key=repr) == [(None, 3), (None, None)]
    assert all(f == signed(fingerprint(base)) for i, f, _ in got if i in (3, 5))
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    # of the rows without an id one joins a group with ids, the other is alone
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == [-1, 3, 7, 11, 20]


def test_the_largest_id(spark):
    top = 2**63 - 1
    docs = spark.createDataFrame([(top, "a b c d"), (-top - 1, "a b c d"), (5, "quite another text here"), (None, "no id")], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["component"] or 0) for r in s.near_duplicates(docs).collect()) == [(-top - 1, -top - 1), (0, 0), (5, 5), (top, -top - 1)]
    assert s.keep_one(docs).count() == 3


def test_one_id_with_two_texts_loses_neither(spark):
    rows = [(1, "first text of its own"), (1, "a second and unrelated one"), (2, "repeated row"), (2, "repeated row")] + [(None, "a copy without an id")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, s.keep_one(docs).collect()), key=repr)
    assert kept == sorted(set(rows), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_duplicates(docs).count() == 0
    assert s.keep_one(docs).count() == 0
