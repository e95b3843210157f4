from collections import Counter, defaultdict

import numpy as np
import pytest
from shelfline.llm import mixing as m


def shares(sizes):
    """Targets by sharing the excess again and again."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, out, fixed = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in fixed)
        open_ = sum(weight[s] for s in sizes if s not in fixed)
        out = {s: 3 * sizes[s] if s in fixed else weight[s] * left / open_ for s in sizes}
        over = {s for s in sizes if s not in fixed and out[s] > 3 * sizes[s]}
        if not over:
            return out
        fixed |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5000, None: 70, "é": 3, "Z": 0}, {"a": 5}, {"x": 1, "y": 100_000, "z": 1}, {None: 0}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in m.targets(frame).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1024, 5000])
def test_permutations(n):
    at = np.arange(n)
    one, two = (m.permuted(at, np.full(n, n), np.full(n, key)) for key in (1, 2))
    assert sorted(one) == at.tolist() == sorted(two)
    assert n < 10 or (one != two).any() and (one != at).any()


@pytest.fixture(scope="module")
def corpus(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(int(r.integers(0, 60)))), "big" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(300)]
    rows += [(900, None, "big", 1), (901, "", None, 1), (902, "w " * 5000, None, 1), (None, "no id here", "s1", 1), (5, rows[5][1], rows[5][2], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(5).cache()


def test_mixture(spark, corpus):
    kwargs = {"block_words": 16, "shard_slots": 64, "chunk_rows": 50}
    got = m.mixture(corpus, **kwargs).collect()
    assert sorted(got, key=repr) == sorted(m.mixture(corpus.repartition(2), **kwargs).collect(), key=repr)
    size = {(r["doc_id"], r["size"]) for r in got}
    assert (None, 3) in size and (902, 5000) in size and len(got) == corpus.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    source = dict(corpus.select("doc_id", "source").collect())
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_small_sources_are_not_lost(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(20)), f"s{i:03}") for i in range(300)] + [(900 + i, "x " * 64, f"t{i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = m.mixture(docs).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.5 for r in got) and min(r["taken"] for r in got) > 0


def test_short_blocks_of_many_chunks(spark):
    rows = [(i, f"a{i} b c", "one" if i % 4 else "two") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = m.mixture(docs, block_words=64, shard_slots=8, chunk_rows=3).collect()
    for target in {r["target"] for r in got}:
        own = [r for r in got if r["target"] == target]
        assert abs(sum(r["taken"] for r in own) - target) <= 0.5
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_texts_are_dealt_once(spark, corpus):
    plan = m.mixed_blocks(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Aggregate" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_mixed_blocks_hold_the_words(spark, corpus):
    kwargs = {"block_words": 16, "shard_slots": 64, "chunk_rows": 50}
    blocks = m.mixed_blocks(corpus, **kwargs).collect()
    assert max(Counter(r["shard"] for r in blocks).values()) <= 64
    texts = defaultdict(list)
    for doc, text in corpus.select("doc_id", "text").collect():
        texts[doc].append((text or "").split())
    taken = Counter()
    for r in blocks:
        words = [w for p in r["parts"] for w in texts[p["id"]][0][p["skip"] : p["skip"] + p["words"]]]
        assert r["text"].split() == words and len(words) <= 16
        for p in r["parts"]:
            taken[p["id"]] += p["words"]
    want = Counter()
    for r in m.mixture(corpus, **kwargs).collect():
        want[r["doc_id"]] += r["taken"]
    assert +taken == +want


def test_the_mixture_is_read_from_written_blocks(spark, corpus, monkeypatch):
    written, write = {}, m.materialise
    monkeypatch.setattr(m, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    rows = [(7, "b " * 40, "x"), (7, "c " * 40, "x"), (7, "c " * 40, "x"), (None, "d " * 40, "x"), (None, "e " * 50, "y"), (8, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(corpus.select("doc_id", "text", "source"))
    got = m.mixture(docs, block_words=16, shard_slots=64, chunk_rows=50).collect()
    parts = written["mix"].select("text", "parts").collect()
    held = Counter()
    for r in parts:
        words = r["text"].split()
        assert sum(p["words"] for p in r["parts"]) == len(words)
        for p in r["parts"]:
            held[p["id"]] += len(words[p["offset"] : p["offset"] + p["words"]])
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] > 0) == (r["taken_hash"] > 0)
    assert +held == +taken and len(got) == docs.count()


def test_the_mixture_shows_its_words(spark, corpus):
    kwargs = {"block_words": 16, "shard_slots": 64, "chunk_rows": 50}
    masked = corpus.withColumn("text", m.F.expr("if(doc_id = 902, repeat('v ', 5000), text)"))
    one, two = ({r["doc_id"]: r for r in m.mixture(d.where("doc_id <> 5"), **kwargs).collect()} for d in (corpus, masked))
    assert {i for i in one if one[i]["taken_hash"] != two[i]["taken_hash"]} == {902}
    assert all(one[i]["taken"] == two[i]["taken"] for i in one)


def test_empty_tables(spark):
    assert m.mixture(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"]) for r in m.mixture(blank).collect()] == [(0, 0), (0, 0)]
