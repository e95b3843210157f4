import random
import re

import pytest
from shelfline.llm import decontaminate as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, items string, start int, n_words string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = []
    for name, text in items:
        w = words(text)
        windows += [(name, w[i : i + size]) for i in range(max(1, len(w) - size + 1)) if w]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for name, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    if name is not None:
                        found.add(str(name))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], DOCS),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = ["a", "b", "Été", "ÉTÉ", "über", "x1", "of", "longer", "d"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(1, make(14)), (2, make(3)), (3, None), (4, "... !"), (None, make(12)), (7, "Of of of of of of of of of of of"), (7, make(11))]
    docs = [(i, make(30)) for i in range(20)]
    docs += [(100 + i, f"{make(5)}, {text.upper() if i % 2 else text}! {make(4)}") for i, (_, text) in enumerate(items) if text]
    docs += [(200, None), (201, ""), (202, "\x00|~ "), (None, items[0][1]), (203, "of " * 500), (204, items[0][1]), (204, items[0][1]), (205, "of " * 9)]
    return docs, items


def test_equals_brute_force(spark, corpus):
    found = d.contamination(*frames(spark, *corpus)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found), key=repr)
    assert got == brute(*corpus)


def test_large_window_sets_are_not_broadcast(spark, corpus):
    docs, items = frames(spark, *corpus)
    hits = d.window_hits(docs, items, broadcast_windows=1)
    assert sorted(map(tuple, hits.collect()), key=repr) == sorted(map(tuple, d.window_hits(docs, items).collect()), key=repr)


def test_no_text_is_shuffled_by_word(spark, corpus):
    docs, _ = frames(spark, *corpus)
    assert [t for _, t in d.window_positions(docs, [3, 10], "doc_id", "text").dtypes] == ["bigint", "bigint", "int", "int", "bigint"]


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b c")], [])
    assert d.contamination(docs, items).first()["n_hit"] == 0
    assert d.contamination(*frames(spark, [], [(1, "a b")])).count() == 0


def test_removes_documents_or_spans(spark):
    docs, items = frames(spark, [(1, "keep, One TWO three! keep"), (2, "one two"), (3, None), (1, "keep, One TWO three! keep")], [(1, "one two three")])
    left = d.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in d.decontaminate(docs, items, remove="spans").collect()}
    assert cut == {1: "keep,   ! keep", 2: "one two", 3: None}
    with pytest.raises(ValueError):
        d.decontaminate(docs, items, remove="other")
