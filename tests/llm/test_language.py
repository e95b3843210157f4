import zlib

import numpy as np
import pytest
from shelfline.llm import language as g


def segmentations(word, pieces, p, unknown):
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        at = pieces.get(word[:j], unknown if j == 1 else None)
        if at is not None:
            total += p[at] * segmentations(word[j:], pieces, p, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5, "aba": 6}
    p = np.random.default_rng(1).random((8, 2)) / 4
    words = ["▁aba", "▁ab", "▁xba", "▁", "▁ababab"]
    got = g.Lattice(words, g.Pieces(pieces)).log_likelihood(p)
    want = [[np.log(segmentations(w, pieces, p[:, k], 7)) for k in range(2)] for w in words]
    assert np.allclose(got, want)


def test_expected_uses_match_the_derivative():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    p = np.random.default_rng(2).random((6, 1)) / 3
    words, count = ["▁abab", "▁b"], np.array([2.0, 3.0])
    uses = g.Lattice(words, g.Pieces(pieces)).expected(p, count)[:, 0]
    for k in range(6):
        step = p.copy()
        step[k] *= 1 + 1e-6
        slope = ((g.Lattice(words, g.Pieces(pieces)).log_likelihood(step) - g.Lattice(words, g.Pieces(pieces)).log_likelihood(p))[:, 0] * count).sum() / 1e-6
        assert uses[k] == pytest.approx(slope, abs=1e-4)


def test_words():
    assert g.words_of(None) == [] == g.words_of("12 _ !")
    assert [g.marked(w) for w in g.words_of("L'Été 3x")] == ["▁l", "▁été", "▁x"]
    parts = [g.marked(w) for w in g.words_of("b " + "a" * 100)]
    assert "".join(parts) == "▁b▁" + "a" * 100 and max(map(len, parts)) <= g.LONGEST


def test_numbers_are_no_letters(spark, docs):
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ"), (3, "٣ ৪ _"), (4, "¼x")], "doc_id long, text string")
    assert [g.words_of(r["text"]) for r in odd.collect()] == [[], [], [], ["x"]]
    both = docs.select("doc_id", "text", "lang").unionByName(odd.selectExpr("doc_id + 9000 AS doc_id", "text", "cast(null as string) AS lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in g.identify(both).where("doc_id > 9000").collect()}
    assert [got[9001], got[9002], got[9003]] == [("und", 0.0)] * 3 and got[9004][0] != "und"


def test_memory_does_not_grow_with_languages():
    import tracemalloc

    pieces = g.Pieces(g.vocabulary())
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = [f"▁{a}{b}{c}ab{d}" for a in alphabet for b in alphabet for c in alphabet for d in "abc"]
    peaks = []
    for languages in (4, 100):
        p = np.full((pieces.n + 1, languages), 1e-4)
        at_once = g.bounds(languages)[1]
        tracemalloc.start()
        for at in range(0, len(words), at_once):
            g.Lattice(words[at : at + at_once], pieces).log_likelihood(p)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_pieces_are_found_by_their_hashes():
    pieces = g.vocabulary()
    found = g.Pieces(pieces)
    words = list(pieces)[:500] + ["zzzzqqq", "x" * 30]
    for w in words:
        value = np.zeros(1, np.uint64)
        for c in w:
            value = found.roll(value, np.array([ord(c)], np.uint64))
        assert found.find(value)[0] == pieces.get(w, -1)


@pytest.fixture(scope="module")
def docs(spark):
    en, de = ["the", "of", "and", "with", "thing"], ["der", "und", "nicht", "über", "schön"]
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(de if i % 2 else en, 12)).title(), "de" if i % 2 else "en", 1.0) for i in range(200)]
    rows += [(300, None, "en", 1.0), (301, "123 !?", "de", 1.0), (302, "und der " * 20_000, None, 1.0), (303, "", None, 1.0), (None, "the of", "en", 1.0), (302, "und der " * 20_000, None, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_identify(spark, docs):
    got = g.identify(docs).collect()
    assert len(got) == 206
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if i is None:
            assert r["lang_pred"] == "en"
        elif i < 200:
            assert r["lang_pred"] == ("de" if i % 2 else "en")
        else:
            assert r["lang_pred"] == {300: "und", 301: "und", 302: "de", 303: "und"}[i]


@pytest.mark.parametrize("train_docs", [1, 50])
def test_rare_languages_are_learned(spark, train_docs):
    words = {"en": "the of and with thing", "de": "der und nicht schön über", "fi": "joka mutta hyvää päivää kiitos"}
    rare = [i for i in range(5000, 5040) if zlib.crc32(str(i).encode()) % 5][:6]
    rows = [(i, words["en"], "en") for i in range(4000)] + [(i, words[n], n) for k, n in enumerate(("de", "fi")) for i in rare[3 * k : 3 * k + 3]]
    rows += [(i, "12 !", "fi") for i in range(6000, 6500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert g.train(docs, train_docs=train_docs)[0] == ["de", "en", "fi"]
    got = {r["doc_id"]: r["lang_pred"] for r in g.identify(docs, train_docs=train_docs).where("doc_id between 5000 and 5999").collect()}
    assert got == {i: n for i, _, n in rows if 5000 <= i < 6000}


def test_nothing_to_learn_from(spark, docs):
    bare = docs.limit(5).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in g.identify(bare).collect()} == {"und"}
    assert g.identify(docs.limit(0)).count() == 0
