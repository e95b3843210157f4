import zlib

import numpy as np
import pytest
from shelfline.llm import quality_gam as q


def rows(n):
    r = np.random.default_rng(1)
    out = []
    for i in range(n):
        words = ["".join(r.choice(list("abcdefgh"), int(r.integers(2, 9)))) for _ in range(int(r.integers(5, 80)))]
        bad = i % 4 == 0
        out.append((i, ("!! " if bad else " ").join(w.upper() if bad else w for w in words), 0 if bad else 1))
    return out


def test_learns_on_held_out_rows(spark):
    data = rows(600)
    docs = spark.createDataFrame([(i, t, 1.0, "l") for i, t, _ in data], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in q.classify(docs, labels).collect()}
    assert len(got) == 600
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = {i: y for i, _, y in data}
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["predicted"]}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "w " * 100_000), (3, "w " * 100_000), (4, "\x00\n\n")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in q.classify(docs, none).collect()] == [0.5] * 6
    assert q.keep_good(docs, none).count() == 6
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    got = q.classify(docs, one_class).collect()
    assert all(0.99 < r["score"] <= 1 for r in got) and len(got) == 6
    assert q.classify(docs.limit(0), one_class).count() == 0


def test_tables_fit_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((4000, len(q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.fit(x, y, np.ones(4000))
    assert (1, 0) in model.pairs
    assert np.mean((model.scores(x) > 0.5) == y) > 0.95


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    shape = "doc_id long, quality int"
    one = q.classify(docs, spark.createDataFrame([(i, y) for i, _, y in data], shape)).collect()
    two = q.classify(docs, spark.createDataFrame([(i, flip(i, y)) for i, _, y in data], shape)).collect()
    assert sorted(one) == sorted(two)


def naive_fit(x, y, weight):
    """The same model by plain loops over rows, bins and every possible cut."""
    n, width = x.shape
    gain = lambda g, h: g * g / (h + q.SHRINK)
    value = lambda g, h: g / (h + q.SHRINK)
    base = np.log((weight * y).sum() / (weight * (1 - y)).sum())
    margin = [base] * n

    def binned(count):
        edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, count + 1)[1:-1]))) for f in range(width)]
        return [len(e) + 1 for e in edges], [[sum(e <= v for e in edges[f]) for v in x[:, f]] for f in range(width)]

    def sums(cells):
        out = {}
        for i, cell in enumerate(cells):
            p = 1 / (1 + np.exp(-margin[i]))
            g, h = out.get(cell, (0.0, 0.0))
            out[cell] = (g + weight[i] * (y[i] - p), h + weight[i] * p * (1 - p))
        return out

    def total(held, cells):
        return tuple(sum(held.get(c, (0.0, 0.0))[k] for c in cells) for k in (0, 1))

    def best_cut(held, runs):
        """The cut of one of the runs of cells that gains most, as (gain, run, place)."""
        found = (0.0, None, None)
        for r, run in enumerate(runs):
            for at in range(1, len(run)):
                won = gain(*total(held, run[:at])) + gain(*total(held, run[at:])) - gain(*total(held, run))
                if won > found[0] + 1e-12:
                    found = (won, r, at)
        return found

    wide, bins = binned(q.BINS)
    tables = [[0.0] * w for w in wide]
    for _ in range(q.ROUNDS):
        for f in range(width):
            held, runs = sums(bins[f]), [list(range(wide[f]))]
            for _cut in range(2):
                _won, r, at = best_cut(held, runs)
                if r is not None:
                    runs[r : r + 1] = [runs[r][:at], runs[r][at:]]
            step = {c: q.RATE * value(*total(held, run)) for run in runs for c in run}
            tables[f] = [t + step[c] for c, t in enumerate(tables[f])]
            margin = [m + step[c] for m, c in zip(margin, bins[f])]

    wide, bins = binned(q.PAIR_BINS)

    def pair_tree(f, g):
        held, best = sums(list(zip(bins[f], bins[g]))), (-1.0, None)
        for at in range(1, wide[f]):
            leaves = []
            for side in (range(at), range(at, wide[f])):
                columns = {d: total(held, [(c, d) for c in side]) for d in range(wide[g])}
                _won, r, cut = best_cut(columns, [list(range(wide[g]))])
                cut = wide[g] if r is None else cut
                leaves += [[(c, d) for c in side for d in range(cut)], [(c, d) for c in side for d in range(cut, wide[g])]]
            score = sum(gain(*total(held, leaf)) for leaf in leaves)
            if score > best[0] + 1e-12:
                best = (score, leaves)
        values = {cell: value(*total(held, leaf)) for leaf in best[1] for cell in leaf}
        return values, best[0] - gain(*total(held, held))

    every = [(f, g) for f in range(width) for g in range(f)]
    pairs = sorted(every, key=lambda p: -pair_tree(*p)[1])[: q.PAIRS]
    pair_tables = [np.zeros((wide[f], wide[g])) for f, g in pairs]
    for _ in range(q.PAIR_ROUNDS):
        for (f, g), entries in zip(pairs, pair_tables):
            values, _won = pair_tree(f, g)
            for cell, v in values.items():
                entries[cell] += q.RATE * v
            margin = [m + q.RATE * values[cell] for m, cell in zip(margin, zip(bins[f], bins[g]))]
    return tables, pairs, pair_tables, 1 / (1 + np.exp(-np.array(margin)))


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_boosting_equals_plain_loops(monkeypatch, seed):
    for name, value in (("FEATURES", list(range(4))), ("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2), ("BINS", 6), ("PAIR_BINS", 4)):
        monkeypatch.setattr(q, name, value)
    r = np.random.default_rng(seed)
    x = r.random((90, 4))
    # Ties in a feature, and one that is constant.
    x[:, 2], x[:, 3] = np.floor(x[:, 2] * 3), 1.0
    y = ((x[:, 0] > 0.4) ^ (x[:, 2] > 1) ^ (r.random(90) < 0.1)).astype(float)
    weight = r.integers(1, 4, 90).astype(float)
    model = q.fit(x, y, weight)
    tables, pairs, pair_tables, scores = naive_fit(x, y, weight)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.tables, tables, strict=True))
    assert model.pairs == pairs
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.pair_tables, pair_tables, strict=True))
    assert np.allclose(model.scores(x), scores, atol=1e-9)
