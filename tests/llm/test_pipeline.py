import re

import corpus_pipeline as p
import pytest
from shelfline.llm import mixing, quality_gam
from shelfline.llm.queries import LLM_QUERIES, LLM_SQL
from test_decontaminate import brute as brute_hits
from test_simhash import fingerprint, labels

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_the_pipeline_equals_its_stages_by_brute_force(spark, documents):
    rows = {r["doc_id"]: r for r in documents.collect()}
    good = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality_gam.classify(documents, good).collect()}
    kept = {i: r for i, r in rows.items() if scores[i]}
    group = labels({i: fingerprint(r["text"]) for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if group[i] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {doc for doc, _, hit, _ in brute_hits([(i, r["text"]) for i, r in kept.items()], items) if hit}
    kept = {i: r for i, r in kept.items() if i not in dirty}
    got = {r["doc_id"]: r for r in p.run(spark, SMALL).collect()}
    assert got.keys() == kept.keys() and len(kept) < len(rows)
    # Masks change no number of words.
    assert all(got[i]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in kept.items())
    assert sum(r["taken"] for r in got.values()) == pytest.approx(sum(r["size"] for r in got.values()), rel=0.02)


def test_stages_return_documents(spark, documents):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], documents.schema)
    for _, stage in p.STAGES[:-1]:
        for docs in (documents.limit(20), documents.limit(0), odd):
            out = stage(spark, docs, SMALL)
            assert out.columns == documents.columns
            assert out.count() <= docs.count()
    assert p.STAGES[-1][1](spark, odd, SMALL).count() == 3
    assert mixing.MOST == 3


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES)
    assert numbers == list(range(1, 14))
    assert set(LLM_SQL) <= set(LLM_QUERIES)
    assert [name for name, _ in p.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "source_mixing"]
