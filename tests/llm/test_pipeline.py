import importlib
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from relayloom.llm.common import table
from relayloom.llm.decontaminate import contamination, normal
from relayloom.llm.simhash import shingle_hashes
from relayloom.llm.toxicity import toxicity, train


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage got and gave."""
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, sf).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return out


def test_names_and_columns(steps, spark, sf):
    assert [s[0] for s in steps] == ["toxicity", "near_dedup", "decontaminate", "pii", "bpe"]
    columns = table(spark, sf, "documents").columns
    assert all(got.columns == columns for _, _, got in steps[:-1])


def test_toxic_go_and_others_stay(steps, spark, sf):
    _, docs, got = steps[0]
    toxic = {r.doc_id for r in toxicity(docs, train(docs, table(spark, sf, "labels"))).where("predicted = 1").collect()}
    assert toxic and {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - toxic


def test_one_of_each_group_stays(steps):
    _, docs, got = steps[1]
    sets = {r.doc_id: set(shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    kept = {r.doc_id for r in got.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1)
    for d in set(sets) - kept:
        assert any(alike(d, k) >= 0.65 for k in sets if k < d)
    having = defaultdict(list)
    for d in kept:
        for h in sets[d]:
            having[h].append(d)
    pairs = {(a, b) for ds in having.values() if len(ds) > 1 for a in ds for b in ds if a < b}
    assert not [p for p in pairs if alike(*p) >= 0.85]


def test_passages_go(steps, spark, sf):
    _, docs, got = steps[2]
    hit = {r.doc_id for r in contamination(docs, table(spark, sf, "benchmark")).collect()}
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()} - hit
    items = [normal(r.text) for r in table(spark, sf, "benchmark").collect()]
    assert not [r for r in got.collect() if any(i in normal(r.text) for i in items)]


def test_personal_data_go_and_documents_stay(steps):
    _, docs, got = steps[3]
    assert got.count() == docs.count()
    text = {r.doc_id: r.text for r in got.collect()}
    assert not [t for t in text.values() if re.search(r"[\w.]+@[\w-]+\.\w", t)]
    for r in docs.collect():
        if not re.search(r"[@+]|\d[\d.\s-]{5,}", r.text):
            assert text[r.doc_id] == r.text


def test_ids(steps):
    _, docs, got = steps[4]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.exact and r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_equals_its_stages(steps, spark, sf):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, steps[-1][2].collect()))


def test_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf)
            if name != "bpe":
                assert got.columns == docs.columns
            assert got.count() <= docs.count()


def test_registered():
    assert "pipeline" in importlib.import_module("__spark_entry__").queries()
