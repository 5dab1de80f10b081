import itertools
import zlib

import numpy as np
import pytest

from relayloom.llm.common import table
from relayloom.llm.queries import op3_toxicity
from relayloom.llm.toxicity import WORD, Lattice, Model, drop_toxic, features, score_texts, toxicity, train


def brute_marginals(emission, moves):
    n = len(emission)
    total = np.zeros(n)
    z = 0.0
    for states in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(e for e, s in zip(emission, states) if s)) * np.prod([moves[a, b] for a, b in zip(states, states[1:])])
        z += w
        total += w * np.array(states)
    return total / z


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    moves = np.exp(rng.normal(size=(2, 2)))
    lengths = np.array([3, 0, 7, 1, 7, 2])
    emission = rng.normal(size=lengths.sum()) * 2
    lattice = Lattice(lengths)
    odds = lattice.marginal_odds(emission, moves)[0]
    got = (odds / (1 + odds))[lattice.where]
    for e, p in zip(np.split(emission, np.cumsum(lengths)[:-1]), np.split(got, np.cumsum(lengths)[:-1])):
        assert np.allclose(p, brute_marginals(e, moves)) if len(e) else not len(p)


@pytest.fixture(scope="module")
def model(spark):
    big = "/root/testdata/sf0.1"
    return train(table(spark, big, "documents"), table(spark, big, "labels"))


def test_held_out_accuracy(spark, model):
    big = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, big, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = {r.doc_id: r for r in toxicity(table(spark, big, "documents"), model).collect() if r.doc_id in labels}
    hits = [got[i].predicted == y for i, y in labels.items()]
    assert np.mean(hits) >= 0.99
    toxic = [r for i, r in got.items() if labels[i]]
    # A label in about twenty is of a text without any toxic token.
    assert np.mean([bool(r.spans) for r in toxic]) >= 0.9


def test_query(spark, sf):
    rows = op3_toxicity(spark, sf).collect()
    assert len(rows) == 200
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_score(model, text):
    """Forward and backward sums in logarithms, a word at a time; the curve at the end."""
    e = [[0.0, model.emission(w)] for w in WORD.findall(text)]
    move = np.log(model.moves)
    ahead, back = [], [[0.0, 0.0]]
    for k, x in enumerate(e):
        ahead.append([x[j] + (np.logaddexp(ahead[k - 1][0] + move[0][j], ahead[k - 1][1] + move[1][j]) if k else 0.0) for j in (0, 1)])
    for x in reversed(e[1:]):
        back.append([np.logaddexp(move[i][0] + x[0] + back[-1][0], move[i][1] + x[1] + back[-1][1]) for i in (0, 1)])
    p = [1 / (1 + np.exp(np.clip(a[0] + b[0] - a[1] - b[1], -700, 700))) for a, b in zip(ahead, back[::-1])]
    c0, c1, c2 = model.curve
    return 1 / (1 + np.exp(-(c0 + c1 * np.log1p(sum(p)) + c2 * max(p, default=0.0))))


def test_query_equals_plain_forward_backward(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = train(docs, table(spark, sf, "labels"))
    assert len(model.weights) > 10
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = op3_toxicity(spark, sf).collect()
    assert len(rows) == len(texts) and {r.predicted for r in rows} == {0, 1}
    for r in rows:
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id]), abs=1e-6)


def test_spans_are_offsets_of_the_text():
    model = Model({"bad.": 9.0}, -4.0, np.ones((2, 2)), (-3.0, 2.0, 4.0))
    text = "ÉBad bad BAD, good bad"
    got = score_texts([text, "", "fine"], model)
    assert [(text[s["start"] : s["end"]]) for s in got["spans"][0]] == ["bad BAD", "bad"]
    assert got["spans"][1:] == [[], []] and got["score"][0] > 0.5 > got["score"][1]
    assert features("abcd") == ["abcd.", "abcd"]


def test_odd_rows(spark, odd_docs, no_docs, model):
    got = toxicity(odd_docs, model)
    assert got.count() == odd_docs.count() and toxicity(no_docs, model).count() == 0
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[3] == by[4] == by[5] < 0.5
    assert drop_toxic(odd_docs, model).columns == odd_docs.columns
    assert drop_toxic(odd_docs, model).count() == odd_docs.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity(odd_docs, train(odd_docs, none)).collect()} == {0}
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity(odd_docs, train(odd_docs, odd)).count() == odd_docs.count()
