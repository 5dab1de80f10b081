import random

import numpy as np
import pytest

from relayloom.llm import decontaminate
from relayloom.llm.common import table
from relayloom.llm.decontaminate import Items, Pattern, contamination, drop_contaminated, normal


def brute_ends(item, text):
    """Least distance of the item to a piece of text ending at each place."""
    row = list(range(len(item) + 1))
    out = []
    for c in text:
        new = [0]
        for k, x in enumerate(item):
            new.append(min(row[k] + (x != c), row[k + 1] + 1, new[k] + 1))
        row = new
        out.append(row[-1])
    return out


def brute_distance(item, text):
    row = list(range(len(item) + 1))
    for c in text:
        new = [row[0] + 1]
        for k, x in enumerate(item):
            new.append(min(row[k] + (x != c), row[k + 1] + 1, new[k] + 1))
        row = new
    return row[-1]


def brute_whole_words(item, text):
    """Least distance of the item to a run of whole words; text is of words joined by single blanks."""
    row, best = list(range(len(item) + 1)), 10**9
    for at, c in enumerate(text):
        new = [row[0] + 1]
        for k, x in enumerate(item):
            new.append(min(row[k] + (x != c), row[k + 1] + 1, new[k] + 1))
        row = new
        if at + 1 == len(text) or text[at + 1] == " ":
            best = min(best, row[-1])
        if c == " ":  # a run may begin after it
            row = [min(r, k) for k, r in enumerate(row)]
    return best


def test_myers_equals_the_table():
    rnd = random.Random(1)
    for _ in range(150):
        item = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30)))
        assert list(Pattern(item).distances(text)) == brute_ends(item, text)
        assert list(Pattern(item).distances(text, whole=True)) == [brute_distance(item, text[: k + 1]) for k in range(len(text))]


def mutate(rnd, text, edits):
    s = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[at] = rnd.choice("xyz")
        elif kind == 1:
            s.insert(at, rnd.choice("xyz"))
        else:
            del s[at]
    return "".join(s)


def test_every_occurrence_within_the_budget_is_found():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, sentence(rnd.randint(3, 40))) for i in range(25)]
    found = Items(items)
    for _ in range(250):
        i, item = rnd.choice(items)
        text = sentence(30) + " " + mutate(rnd, item, rnd.randint(0, 4)) + " " + sentence(30)
        want = {j: brute_whole_words(normal(t), normal(text)) for j, t in items if len(t.split()) >= decontaminate.LEAST_WORDS}
        want = {j: d for j, d in want.items() if d <= int(len(normal(items[j][1])) * decontaminate.RATE)}
        got = {}
        for j, d, a, b in found.matches(text):
            got[j] = min(d, got.get(j, 99))
            assert brute_distance(normal(items[j][1]), normal(text[a:b])) == d
        assert got == want


def all_places(item, text):
    """Of each end in text: the least distance of the item to a run that begins with a word; a numpy column for each character of the item."""
    n = len(text)
    at = np.arange(n + 1)
    begins = np.r_[True, text == ord(" ")]
    row = at - np.maximum.accumulate(np.where(begins, at, 0))
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (text != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return row[1:]


def test_query_equals_brute_force(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, items).collect()}
    plain = {r.doc_id: normal(r.text) for r in docs.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in plain.items() if f" {normal(r.text)} " in f" {t} "}
    assert exact <= got
    # Every eighth item against every place of every text; texts are kept apart by more than any budget.
    text = np.array([ord(c) for t in plain.values() for c in t + "\0" * 60 + " "], np.int64)
    owner = np.repeat(list(plain), [len(t) + 61 for t in plain.values()])
    ends = np.r_[(text[1:] == ord(" ")) | (text[1:] == 0), True]
    some = [r for r in items.collect() if r.item_id % 8 == 0]
    want = set()
    for r in some:
        item = normal(r.text)
        near = (all_places(item, text) <= int(len(item) * decontaminate.RATE)) & ends & (text != 0)
        want |= {(int(d), r.item_id) for d in owner[near]}
    assert want and {x for x in got if x[1] % 8 == 0} == want
    kept = {r.doc_id for r in drop_contaminated(docs, items).collect()}
    assert kept == set(plain) - {d for d, _ in got}


def test_only_whole_words_and_enough_of_them():
    found = lambda item, text: Items([(1, item)]).matches(text)
    assert found("cat", "concatenate a cat") == [] and found("the art of", "the art of war") == []
    assert found("the art of war", "this is the art of wares") == []
    assert [(d, a, b) for _, d, a, b in found("the art of war", "is the art of wars, is")] == [(1, 3, 18)]
    assert found("one two three four five", "xone two three four fives") == []
    assert len(found("one two three four five", "one two three four five one two three four five")) == 2


def test_blocks_of_items_give_the_same(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = sorted(map(tuple, contamination(docs, items).collect()))
    kept = sorted(r.doc_id for r in drop_contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 9000)
    assert sorted(map(tuple, contamination(docs, items).collect())) == want
    for most in (decontaminate.BROADCAST, -1):
        monkeypatch.setattr(decontaminate, "BROADCAST", most)
        assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == kept


def test_offsets_case_and_punctuation():
    item = "The quick brown fox jumps over the lazy dog and runs away"
    text = "É! the QUICK, brown fox\njumps over a lazy dog -- and runs away. More"
    ((i, d, a, b),) = Items([(5, item)]).matches(text)
    assert (i, text[a:b]) == (5, "the QUICK, brown fox\njumps over a lazy dog -- and runs away") and d == 3


@pytest.mark.parametrize("text", ["lazy dog and " * 20_000, "x" * 300_000, "the " * 50_000])
def test_long_texts(text):
    assert Items([(1, "the quick brown fox jumps over the lazy dog and runs away")]).matches(text) == []


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, "the quick brown fox"), (1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog again"), (3, "the quick brown fox jumps over the lazy dog again")], "item_id long, text string")
    got = contamination(odd_docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 3, 0)] * 2 + [(2, 3, 0)] * 4
    assert contamination(no_docs, items).count() == 0 == contamination(odd_docs, items.limit(0)).count()
    kept = drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
