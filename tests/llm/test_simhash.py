from collections import defaultdict

import numpy as np
import pytest
import xxhash

from relayloom.llm import bitslice
from relayloom.llm.common import table
from relayloom.llm.components import components
from relayloom.llm.simhash import drop_near_copies, first_fifth, near_classes, piece_masks, shingle_hashes, simhash_classes


def brute_fingerprint(text, words=4):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(fps, radius):
    """Smallest id reachable, for {id: fingerprint}."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    want = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    classes = brute_classes(want, 4)
    got = simhash_classes(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", classes[i]) for i, f in want.items()}


def test_small_buckets_are_cut_without_loss(spark):
    rng = np.random.default_rng(3)
    base = ["w%d" % x for x in rng.integers(0, 50, 400)]
    texts = []
    for _ in range(90):
        t = list(base)
        for at in rng.integers(0, 400, 2):
            t[at] = "v%d" % rng.integers(0, 99)
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes({i: brute_fingerprint(t) for i, t in enumerate(texts)}, 4)
    for bucket in (4096, 7):
        got = simhash_classes(docs, bucket=bucket).collect()
        assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("words64,radius", [(1, 4), (4, 44), (1, 0)])
def test_bit_planes_equal_pairwise_distances(words64, radius, monkeypatch):
    rng = np.random.default_rng(words64 + radius)
    for tile in (1 << 17, 5):
        monkeypatch.setattr(bitslice, "TILE", tile)
        for n in (1, 2, 63, 64, 65, 200):
            w = rng.integers(0, 1 << 63, (4, words64), dtype=np.uint64)[rng.integers(0, 4, n)].copy()
            for i in range(n):
                for b in rng.integers(0, 64 * words64, int(rng.integers(0, radius + 2))):
                    w[i, b // 64] ^= np.uint64(1 << int(b % 64))
            group = np.sort(rng.integers(0, 3, n))
            label = np.arange(n)
            for a, b in zip(*bitslice.forest(w, group, radius)):
                label[b] = a
            for g in range(3):
                own = {int(i): int.from_bytes(w[i].tobytes(), "little") for i in np.flatnonzero(group == g)}
                assert {i: int(label[i]) for i in own} == brute_classes(own, radius)


def test_every_close_pair_agrees_on_a_mask():
    rng = np.random.default_rng(0)
    for classes in (10, 10**8, 10**11):
        masks = piece_masks(classes, 4)
        for _ in range(300):
            flip = sum({1 << int(b) for b in rng.integers(0, 64, 4)})
            assert any(flip & m == 0 for m in masks)
    assert len(piece_masks(10, 4)) == 5 and len(piece_masks(10**8, 4)) == 15


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_odd_rows(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_classes(odd_docs).collect()}
    assert {(3, "0" * 16, 3), (4, "0" * 16, 3), (5, "0" * 16, 3)} <= got
    assert simhash_classes(odd_docs).count() == odd_docs.count()
    assert simhash_classes(no_docs).count() == 0
    kept = sorted(r.doc_id or 0 for r in drop_near_copies(odd_docs).select(odd_docs["doc_id"]).collect())
    assert kept == [-8, 0, 1, 3, 6, 7, 9]
    assert drop_near_copies(odd_docs).columns == odd_docs.columns


def test_near_classes_find_texts_that_are_08_alike(spark):
    rng = np.random.default_rng(8)
    rows, pairs, near = [], 0, 0
    for k in range(150):
        a = ["w%d" % x for x in rng.integers(0, 10**6, 300)]
        b = list(a)
        for at in rng.integers(0, 300, 5):
            b[at] = "other%d" % at
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, a), (_, b) in zip(rows[::2], rows[1::2]):
        x, y = set(shingle_hashes(a, 5).tolist()), set(shingle_hashes(b, 5).tolist())
        if len(x & y) / len(x | y) >= 0.8:
            pairs += 1
            near += got[i] == got[i + 1]
        assert {got[i], got[i + 1]} <= {i, i + 1}
    assert pairs > 40 and near / pairs >= 0.95


def exact_classes(texts, words=5):
    """Smallest id reachable by pairs of texts whose sets of shingle hashes have a Jaccard similarity of 0.8 or more."""
    sets = {i: frozenset(shingle_hashes(t or "", words).tolist()) for i, t in texts.items()}
    having, root = defaultdict(list), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for h in s or {None}:
            having[h].append(i)
    for a, b in {(a, b) for same in having.values() for a in same for b in same if a < b}:
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_near_copies_are_just_the_texts_that_are_08_alike(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = exact_classes({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in near_classes(docs).collect()} == want
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == {i for i, c in want.items() if i == c}


def test_pairs_below_08_are_no_links_and_pairs_from_08_are(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(60):  # chains in which each text is a little further from the first, of 4 to 400 shingles
        a = ["w%d" % x for x in rng.integers(0, 10**6, int(rng.integers(8, 405)))]
        texts.append(" ".join(a))
        for _ in range(4):
            a = a[int(len(a) * rng.uniform(0, 0.2)) :] + ["v%d" % x for x in rng.integers(0, 10**6, int(len(a) * rng.uniform(0, 0.15)))]
            texts.append(" ".join(a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = exact_classes(dict(enumerate(texts)))
    assert 60 < len(set(want.values())) < 240
    for more in ({}, {"bucket": 7, "chunk": 300}):
        assert {r.doc_id: r.component_id for r in near_classes(docs, **more).collect()} == want


def test_equal_fingerprints_are_no_copies(spark):
    texts = ["spam ham eggs and toast " + "buy " * 21, "one two three four five six " + "buy " * 24, "Spam ham eggs and toast " + "buy " * 23, " ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_classes(docs).collect()}
    assert got == exact_classes(dict(enumerate(texts))) == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}


def without(words, ranks):
    """The words, one replaced in each of the shingles whose hashes have these ranks, so that those shingles are gone."""
    hashes = shingle_hashes(" ".join(words), 5)
    out = list(words)
    for k in np.argsort(hashes)[list(ranks)]:
        out[k + 2] = "other%d" % k
    return out


def test_an_overfull_bucket_loses_no_pair(spark):
    """Two texts that are 0.8 alike share one of their 8 smallest hashes, and that one with many others."""
    a = ["w%d" % x for x in np.random.default_rng(1).integers(0, 10**6, 500)]
    b = without(a, range(1, 8))
    shared = int(np.argmin(shingle_hashes(" ".join(a), 5)))
    rows = [" ".join(a), " ".join(b)] + [" ".join(a[shared : shared + 5] + ["more%d" % k] * 3) for k in range(30)]
    least = [set(np.unique(shingle_hashes(t, 5))[:8].tolist()) for t in rows]
    assert len(least[0] & least[1]) == 1 and all(least[0] & least[1] <= x for x in least)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = exact_classes(dict(enumerate(rows)))
    assert want[1] == 0
    for bucket in (4096, 7):
        assert {r.doc_id: r.component_id for r in near_classes(docs, bucket=bucket).collect()} == want


def test_a_large_component_loses_no_pair(spark):
    """Two texts that are 0.8 alike share none of their 8 smallest hashes, but are in one component by a third."""
    a = ["w%d" % x for x in np.random.default_rng(2).integers(0, 10**6, 504)]
    b, c = without(a, range(8)), without(a, [*range(4), *range(60, 72)])
    rows = [" ".join(x) for x in (a, b, c)]
    least = [set(np.unique(shingle_hashes(t, 5))[:8].tolist()) for t in rows]
    assert not least[0] & least[1] and least[0] & least[2] and least[1] & least[2]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for chunk in (1 << 20, 200, 30):
        assert {r.doc_id: r.component_id for r in near_classes(docs, chunk=chunk).collect()} == exact_classes(dict(enumerate(rows))) == {0: 0, 1: 0, 2: 2}


def test_first_fifths_of_alike_sets_meet_in_any_order():
    rng = np.random.default_rng(6)
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        x = rng.choice(100, n, replace=False)
        y = np.r_[x[int(rng.integers(0, n // 5 + 1)) :], 100 + rng.choice(9, int(rng.integers(0, min(9, n // 5 + 1))), replace=False)]
        x, y = np.sort(x).astype(np.uint64), np.sort(y).astype(np.uint64)
        last = np.sort(rng.choice(110, int(rng.integers(0, 110)), replace=False)).astype(np.uint64)
        common = len(np.intersect1d(x, y))
        if 5 * common >= 4 * (len(x) + len(y) - common):
            assert len(np.intersect1d(first_fifth(x, last), first_fifth(y, last)))
