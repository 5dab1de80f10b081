import gc
import random
import weakref
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from relayloom.llm import bpe
from relayloom.llm.bpe import bpe_digests, bpe_encode, decode_ids, encode_texts, encoder
from relayloom.llm.common import live, table
from relayloom.llm.token_counts import count_texts, token_counts, whole_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aab  \n\t    'slltve<|endoftext|>x9٣ééÉΣςσİıßﬁ日本한\U0001f600\x1c\x00.,--​\u0085ǅ"


def odd_texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "<|endoftext|>", "<|startoftext|> x", " ", "  "]) for _ in range(6000)]
    return made + ["a" * 3000, "ab" * 2000, "é" * 500, " " * 50, "x  " * 5, "=-" * 1000] + [f"a{chr(c)}1 {chr(c)}b" for c in [*range(0x3500), *range(0x4E00, 0xA000, 37), *range(0xAC00, 0xD7A4, 41)]]


def test_ids_equal_the_library():
    lib, enc = Tokenizer.from_file(BYTES), encoder(BYTES)
    texts = odd_texts()
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert enc.ids(text) == want.ids, text
        assert enc.decode(want.ids) == lib.decode(want.ids, skip_special_tokens=False)


def test_every_token_is_its_own_encoding_or_not():
    lib, enc = Tokenizer.from_file(BYTES), encoder(BYTES)
    words = sorted(enc.vocabulary.bytes_of.items())[:50256]
    for i, raw in words[::7]:
        ids = enc.vocabulary.encode_word(raw)
        assert enc.vocabulary.decode(ids) == raw
        if ids != [i]:
            assert len(ids) > 1 and all(enc.vocabulary.fits(a, b) for a, b in zip(ids, ids[1:]))


def test_counts_equal_the_library():
    lib = Tokenizer.from_file(WORDS)
    texts = odd_texts()
    assert count_texts(texts, WORDS)["n_tokens"] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_proven():
    lib = Tokenizer.from_file(WORDS)
    found = sorted(whole_tokens(WORDS))
    assert len(found) > 30_000
    assert all(len(e.ids) == 1 for e in lib.encode_batch(found[::5], add_special_tokens=False))


def test_queries(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    lib, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    for r in bpe_digests(docs, BYTES).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
    for r in token_counts(docs, WORDS).collect():
        n = len(words.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_encode_and_decode(spark, odd_docs):
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    encoded = bpe_encode(odd_docs, BYTES)
    assert {r.exact for r in encoded.collect()} == {True}
    assert sorted((r.doc_id or 0, r.text) for r in decode_ids(encoded, BYTES).collect()) == texts
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_ids(none, BYTES).first().text is None


@pytest.mark.parametrize("of", [lambda d: bpe_digests(d, BYTES), lambda d: token_counts(d, WORDS)])
def test_odd_rows(odd_docs, no_docs, of):
    got = of(odd_docs).collect()
    assert len(got) == odd_docs.count() and of(no_docs).count() == 0
    assert {r.doc_id: r.n_tokens for r in got}[3] == {r.doc_id: r.n_tokens for r in got}[4] == 0


def test_what_one_operator_kept_is_gone_when_the_next_begins():
    gc.disable()  # what refers to itself stays until the collector runs
    try:
        kept = weakref.ref(encoder(BYTES))
        assert kept() is encoder(BYTES)
        live(("another",), dict)
        assert kept() is None
    finally:
        gc.enable()


def test_a_stage_keeps_a_bounded_number_of_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_IN_PIPELINE", 50, raising=False)
    lib, texts = Tokenizer.from_file(BYTES), [" ".join(f"word{k}{j}x" for j in range(40)) for k in range(40)]
    assert [x.tolist() for x in encode_texts(texts, BYTES)["ids"]] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    enc = encoder(BYTES, 50)
    assert all(len(c) + len(c.old) <= 100 for c in (enc.chunks, enc.words, enc.vocabulary.pairs))
