import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relayloom.llm import token_files
from relayloom.llm.common import table
from relayloom.llm.queries import op2_token_files
from relayloom.llm.token_files import BLOCK, encode_texts, read_token_files, register_coder, token_file_digests, write_token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


def pack(spark, *ids):
    """Frames of 16-bit ids, by the function that writes files."""
    register_coder(spark)
    rows = spark.createDataFrame([(k, np.asarray(x, "<u2").tobytes()) for k, x in enumerate(ids)], "k int, ids binary")
    return [bytes(r.frame) for r in rows.select("k", F.call_function("token_pack", "ids").alias("frame")).orderBy("k").collect()]


def unpack(spark, *frames):
    register_coder(spark)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(frames)], "k int, frame binary")
    return [np.frombuffer(r.ids, "<u2") for r in rows.select("k", F.call_function("token_unpack", "frame").alias("ids")).orderBy("k").collect()]


@pytest.mark.parametrize("kind", ["random", "same", "skewed", "repeating", "largest", "every"])
def test_round_trip(spark, kind):
    made = []
    for n in (0, 1, 2, 383, 385, BLOCK, BLOCK + 1, 3 * BLOCK - 1):
        rng = np.random.default_rng(n)
        made.append({
            "random": lambda: rng.integers(0, 49408, n),
            "same": lambda: np.full(n, 7),
            "skewed": lambda: (rng.pareto(0.7, n) * 3).astype(np.int64) % 49408,
            "repeating": lambda: np.tile(rng.integers(0, 49408, 50), n // 50 + 1)[:n],
            "largest": lambda: rng.choice([0, 65535, 65534], n),
            "every": lambda: rng.permutation(np.arange(n) % 65536),
        }[kind]())
    for ids, got in zip(made, unpack(spark, *pack(spark, *made)), strict=True):
        assert (got == ids).all() and len(got) == len(ids)


def test_what_repeats_takes_little(spark):
    rng = np.random.default_rng(0)
    unit = rng.integers(0, 49408, 50)
    assert len(pack(spark, np.tile(unit, 160))[0]) < 500
    words = (rng.pareto(0.7, 80_000) * 3).astype(np.int64) % 49408
    assert len(pack(spark, words)[0]) < 80_000 * 2 * 0.75


def entropy(ids):
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return -(share * np.log2(share)).sum()


def test_smaller_than_the_entropy_of_single_ids(spark):
    """What the two orders above 0 are worth, learning included: ids of the texts themselves."""
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").limit(400).collect()]
    ids = encode_texts(pa.array(texts), WORDS)[0]
    assert 8 * len(pack(spark, ids)[0]) / len(ids) < entropy(ids)


def test_damage_is_noticed(spark):
    frame = pack(spark, np.arange(500))[0]
    for at in (0, 5, 20, len(frame) // 2, len(frame) - 3):
        bad = bytearray(frame)
        bad[at] ^= 4
        with pytest.raises(Exception, match="damaged frame"):
            unpack(spark, bytes(bad))
    body = bytearray(frame)
    body[-100] ^= 1  # with a frame checksum that is right, the block's own finds it
    body[4:8] = zlib.crc32(body[8:]).to_bytes(4, "little")
    with pytest.raises(Exception, match="damaged block"):
        unpack(spark, bytes(body))
    with pytest.raises(Exception, match="damaged frame"):
        unpack(spark, b"short")


def test_changed_lists_of_documents_are_noticed(spark, sf, tmp_path):
    write_token_files(table(spark, sf, "documents").limit(20), WORDS, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a")).withColumn("lengths", F.reverse("lengths")).write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="damaged documents"):
        read_token_files(spark, str(tmp_path / "b")).collect()


def brute(docs):
    lib, start, out = Tokenizer.from_file(WORDS), 0, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        out[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, sf):
    rows = op2_token_files(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute(table(spark, sf, "documents").collect())


def test_many_small_frames(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "FRAME", 700)
    docs = table(spark, sf, "documents").limit(60)
    ids = {r.doc_id: r.text for r in docs.collect()}
    write_token_files(docs.repartition(3), WORDS, str(tmp_path / "f"))
    lib = Tokenizer.from_file(WORDS)
    for r in read_token_files(spark, str(tmp_path / "f")).collect():
        assert r.ids == [*lib.encode(ids[r.doc_id], add_special_tokens=False).ids, 2]
    frames = spark.read.parquet(str(tmp_path / "f"))
    assert frames.count() > 10
    got = {r.doc_id: tuple(r)[1:] for r in token_file_digests(spark, str(tmp_path / "f")).collect()}
    assert got == brute(docs.collect())


def ids_of(texts):
    ids, lengths = encode_texts(pa.array(texts), WORDS)
    assert len(lengths) == len(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_ids_equal_the_library():
    lib = Tokenizer.from_file(WORDS)
    texts = ["", " ", "Hello, WORLD's don't 12 <|endoftext|>x  ÉéΣ 日本 a b", "x" * 5000, "</w> </w>a", "İstanbul ŒUVRE \x1c9"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert ids_of(texts) == want
        assert ids_of(texts[1::2]) == want[1::2] and ids_of([None, "a", "日"]) == [[], *ids_of(["a"]), *ids_of(["日"])]


def test_plain_characters_split_as_the_library_splits():
    lib = Tokenizer.from_file(WORDS)
    chars = [chr(c) for c in range(0x250)]
    texts = [f"a{c}b {c} {c}{c}1{c}'s a{c.upper()}" for c in chars]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts) == want


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    write_token_files(odd_docs, WORDS, str(tmp_path / "a"))
    rows = token_file_digests(spark, str(tmp_path / "a")).collect()
    assert len(rows) == odd_docs.count()
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start])[:-1].tolist()
    assert [r.doc_id for r in by_start] == [None, -8, 1, 2, 2, 3, 4, 5, 6, 7, 9]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    write_token_files(no_docs, WORDS, str(tmp_path / "b"))
    assert token_file_digests(spark, str(tmp_path / "b")).count() == 0


def test_learning_goes_on_to_the_end_of_a_block(spark):
    rng = np.random.default_rng(4)
    start = rng.integers(1000, 2000, 16_384)
    few, many = (8 * len(x) / BLOCK for x in pack(spark, np.r_[start, rng.integers(500, 516, BLOCK - 16_384)], np.r_[start, rng.integers(1000, 2000, BLOCK - 16_384)]))
    assert few < 8 and few < many - 3, (few, many)


def test_only_pre_tokens_are_kept_and_cut_as_the_pattern_cuts():
    """Pieces of text are new again and again where their pre-tokens are not."""
    tokens, lib = token_files.Tokens(WORDS), Tokenizer.from_file(WORDS)
    texts = [" ".join(f"{a}{b}{c}" for a in ("can", "it", "'Tis") for c in ("'s", "'tell", ",", "''ve.", "42", "(é)", "'ll'd")) for b in ("a", "b'", "ŏ-", "9", "÷", "'r", "") for _ in (0, 1)]
    pieces = {p for t in texts for p in t.split()}
    for _ in range(2):
        ids, lengths = tokens.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert sum(len(x) for x in vars(tokens).values() if isinstance(x, dict)) < len(pieces) / 2


def test_what_was_kept_twice_over_is_made_again(monkeypatch):
    monkeypatch.setattr(token_files, "WORDS", 20)
    tokens, lib = token_files.Tokens(WORDS), Tokenizer.from_file(WORDS)
    for k in range(12):
        texts = [" ", "", *(f" n{chr(97 + (j * 7 + k) % 26)}x, o{j}" for j in range(30))]
        ids, lengths = tokens.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
