"""Byte-level BPE by dynamic programming over prefixes.

The tokens of a byte-pair encoding are unique for every prefix of a word, so it is enough
to store for each prefix the one last token of its encoding. A token t ending at position
i is that token if and only if t may follow the last token of the prefix before it: the
pair re-encodes to itself (`Vocabulary.fits`). An automaton over the vocabulary lists the
tokens that end at each position (suffix links lead from the longest to shorter ones), so
a word takes time in proportion to its length and the tokens found, never its square.
Following the stored tokens back gives the exact ids.

Defined cases: a null text is empty (0 tokens, digests of the empty string); special
strings in a text become their id, as the library's default has it; repeated rows each get
a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import Cache, chunks, live, map_texts
from relayloom.llm.token_counts import byte_chars

# The split pattern of this family of byte-level vocabularies, with its white space spelled out.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Chunks of text that a worker keeps for digests, twice at most; and where ids are made for a pipeline, whose workers have less memory to spare.
KEPT, KEPT_IN_PIPELINE = 300_000, 100_000
#: A blank between white space, or between it and the end: there a cut at blanks would split one pre-token.
_INNER_BLANK = regex.compile(r"\s (?:\s|\Z)")


class Vocabulary:
    """Tokens as bytes, their merges, and the automaton that finds them."""

    def __init__(self, path: str, kept: int = KEPT):
        spec = json.load(open(path))
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = vocab[a], vocab[b]
            self.rank[pair] = k
            self.made[pair] = vocab[a + b]
            self.parts.setdefault(vocab[a + b], pair)
        self.age = {i: self.rank[p] for i, p in self.parts.items()}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for s, i in vocab.items():
            self.found.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.found.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = Cache(lambda p: self.fits(*p), min(kept, 200_000))

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their joint bytes are encoded.

        Undo merges from the youngest on, on both sides of the border. At any moment the
        tokens next to the border are those that stood there when all merges older than
        `limit` had been done; a border pair with a merge older than that would have been
        joined, and the two tokens would never have come about.
        """
        limit = len(self.rank) + 1
        while True:
            joint = self.rank.get((left, right))
            if joint is not None and joint < limit:
                return False
            a, b = self.age.get(left, -1), self.age.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Merges run by rank, and from left to right within one rank. Of two equal ranks the left one
            # is older, so the right one is undone first; a joint merge of that rank starts at the border.
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, pairs = len(word), self.pairs
        last: list[tuple[int, int] | None] = [None] * n
        for end, (size, token) in self._ends(word):
            if last[end] is None:
                before = end - size
                if before < 0 or (last[before] is not None and pairs[last[before][1], token]):
                    last[end] = size, token
        ids, at = [], n - 1
        while at >= 0:
            size, token = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def _ends(self, word: bytes):
        return self.found.iter(word.decode("latin-1"))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoder:
    """Whole texts to ids and back. Chunks (a blank and what follows up to the next) repeat, so what
    they give is kept: ids as text, and the text that those ids decode to. No character is cut between
    two chunks, so decoding by chunk is decoding the whole."""

    def __init__(self, path: str, kept: int = KEPT):
        self.vocabulary = Vocabulary(path, kept)
        self.special = regex.compile("|".join(map(regex.escape, self.vocabulary.special)) or r"(?!)")
        self.words = Cache(lambda w: self._pack(self.vocabulary.encode_word(w.encode()), w), min(kept // 2, 100_000))
        self.chunks = Cache(self._chunk, kept)

    def _pack(self, ids: list[int], text: str) -> tuple[str, str]:
        """The ids as text, and what they decode to (the given object if equal, to save memory)."""
        decoded = self.vocabulary.decode(ids).decode("utf-8", "replace")
        return ",".join(map(str, ids)), text if decoded == text else decoded

    def _chunk(self, chunk: str) -> tuple[str, str]:
        found = SPLIT.findall(chunk)
        if len(found) == 1:
            return self._pack(self.vocabulary.encode_word(chunk.encode()), chunk)
        parts = [self.words[w] for w in found]
        decoded = "".join([p[1] for p in parts])
        return ",".join([p[0] for p in parts]), chunk if decoded == chunk else decoded

    def _plain(self, text: str) -> list[tuple[str, str]]:
        if _INNER_BLANK.search(text):
            return [self.words[w] for w in SPLIT.findall(text)]
        first, *rest = text.split(" ")
        get = self.chunks.__getitem__
        # text[0] == " " leaves an empty first piece; no chunk stands for it
        return ([get(first)] if first else []) + [get(" " + x) for x in rest]

    def parts(self, text: str) -> list[tuple[str, str]]:
        """Packed chunks of the text, in order."""
        if not self.special.search(text):
            return self._plain(text) if text else []
        out, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                out += self._plain(text[at : m.start()])
            out.append(self._pack([self.vocabulary.special[m[0]]], m[0]))
            at = m.end()
        return out + (self._plain(text[at:]) if at < len(text) else [])

    def decode(self, ids: list[int]) -> str:
        return self.vocabulary.decode(ids).decode("utf-8", "replace")

    def ids(self, text: str) -> list[int]:
        return [int(x) for p in self.parts(text) for x in p[0].split(",")]


def encoder(path: str, kept: int = KEPT) -> Encoder:
    return live(("bpe", path, kept), lambda: Encoder(path, kept))


def digest_texts(texts: list[str], path: str) -> dict[str, list]:
    out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    enc = encoder(path)
    for text in texts:
        ids, decoded = map(list, zip(*parts)) if (parts := enc.parts(text)) else ([], [])
        listed = ",".join(ids)
        out["n_tokens"].append(listed.count(",") + 1 if listed else 0)
        out["ids_sha256"].append(sha256(listed.encode()).hexdigest())
        out["decoded_sha256"].append(sha256("".join(decoded).encode()).hexdigest())
    return out


def encode_texts(texts: list[str], path: str) -> dict[str, list]:
    enc = encoder(path, KEPT_IN_PIPELINE)
    pa.default_memory_pool().release_unused()
    listed = [",".join([p[0] for p in enc.parts(t)]) for t in texts]
    ids = [np.fromstring(x, np.int32, sep=",") if x else np.empty(0, np.int32) for x in listed]
    same = [enc.decode(x.tolist()) == t for x, t in zip(ids, texts)]
    return {"ids": ids, "n_tokens": list(map(len, ids)), "exact": same}


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), their number, and whether they decode to exactly the text."""
    return map_texts(docs, functools.partial(encode_texts, path=path), "ids array<int>, n_tokens long, exact boolean")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give null."""
    out = encoded.sparkSession.createDataFrame([], "doc_id long, text string").schema

    def run(batches):
        for part in chunks(batches):
            texts = [None if x is None else encoder(path).decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=out.names)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, out)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return map_texts(docs, lambda texts: digest_texts(texts, path), "n_tokens long, ids_sha256 string, decoded_sha256 string")
