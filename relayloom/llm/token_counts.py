"""Token counts with a whole-token shortcut.

`whole_tokens` proves, once and before any text is read, which vocabulary strings the
tokenizer encodes alone as one token. A text is split at white space (which this
tokenizer drops, so no token crosses it); a pre-token in the proven set counts 1 without
any merging, and only the others are merged, by the library. Pieces repeat, so their counts are kept in
a bounded cache per Python worker. No shuffle: a scan and a projection.

Defined cases: a null text counts as empty (0 tokens); a null doc_id is kept; special
strings inside a text count as the library's default has it; repeated rows each get a row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os

import regex
from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import Cache, live, map_texts

OVER = 2048

#: Pieces of these characters, which normalizing only lower-cases, each by itself, are split here: printable ASCII, and letters of
#: the Latin, Greek (but for capital sigma), Cyrillic, Armenian, Hebrew and Arabic scripts, kana, Han and Hangul. The library gets any other piece as a whole.
PLAIN = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-įı-žά-ώΑ-ΡΤ-ΩЀ-ѯԱ-Ֆա-ֆא-תء-ؿف-يぁ-ゖァ-ヺ一-鿿가-힣]+")
# The pre-tokenizer pattern that the tokenizer file declares.
PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@functools.lru_cache(4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(4)
def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that alone give exactly one token: a word-end vocabulary string whose
    merges, replayed by the library on the plain word, end in that one id."""
    spec = json.load(open(path))["model"]
    end = spec.get("end_of_word_suffix") or ""
    back = {c: b for b, c in enumerate(byte_chars())}
    words = {}
    for entry, i in spec["vocab"].items():
        if entry.endswith(end) and len(entry) > len(end):
            try:
                word = bytes(back[c] for c in entry[: len(entry) - len(end)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if PRE.fullmatch(word):
                words[word] = i
    found = load(path).encode_batch(list(words), add_special_tokens=False)
    return frozenset(w for w, e in zip(words, found, strict=True) if e.ids == [words[w]])


def counter(path: str) -> Cache:
    """Count of tokens by piece (bytes between white space)."""
    return live(("counts", path), lambda: _counter(path))


def _counter(path: str) -> Cache:
    tok, whole = load(path), whole_tokens(path)
    special = regex.compile("|".join(regex.escape(x.content) for x in tok.get_added_tokens_decoder().values()) or r"(?!)")

    def merged(word: str) -> int:
        return len(tok.encode(word, add_special_tokens=False).ids)

    def count(piece: bytes) -> int:
        text = piece.decode()
        if not PLAIN.fullmatch(text) or special.search(text):
            return merged(text)
        return sum(1 if p in whole else merged(p) for p in PRE.findall(text.lower()))

    return Cache(count, 600_000)


def count_texts(texts: list[str], path: str) -> dict[str, list]:
    count = counter(path).__getitem__
    raw = [t.encode() for t in texts]
    return {"n_bytes": list(map(len, raw)), "n_tokens": [sum(map(count, b.split())) for b in raw]}


def token_counts(docs: DataFrame, path: str, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    out = map_texts(docs, lambda texts: count_texts(texts, path), "n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > over)
