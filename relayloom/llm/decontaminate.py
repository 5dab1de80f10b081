"""Benchmark passages in documents, up to an error budget: pigeonhole pieces and Myers' distance.

Items and texts are taken as their words (runs of letters and digits, lower-cased) joined
by single blanks. An item of n characters may differ in k = n * rate edits from a run of whole words: `cat` is
not in `concatenate`. It is cut into k + 1 pieces: k edits leave one piece untouched, so every occurrence shows an exact piece.
One automaton over the pieces of all items reads a text once; around each hit lies a window
in which the item may be, overlapping windows of an item are joined, and Myers' bit-parallel
scan gives the least distance at every end in them. So no text is read more than once for
all items and once for each item that has a piece in it.

Items of fewer than `LEAST_WORDS` words are not looked for, as such words stand in documents by chance.

Items are a query set: they come to the driver in blocks of about `BLOCK_CHARS` characters, one block at a time, and
each block is one scan of the documents; its automaton is built where the documents are. With more than one block, what a scan found is written
before the next. No shuffle of texts, whatever passages documents share.

Defined cases: null texts and ids: an item without enough words or id is not looked for; a document
without words has no match; a null doc_id is kept in matches; repeated items and documents
each give rows; an empty table gives an empty result; further columns are ignored
(drop_contaminated keeps them).
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relayloom.llm.common import chunks, live, small_batches, work_folder

WORD = re.compile(r"[^\W_]+")
RATE = 0.08
LEAST_WORDS = 4
BLOCK_CHARS = 1 << 20
#: So many rows to drop are broadcast at most.
BROADCAST = 1_000_000


def normal(text: str) -> str:
    return " ".join(WORD.findall(text)).lower()


class Pattern:
    """One item for Myers' scan; an integer holds a whole column of differences, a bit a character."""

    def __init__(self, text: str):
        self.size, self.full, self.top = len(text), (1 << len(text)) - 1, 1 << (len(text) - 1)
        self.equal: dict[str, int] = defaultdict(int)
        for k, c in enumerate(text):
            self.equal[c] |= 1 << k
        self.equal = dict(self.equal)

    def distances(self, text: str, whole: bool = False) -> Iterator[int]:
        """At each character: the least distance of the item to a piece of text that ends there, or that to all of the text up to there."""
        full, top, get, first = self.full, self.top, self.equal.get, int(whole)
        plus, minus, score = full, 0, self.size
        for c in text:
            equal = get(c, 0)
            down = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(across | plus))
            less = plus & across
            if up & top:
                score += 1
            elif less & top:
                score -= 1
            up = (up << 1 | first) & full
            plus = (less << 1 & full) | (full & ~(down | up))
            minus = up & down
            yield score


class Items:
    """The automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least_words: int = LEAST_WORDS):
        self.items, where = [], defaultdict(list)
        for item_id, text in items:
            plain = normal(text or "")
            if item_id is None or plain.count(" ") + 1 < least_words:
                continue
            errors = int(len(plain) * rate)
            cuts = [len(plain) * k // (errors + 1) for k in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                where[plain[a:b]].append((len(self.items), a))
            self.items.append((item_id, plain, errors))
        self.found = ahocorasick.Automaton()
        for piece, at in where.items():
            self.found.add_word(piece, (len(piece), tuple(at)))
        if where:
            self.found.make_automaton()
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        out: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.found.iter(text):
            for k, offset in at:
                _, plain, errors = self.items[k]
                first = max(0, end + 1 - size - offset - errors)
                last = end + 1 - size - offset + len(plain) + errors
                own = out.setdefault(k, [])
                if own and first <= own[-1][1]:  # ends come in order, so first never falls far behind
                    own[-1][0], own[-1][1] = min(own[-1][0], first), max(own[-1][1], last)
                else:
                    own.append([first, last])
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) in text, code points: the best of each run of ends within the budget."""
        if not self.items:
            return []
        words = WORD.findall(text)
        plain = " ".join(words).lower()
        out = []
        for k, windows in self._windows(plain).items():
            item_id, item, errors = self.items[k]
            if k not in self.patterns:
                self.patterns[k] = Pattern(item), Pattern(item[::-1])
            ahead, back = self.patterns[k]
            for first, last in _joined(windows):
                window, ends = plain[first:last], []
                for end, d in enumerate(ahead.distances(window), 1):
                    if d <= errors:
                        if first + end == len(plain) or plain[first + end] == " ":
                            ends.append((d, end))
                    elif ends:
                        out += _best(item_id, ends, back, plain, first, errors)
                        ends = []
                if ends:
                    out += _best(item_id, ends, back, plain, first, errors)
        if not out:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        word = lambda at: min(plain.count(" ", 0, at), len(places) - 1)
        return sorted((i, d, places[word(a)][0], places[word(b - 1)][1]) for i, d, a, b in out)


def _joined(windows: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(windows):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _best(item_id: int, ends: list[tuple[int, int]], back: Pattern, plain: str, first: int, errors: int) -> list[tuple[int, int, int, int]]:
    """Of ends of whole words, in the window of plain from `first`, that lie within one run: the match of whole words with the least distance, if any.

    The distance to an end is the least over all starts, so it bounds that over starts of words from below."""
    best: tuple[int, int, int] | None = None
    for d, end in sorted(ends):
        if best is not None and d >= best[0]:
            break
        text = plain[max(0, first + end - back.size - errors) : first + end]
        for k, far in enumerate(back.distances(text[::-1], whole=True), 1):
            at = first + end - k
            if far <= errors and (best is None or far < best[0]) and (at == 0 or plain[at - 1] == " "):
                best = far, at, first + end
    return [] if best is None else [(item_id, *best)]


def _blocks(benchmark: DataFrame, rate: float) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """Items in blocks, each with a name; only one is on the driver at a time."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // BLOCK_CHARS) + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield uuid.uuid4().hex, [tuple(r) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect()]


_SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both, alone."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))


def _scan(docs: DataFrame, name: str, rows: list[tuple[int, str]], rate: float) -> DataFrame:
    out = docs.sparkSession.createDataFrame([], f"key long, {_SCHEMA}").schema

    def run(batches):
        for part in chunks(batches):
            items = live(("benchmark", name), lambda: Items(rows, rate))
            ids, texts, keys = (part.column(c).to_pylist() for c in ("doc_id", "text", "key"))
            found = [(key, i, *m) for key, i, t in zip(keys, ids, texts) if t for m in items.matches(t)]
            if found:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=out.names)

    return _keyed(docs).mapInArrow(run, out)


def _found(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """Matches of all blocks. One block is a scan that is still to be run; of several, each is written first."""
    blocks = _blocks(benchmark, rate)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(docs, *first, rate)
    folder, parts = work_folder(docs.sparkSession, "benchmark"), []
    for k, (name, rows) in enumerate(_chained(first, second, blocks)):
        _scan(docs, name, rows, rate).write.parquet(f"{folder}/{k}")
        parts.append(docs.sparkSession.read.parquet(f"{folder}/{k}"))
    return reduce(DataFrame.unionAll, parts)


def _chained(first, second, rest) -> Iterator:
    yield first
    del first
    yield second
    del second
    yield from rest


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each place where an item stands in a document: doc_id, item_id, distance (edits),
    start and end (code points of the text, end exclusive; of the whole words in which it lies)."""
    return _found(docs, benchmark, rate).drop("key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, with all columns, in which no item stands."""
    blocks = _blocks(benchmark, rate)
    (name, rows), second = next(blocks), next(blocks, None)
    if second is None:

        def run(batches):
            for part in chunks(batches):
                items = live(("benchmark", name), lambda: Items(rows, rate))
                yield part.filter(pa.array([not (t and items.matches(t)) for t in part.column("text").to_pylist()], pa.bool_()))

        small_batches(docs.sparkSession)
        return docs.mapInArrow(run, docs.schema)
    gone = _found(docs, benchmark, rate).select(F.col("key").alias("__gone")).distinct()
    if gone.count() <= BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")) == F.col("__gone"), "left_anti")
