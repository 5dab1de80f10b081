"""Token ids in compressed binary frames: an adaptive context-mixing range coder.

Ids of documents, each with an end id, stand one after another in ascending doc_id order. They
are cut into blocks of `BLOCK` ids. Every block starts from the same empty model, is range
coded by itself and carries a checksum, so any block can be read alone.

The model of a block, all in integers so that reading repeats writing exactly, learns at every id:
* order 2 guesses the id that last followed the last two, order 1 the one that mostly followed the last one;
* whether a guess is right is one binary decision. What each order knows about it (how often guesses of such
  a confidence were right, for orders 2 and 1; how frequent the guessed id is, for order 0) is mixed in the logistic
  domain, by weights that learn from the outcomes;
* an id that neither guessed is coded by order 0: adaptive counts of the ids that the block had so far, and of new ones, which
  follow in 16 bits.

An id takes its turn after the one before it, which is a loop that neither SQL functions nor numpy can
run side by side at a fair price. It is plain Java, `TokenCoder.java`: Spark's own compiler builds it on the driver when it is first
used, Spark ships it to the executors, and it is called as a function of binary columns. Tokenizing is done by the library.

A frame holds whole documents and all their blocks; frames are rows of a Parquet folder in the order of (part,
seq), beside the ids, starts and lengths of their documents, so files are written and read by Spark on whatever store it uses, task attempts are
committed once, and a lost executor costs its tasks only. No step holds more than a frame (about `FRAME` bytes of text, or one
longer document).

Defined cases: a null text is empty, its document the end id alone; rows with a null doc_id come first;
equal doc_ids go by text; an empty table gives an empty result; further columns are ignored;
a damaged frame or block, or a list of documents that was changed, is an error.
"""

from __future__ import annotations

import re
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from relayloom.llm.common import Cache, chunks, live, two
from relayloom.llm.token_counts import load

#: Ids of a block (also in TokenCoder.Pack), and bytes of text that are made one frame.
BLOCK = 1 << 16
FRAME = 8 << 20
END = 2
#: Pre-tokens whose ids a Python worker keeps, twice at most.
WORDS = 500_000
#: Parts whose first positions are broadcast at most; there is one for each task that wrote.
BROADCAST = 100_000


def register_coder(spark: SparkSession) -> None:
    """Make the functions token_pack (16-bit ids to a frame) and token_unpack (back) known to the session."""
    sc, session = spark.sparkContext, spark._jsparkSession
    made = getattr(sc, "_relayloom_coder", None)
    if made is None:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name("TokenCoder.java").read_text())
        target = Path(tempfile.mkdtemp()) / "token-coder.jar"
        with zipfile.ZipFile(target, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(str(target))  # executors load it from there
        made = sc._relayloom_coder = compiler.getClassLoader()
    for name in ("Pack", "Unpack"):
        function = made.loadClass(f"relayloom.TokenCoder${name}").newInstance()
        session.udf().register(f"token_{name.lower()}", function, session.parseDataType('"binary"'))


#: Texts of these characters are split here; the library gets any other text as a whole.
_PLAIN = r"[\t-\r\x20-\x7eÀ-ÖØ-öø-įı-ž]*"
#: The tokenizer's pre-token pattern on such texts in lower case, where these are all the letters and digits.
_PRE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+"


def _distinct(cut: pa.ListArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The values of all lists, each distinct one once, and where the lists begin and end."""
    ends = cut.offsets.to_numpy()
    return cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode(), ends - ends[0]


class Tokens:
    """Ids of many texts at once. White space, which this tokenizer drops, cuts texts into pieces; Arrow finds the distinct pieces
    of a batch, cuts these into pre-tokens, finds the distinct ones of them, and puts their ids in the places of pre-tokens and
    pieces. A pre-token's ids are kept.

    The library encodes what is new in a batch in one go: pre-tokens joined by blanks,
    whose ids are told apart by the word-end mark that the last token of each has."""

    def __init__(self, path: str):
        self.library = load(path)
        # Pre-tokens of plain texts are normal already: lower case, and of characters that don't combine.
        self.of_words = Tokenizer.from_str(self.library.to_str())
        self.of_words.normalizer = None
        ends = np.zeros(self.library.get_vocab_size(), bool)
        for entry, i in self.library.get_vocab().items():
            ends[i] = entry.endswith("</w>")
        self.ends = ends
        self.special = "|".join(re.escape(x.content) for x in self.library.get_added_tokens_decoder().values())
        self.words = Cache(None, WORDS)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has (the empty string: none)."""
        parts = list(map(self.words.get, words))
        holes = [k for k, p in enumerate(parts) if p is None]
        known, new = self.words.known({words[k] for k in holes} - {""})
        known[""] = b""
        for at in range(0, len(new), 100_000):
            some = new[at : at + 100_000]
            joined = [" ".join(some[k : k + 200]) for k in range(0, len(some), 200)]
            ids = np.array([i for e in self.of_words.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.uint16)
            raw, cuts = ids.tobytes(), (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some):
                raise ValueError("this vocabulary marks no word ends")
            made = {w: raw[a:b] for w, a, b in zip(some, [0, *cuts], cuts)}
            self.words.update_all(made)
            known |= made
        for k in holes:
            parts[k] = known[words[k]]
        return np.frombuffer(b"".join(parts), np.uint16), np.fromiter(map(len, parts), np.int64, len(parts)) // 2

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts."""
        pieces, by_text = _distinct(pc.utf8_split_whitespace(pc.utf8_lower(texts)))
        marked = pc.replace_substring_regex(pieces.dictionary, _PRE, r"\0 ")
        words, by_piece = _distinct(pc.split_pattern(pc.utf8_rtrim(marked, " "), " "))
        ids, size = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        for coded, parts in ((words, by_piece), (pieces, by_text)):  # ids of pieces, then of texts
            ids = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(size)], ids).take(coded.indices).flatten().to_numpy()
            size = np.diff(np.r_[0, np.cumsum(size[coded.indices.to_numpy()])][parts])
        return ids, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after another, and how many each has."""
        texts = texts.fill_null("")
        plain = pc.match_substring_regex(texts, rf"\A{_PLAIN}\z")
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(texts, self.special))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        ids, easy = self._split(texts.filter(plain)) if len(odd) < len(texts) else (np.empty(0, np.uint16), np.empty(0, np.int64))
        if not len(odd):
            return ids, easy
        found = [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        lengths = np.zeros(len(texts), np.int64)
        lengths[plain.to_numpy(zero_copy_only=False)] = easy
        # Odd texts are put between the others.
        before = np.cumsum(lengths)[odd]
        ids = np.concatenate([x for a, b, own in zip(np.r_[0, before], before, found) for x in (ids[a:b], own)] + [ids[before[-1] :]])
        lengths[odd] = list(map(len, found))
        return ids, lengths


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    return live(("token files", path), lambda: Tokens(path)).encode(texts)


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows of so many bytes or more; fewer at the end."""
    held, size = [], 0
    for batch in chunks(batches, least):
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_DOCUMENTS = "doc_ids array<long>, starts array<long>, lengths array<int>, documents_crc32 long"


def _documents_crc32(doc_ids: list, starts: np.ndarray, lengths: np.ndarray) -> int:
    """Of the documents of a frame: ids, which of them are null, starts, lengths."""
    ids = np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], np.uint8)
    return zlib.crc32(b"".join(x.tobytes() for x in (*ids, np.asarray(starts, "<i8"), np.asarray(lengths, "<i4"))))


def write_token_files(docs: DataFrame, path: str, folder: str) -> None:
    """Tokenize, append the end id, and write frames to folder. `starts` count from the first id of a part."""
    register_coder(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], f"part int, seq int, n_ids long, {_DOCUMENTS}, ids binary").schema
    rows = two(docs).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(out), TaskContext.get().partitionId()
        if load(path).get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        seq = at = 0
        for some in _gathered(batches, FRAME):
            ids, lengths = encode_texts(some["text"].combine_chunks(), path)
            ids = np.insert(ids, np.cumsum(lengths), END)
            lengths += 1
            doc_ids, starts = some["doc_id"].to_pylist(), at + np.cumsum(lengths) - lengths
            values = [part, seq, len(ids), doc_ids, starts, lengths, _documents_crc32(doc_ids, starts, lengths), ids.astype("<u2").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)
            seq, at = seq + 1, at + len(ids)

    framed = rows.mapInArrow(run, out).withColumn("frame", F.call_function("token_pack", "ids")).drop("ids")
    framed.write.option("compression", "none").parquet(folder)


def _read(spark: SparkSession, folder: str, describe, schema: str) -> DataFrame:
    """describe(ids of a document) for each document, with doc_id, start and n_tokens."""
    register_coder(spark)
    frames = spark.read.parquet(folder)
    ids = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a part: no more than write tasks
    first = ids.select(F.col("part").alias("__part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    if ids.count() <= BROADCAST:
        first = F.broadcast(first)
    joined = frames.join(first, F.col("part") == F.col("__part"))
    read = joined.select("first", "doc_ids", "starts", "lengths", "documents_crc32", F.call_function("token_unpack", "frame").alias("ids"))
    out = spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for some in chunks(batches):
            for row in some.to_pylist():
                starts, lengths, ids = np.array(row["starts"]), np.array(row["lengths"], np.int64), np.frombuffer(row["ids"], "<u2")
                if row["documents_crc32"] != _documents_crc32(row["doc_ids"], starts, lengths) or len(ids) != lengths.sum():
                    raise ValueError("damaged documents")
                each = np.split(ids, np.cumsum(lengths)[:-1])
                for a in range(0, len(each), 10_000):
                    cut = slice(a, a + 10_000)
                    columns = [row["doc_ids"][cut], row["first"] + starts[cut], lengths[cut], [describe(x) for x in each[cut]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return read.mapInArrow(run, out)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids."""
    return _read(spark, folder, lambda x: x.astype(np.int32), "ids array<int>")


def token_file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    return _read(spark, folder, lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32 long")
