"""SimHash near-duplicates, compared on vertical bit planes.

A text's words (split at ASCII white space, A-Z lower-cased) give shingles, repeats
included; a fingerprint bit is 1 if it is set in over half of the shingles' hashes. Equal
fingerprints are one class (wide ones are of the distinct shingles, so that a repeated line does not fix
every bit, and there a class is one set of shingles, by its digest). Classes that may be near each other meet in buckets, where
`bitslice.forest` links those within the radius; `components` joins the links.

Two ways to buckets, neither of which drops a case:
* radius below 8, 64 bits (`exact`): the 64 bits are cut into pieces; two fingerprints
  within the radius agree on all but `radius` pieces, so a table for each choice of the
  other pieces misses no pair. There are as many pieces as keep a mean bucket small for
  the number of classes there are.
* wider fingerprints (`similar`): classes meet that share one of the 8 smallest shingle
  hashes. At similarity s a pair shares none of them with probability (1 - s)^8, 3 in a
  million at 0.8.
A bucket of over `BUCKET` classes is divided by further keys, of which no pair that counts is lost: by pieces of the bits that its
classes need not agree on, all that are within the radius meet again; or the first fifth (and one) of each set's hashes are its keys, those that
many of these sets have last: whatever the order, two sets of similarity 0.8 or more share one of them. What is over `BUCKET` still is cut into
chunks by a hash, and each pair of chunks is a group of its own, so no task holds more than two chunks, and no pair is lost.

Wide fingerprints only lead to pairs. What lies within their radius is joined to components, of which
pairs of similarity 0.8 never leave; the shingle sets of those with company are made again from the texts,
meet in their component, and a pair is a link if the exact Jaccard similarity of its sets is at least 0.8. A very large component is divided by
the first fifth of the hashes, too, so that sizes of buckets and components decide on the work, and not on a pair of similarity 0.8 or more that shares one of
the 8 smallest hashes. One that shares none (3 in a million) is a link if other texts bring it into one component, which may depend on those sizes.

Defined cases: null or blank texts have fingerprint 0 and are linked like any other (`similar`: to
their equals only, having no shingle to share); ties
go to the smallest doc_id; a row whose doc_id is null gets the class of its fingerprint (or set),
null if no row with an id is in that class; rows with one doc_id twice are two rows; an
empty table gives an empty result; further columns are ignored by the fingerprint tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from relayloom.llm.bitslice import forest
from relayloom.llm.common import checkpoint_dir, chunks, live, map_texts, two
from relayloom.llm.components import components

BUCKET = 4096
SMALLEST = 8
#: Words of 64 bits of a wide fingerprint, and the bits in which candidates differ at most: sets of similarity 0.8
#: differ in 155 on average, or 192 at worst (four shingles of five); five standard deviations of 12.5 are added.
WIDE, NEAR_WIDE = 16, 256
#: Shingle hashes, and so many more for each text, that are compared at once with those of another chunk.
CHUNK, EACH = 1 << 20, 256
#: So many chunks in a component before it is divided by shingle hashes.
CHUNKS = 64
#: So many classes' ids go to all executors at most, and so many hashes that come last in the order of keys (the most frequent ones).
BROADCAST, LAST = 1_000_000, 100_000
_GOLDEN = 0x9E3779B97F4A7C15  # fixed value: 2^64 over the golden ratio


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle; of the whole sequence if it is shorter."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, of = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([of(joined, 42)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    return np.array([of(joined[a:b], 42) for a, b in zip(start[: 1 - words].tolist(), end[words - 1 :].tolist())], np.uint64)


def _spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits drawn from each hash; the hash itself at 0."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """Of each bit, in how many hashes it is set. Up to 255 rows are added eight columns to a word."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    whole = len(bits) // 255 * 255
    sums = [bits[:whole].reshape(-1, 255, 8).sum(1), bits[whole:].sum(0, keepdims=True)]
    return sum(x.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64) for x in sums)


def fingerprint(hashes: np.ndarray, words64: int = 1) -> np.ndarray:
    out = np.zeros(words64, np.uint64)
    for k in range(words64):
        count = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            count += _ones(_spread(hashes[at : at + (1 << 14)], k))
        out[k] = np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def digest(distinct: np.ndarray) -> bytes:
    """Of a set of shingle hashes: equal for equal sets only (128 bits)."""
    return xxhash.xxh3_128_digest(distinct.tobytes())


def first_fifth(hashes: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Of ascending distinct hashes, with those in `last` (ascending) put last: so many of the first that any two sets of similarity 0.8 or more share one.

    Such sets have four fifths of either in common at least, so the first hash in common has that many after it (itself counted) in both."""
    if last is not None and len(last) and len(hashes):
        late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
        hashes = np.r_[hashes[~late], hashes[late]]
    return hashes[: len(hashes) // 5 + 1]


def fingerprints(docs: DataFrame, words: int, words64: int = 1, keyed: bool = False) -> DataFrame:
    """doc_id, bits (64-bit words, low first) and, if keyed, the digest and the smallest of the distinct
    shingle hashes, which the bits are of then."""

    def of(texts: list[str]) -> dict[str, list]:
        live(("shingles",), dict)  # nothing is kept here, nor what was kept before
        out = {"bits": [], "same": [], "keys": []}
        for text in texts:
            hashes = shingle_hashes(text, words)
            if keyed:
                hashes = np.unique(hashes)
                out["same"].append(digest(hashes))
                out["keys"].append(hashes[:SMALLEST].view(np.int64).tolist())
            out["bits"].append(fingerprint(hashes, words64).tobytes())
        return out if keyed else {"bits": out["bits"]}

    return map_texts(docs, of, "bits binary" + ", same binary, keys array<long>" * keyed)


def piece_masks(classes: int, radius: int, bucket: int = BUCKET) -> list[int]:
    """Bit masks of the tables for so many classes: any two fingerprints within the radius agree on one."""
    for pieces in range(radius + 1, radius + 5):
        cuts = [64 * k // pieces for k in range(pieces + 1)]
        agree = pieces - radius
        if classes <= bucket << (64 * agree // pieces) or pieces == radius + 4:
            spans = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
            return [sum(c) for c in combinations(spans, agree)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_bits(radius: int):
    """Finds the links of rows with bits, for `link_runs`."""

    def find(rows: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(rows.num_rows, -1), group, radius)

    return find


def alike(size_a, size_b, common):
    """Whether sets of such sizes with so many members in common have a Jaccard similarity of 0.8 or more."""
    return 9 * common >= 4 * (size_a + size_b)


def near_sets(rows: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finds the links of rows with sets, for `link_runs`: every pair of a group is compared, unless other links join it already."""
    label = np.arange(rows.num_rows)
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    for own in np.split(label.copy(), np.flatnonzero(group[1:] != group[:-1]) + 1):
        own = own[np.argsort(size[own], kind="stable")]
        found, of = np.unique(np.concatenate([sets[k] for k in own]), return_inverse=True)
        members = np.split(of.astype(np.int32), np.cumsum(size[own])[:-1])
        here, mark, n = label[own], np.zeros(len(found), np.uint8), size[own]
        for k in range(len(own) - 1):
            other = np.arange(k + 1, np.searchsorted(n, n[k] * 5 // 4, "right"))  # larger ones are less alike
            other = other[here[other] != here[k]]
            if len(other):
                mark[members[k]] = 1
                start = np.cumsum(n[other]) - n[other]
                common = np.add.reduceat(mark[np.concatenate([members[x] for x in other])], start, dtype=np.int64)
                mark[members[k]] = 0
                hit = other[alike(n[k], n[other], common)]
                if len(hit):
                    joined = np.append(here[hit], here[k])
                    here[np.isin(here, joined)] = joined.min()
        label[own] = here
    linked = np.flatnonzero(label != np.arange(len(label)))
    return label[linked], linked


def link_runs(find: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """For mapInArrow over rows (t, key, part, rep, ...) sorted by the first three: links that `find` makes in each run."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        k = [rows[c].to_numpy() for c in ("t", "key", "part")]
        new = np.r_[False, np.any([x[1:] != x[:-1] for x in k], axis=0)]
        rep = rows["rep"].to_numpy()
        a, b = find(rows, np.cumsum(new))
        return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= 10_000 or sum(x.nbytes for x in held) >= 2 * CHUNK:
                rows = pa.Table.from_batches(held)
                k = [rows[c].to_numpy() for c in ("t", "key", "part")]
                cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0))
                if len(cut):
                    at = int(cut[-1]) + 1
                    yield solve(rows.slice(0, at))
                    held = rows.slice(at).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _sized(rows: DataFrame, weight: Column) -> DataFrame:
    """t, key, size of the keys that several rows have."""
    return rows.groupBy("t", "key").agg(F.sum(weight).alias("size"), F.count("*").alias("members")).where("members > 1").drop("members")


def _links(candidates: DataFrame, find: Callable, what: str, weight: Column, most: int, finer: Callable[[DataFrame], DataFrame] | None = None, more: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that `find` makes by the column `what` among the candidates (t, key, rep, what) of one (t, key) each.

    Keys of a single candidate go first, before columns of `more` (by rep) come to the others. Those of an overfull bucket
    get the keys that `finer` gives them, of which all that may be links share one, and what is overfull still is cut into chunks."""
    size = _sized(candidates, weight).checkpoint()
    met = candidates.join(size, ["t", "key"])
    if more is not None:
        met = met.join(more, "rep")
    columns = ["t", "key", "rep", what, "size"]
    if finer is not None and not size.where(F.col("size") > most).isEmpty():
        again = finer(met.where(F.col("size") > most))
        met = met.where(F.col("size") <= most).select(*columns).unionByName(again.join(_sized(again, weight), ["t", "key"]).select(*columns))
    met = met.withColumn("chunks", F.when(F.col("size") > most, F.ceil(F.col("size") / most).cast("int")))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep", what), F.col("chunks")).cast("int"))
    part = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(o, F.col("own")) * F.col("chunks") + F.greatest(o, F.col("own")))
    part = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.filter(part, lambda p: p != F.col("own") * F.col("chunks") + F.col("own")))
    dealt = met.select("t", "key", F.explode(part).alias("part"), "rep", what)
    dealt = dealt.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part")
    return dealt.mapInArrow(link_runs(find), "a long, b long")


def _value(bits: str) -> Column:
    """A fingerprint of 64 bits as a number."""
    low_first = F.concat(*[F.substring(F.hex(bits), 15 - 2 * k, 2) for k in range(8)])
    return F.conv(low_first, 16, -10).cast("long")


def _finer_pieces(masks: list[int], radius: int):
    """More keys for what agrees on a mask's bits: its other bits are cut into radius + 1 pieces, on one of which two within the radius agree."""
    cuts = []
    for mask in masks:
        free = [b for b in range(64) if not mask >> b & 1]
        spans = [free[len(free) * k // (radius + 1) : len(free) * (k + 1) // (radius + 1)] for k in range(radius + 1)]
        cuts.append([sum(1 << b for b in span) for span in spans])
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in cuts])

    def finer(hot: DataFrame) -> DataFrame:
        pieces = F.posexplode(F.element_at(table, F.col("t") + 1)).alias("k", "m")
        each = hot.select("t", "key", "rep", "bits", pieces)
        key = F.xxhash64("t", "key", _value("bits").bitwiseAND(F.col("m")))
        return each.select((F.lit(len(masks)) + F.col("k")).alias("t"), key.alias("key"), "rep", "bits")

    return finer


def _finer_hashes(docs: DataFrame, words: int, most: int):
    """More keys for what shares a shingle hash with too many: the first fifth of its hashes, those last that over `most` of these sets have."""

    def finer(hot: DataFrame) -> DataFrame:
        wanted = hot.select("rep", "same").distinct().checkpoint()
        all_of = _of_sets(docs, wanted, words, "key long", lambda row, hashes: {"key": hashes.view(np.int64)})
        often = all_of.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).orderBy(F.desc("n"), "key").limit(LAST)
        last = np.sort(np.array([r.key for r in often.select("key").collect()], np.int64).view(np.uint64))
        keys = _of_sets(docs, wanted, words, "rep long, key long", lambda row, hashes: {"rep": np.full(len(k := first_fifth(hashes, last).view(np.int64)), row["rep"]), "key": k})
        keys = keys.select(F.lit(1).alias("t"), "key", "rep").checkpoint()
        met = keys.join(_sized(keys, F.lit(1)).select("t", "key"), ["t", "key"])
        return met.join(hot.select("rep", "bits").distinct(), "rep").select("t", "key", "rep", "bits")

    return finer


def _classes(docs: DataFrame, words: int, words64: int, keyed: bool, radius: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, bits), their classes (bits, rep), and (node, component) of the classes that fingerprints link; if
    keyed, rows have `same` besides, and a class is one of it."""
    checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, words, words64, keyed).checkpoint()
    least = [F.min("doc_id").alias("rep")] + [F.min_by("keys", "doc_id").alias("keys")] * keyed
    classes = rows.where("doc_id is not null").groupBy(*["same"] * keyed, "bits").agg(*least).checkpoint()
    one = F.lit(1)
    if keyed:
        candidates = classes.select(F.lit(0).alias("t"), F.explode("keys").alias("key"), "rep")
        return rows, classes, components(_links(candidates, near_bits(radius), "bits", one, bucket, _finer_hashes(docs, words, bucket), classes.select("rep", "bits", "same")))
    masks = piece_masks(classes.count(), radius, bucket)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("v").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    candidates = classes.withColumn("v", _value("bits")).select(F.explode(keys).alias("k"), "rep", "bits").select("k.t", "k.key", "rep", "bits")
    return rows, classes, components(_links(candidates, near_bits(radius), "bits", one, bucket, _finer_pieces(masks, radius)))


def _of_sets(docs: DataFrame, wanted: DataFrame, words: int, schema: str, make: Callable[[dict, np.ndarray], dict]) -> DataFrame:
    """Columns that `make` gives for each class wanted (rep, same, ...) and its distinct shingle hashes, ascending. They are
    made again from the texts: kept for all texts, they would take more room than these."""
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    texts = two(docs).join(wanted, F.col("doc_id") == F.col("rep")).select(*wanted.columns, "text")
    out = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for part in chunks(batches):
            made = []
            for row in part.to_pylist():
                hashes = np.unique(shingle_hashes(row["text"] or "", words))
                if digest(hashes) == row["same"]:  # else another row with this id
                    made.append(make(row, hashes))
            if made:
                columns = [pa.concat_arrays([pa.array(m[f.name], f.type) for m in made]) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return texts.mapInArrow(run, out)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """component, rep, n, keys (the first fifth) and hashes: the distinct shingle hashes, ascending, of the classes wanted (component, rep, same)."""

    def make(row: dict, hashes: np.ndarray) -> dict:
        return {"component": [row["component"]], "rep": [row["rep"]], "n": [len(hashes)], "keys": [first_fifth(hashes).view(np.int64)], "hashes": [hashes.tobytes()]}

    return _of_sets(docs, wanted, words, "component long, rep long, n long, keys array<long>, hashes binary", make)


def _confirmed(sets: DataFrame, chunk: int) -> DataFrame:
    """Links (a, b) that connect just what pairs of one component with a similarity of 0.8 or more connect. A component of
    many chunks is cut by the first fifth of the hashes, one of which all such pairs share."""
    sets = sets.checkpoint()
    weight = F.col("n") + EACH
    large = sets.groupBy("component").agg(F.sum(weight).alias("size")).where(F.col("size") > CHUNKS * chunk)
    keys = F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.col("keys"))
    met = sets.join(large, "component", "left").select(F.col("component").alias("t"), F.explode(keys).alias("key"), "rep", "n", "hashes")
    return _links(met, near_sets, "hashes", weight, chunk)


def _joined(classes: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """classes, known by the column `by`, with component_id."""
    return classes.join(found, F.col("rep") == F.col("node"), "left").select(by, F.coalesce("component", "rep").alias("component_id"))


def _hex(bits, words64: int):
    return F.lower(F.concat(*[F.substring(F.hex(bits), 16 * words64 - 1 - 2 * k, 2) for k in range(8 * words64)]))


def simhash_classes(docs: DataFrame, words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: 64 bits, exact within the radius."""
    if not 0 <= radius < 8:
        raise ValueError("radius must be 0 to 7; near_classes takes wider fingerprints")
    rows, classes, found = _classes(docs, words, 1, False, radius, bucket)
    return rows.join(_joined(classes, found, "bits"), "bits", "left").select("doc_id", _hex(F.col("bits"), 1).alias("fingerprint"), "component_id")


def near_classes(docs: DataFrame, words: int = 5, radius: int = NEAR_WIDE, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (256 hex digits), component_id: 1024 bits, for texts whose shingles are 0.8 or more alike."""
    rows, classes, met = _classes(docs, words, WIDE, True, radius, bucket)
    wanted = classes.join(met, F.col("rep") == F.col("node")).select("component", "rep", "same")
    found = components(_confirmed(_sets(docs, wanted, words), chunk))
    return rows.select("doc_id", "bits", "same").join(_joined(classes, found, "same"), "same", "left").select("doc_id", _hex(F.col("bits"), WIDE).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, radius: int = NEAR_WIDE) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is the smallest of its class (rows without an id stay)."""
    gone = near_classes(two(docs), words, radius).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct().checkpoint()
    if gone.count() <= BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
