"""What the operators of this subpackage share: tables, batches, work folders."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Texts handed to Python at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Rows that Spark hands to Python in one Arrow batch, unless the session says otherwise: whole texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS where they are at Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def two(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that further columns, of whatever name, can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes, so that Python objects stay small."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, int(rows * limit / max(batch.nbytes, 1))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def map_texts(docs: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: str) -> DataFrame:
    """doc_id and what `fn` makes of the texts (null: empty), row by row; `schema` names fn's columns."""
    out = docs.sparkSession.createDataFrame([], f"doc_id long, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for part in chunks(batches):
            made = fn([x or "" for x in part.column("text").to_pylist()])
            columns = [part.column("doc_id").cast(pa.int64())] + [pa.array(made[f.name], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return two(docs).mapInArrow(run, out)


class Cache(dict):
    """What `make` gives for each key; holds two generations of at most `most` keys."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def known(self, keys: set) -> tuple[dict, list]:
        """What is known of these keys, and the keys that are not."""
        get, old = self.get, self.old
        found = {k: v for k in keys if (v := get(k)) is not None}
        if old and len(found) < len(keys):
            again = {k: old[k] for k in keys if k not in found and k in old}
            self.update_all(again)
            found |= again
        return found, [k for k in keys if k not in found]

    def update_all(self, made: dict) -> None:
        """Put many at once, however many."""
        if len(self) + len(made) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(made)


_live: dict[tuple, object] = {}


def live(key: tuple, make: Callable[[], object]):
    """What `make` gives, kept until another key is asked for: a Python worker outlives its tasks, and
    the caches of one operator must not stay beside those of the next."""
    if key not in _live:
        _live.clear()
        _give_back()
        _live[key] = make()
    return _live[key]


def _give_back() -> None:
    """Give the system what nothing holds any more: objects that refer to each other, as caches and what fills them, are found by
    the collector only, and Arrow and the C library keep freed memory for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there in glibc
    if trim is not None:
        trim(0)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; the cluster names it in spark.checkpoint.dir. It is deleted when the driver ends."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _ends_with_driver(spark, folder)
    return folder


def _ends_with_driver(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a work folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, set for this session; where the cluster names none, a local folder, for tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints/relayloom"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
        _ends_with_driver(spark, sc._jsc.sc().getCheckpointDir().get())  # Spark's own folder in there, of this driver alone
    return where.rstrip("/")
