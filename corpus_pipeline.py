"""A corpus from raw documents: each stage takes (spark, docs, sf_dir) and returns what it kept.

`run` writes each stage's result as Parquet to the folder that the cluster shares and reads
it back for the next, so that a lost executor costs one stage's tasks at most. What the stage before had
written is deleted then, and the rest when the driver ends.

Defined cases: each stage keeps all columns of `documents` (and further ones) of the rows that it keeps, but for the last, which returns ids;
a null or empty text is not toxic, has no passage and no personal data, and 0 tokens; of several rows with such a text, or any one text, the smallest
doc_id stays; a row without doc_id stays through near_dedup; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relayloom.llm.bpe import bpe_encode
from relayloom.llm.common import delete_folder, table, work_folder
from relayloom.llm.decontaminate import drop_contaminated
from relayloom.llm.pii import redact
from relayloom.llm.simhash import drop_near_copies
from relayloom.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is trained on this stage's documents."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the smallest doc_id."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of all documents, and whether the ids decode to exactly the text."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("bpe", bpe),
]

#: Two stages (a trained model, fingerprints) are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            delete_folder(spark, last)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
