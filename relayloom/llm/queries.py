"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from relayloom.llm import chat, pii
from relayloom.llm.bpe import bpe_digests
from relayloom.llm.chat import format_turns, read_back
from relayloom.llm.common import table, work_folder
from relayloom.llm.decontaminate import contamination
from relayloom.llm.licenses import license_scan
from relayloom.llm.media import media_digests
from relayloom.llm.pii import pii_digests
from relayloom.llm.simhash import simhash_classes
from relayloom.llm.token_counts import token_counts
from relayloom.llm.token_files import token_file_digests, write_token_files
from relayloom.llm.toxicity import remainder, toxicity, train


#: Both texts of conversation -7, which is put to the table's.
ODD_TURN = r"\### Assistant: </turn> ok"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"), words=4, radius=4)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "token-files") + "/ids"
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_file_digests(spark, folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"), work_folder(spark, "media"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents with a benchmark passage have rows."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files at source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", ODD_TURN), (-7, 1, "assistant", ODD_TURN)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.unionByName(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_token_files, op3_toxicity, op4_media, op5_bpe, op6_decontaminate, op7_token_counts, op8_licenses, op9_pii, op10_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op9_pii": pii.oracle(), "op10_chat": chat.oracle(ODD_TURN)}
