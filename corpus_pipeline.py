"""From raw documents to packed training sequences, in five stages; each is written and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: documents like the ones it got, and at last the
pieces of the packed sequences.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm._common import written
from inkwell.llm.decontaminate import remove_leaks
from inkwell.llm.near_copies import keep_one_copy
from inkwell.llm.packing import pack_documents, tokenizer_path
from inkwell.llm.pii import mask_pii
from inkwell.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group whose links are 5-word similarities of 0.8 or more."""
    return keep_one_copy(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text: contaminated ones go, a lone match is cut out of its document."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, tokenizer_path(), digest=zlib.crc32).withColumnRenamed("ids", "ids_crc32")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("private", private), ("pack", pack)]

#: Trees, trees of fingerprints and byte-pair encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
