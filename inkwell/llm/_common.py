"""Helpers shared by the training-data operators: shipped code, written tables, byte views of text."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers must be able to import this package; on a cluster ship it with --py-files.
ROOT = str(Path(__file__).resolve().parents[2])
#: Arrow batches that a Python worker holds, unless the session says otherwise: they bound its memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}
#: Workers are reused from job to job: with these, large arrays go back to the system when they are freed.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": "33554432", "MALLOC_TRIM_THRESHOLD_": "67108864", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where they share a file system with the driver, and keep batches small."""
    for key, (usual, small) in BATCHES.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, small)
    env = spark.sparkContext.environment
    for key, value in MEMORY.items():
        env.setdefault(key, value)
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all is on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM is gone already
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there and survives lost executors.

    The files are removed when the driver's interpreter exits.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark).rstrip('/')}/inkwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def beside(docs: DataFrame, column: str = "text") -> DataFrame:
    """row (a struct of the other columns of docs), and the column: text crosses to Python once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != column]).alias("row"), column)


def rejoined(out: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of docs again, some of them new."""
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """64-bit key of a row. Rows that agree in id and text are copies and get the same answer from every operator."""
    return F.xxhash64(doc_id, text)


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has at most `most` bytes of text, or a single row."""
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column(text))[1])
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets); a null is an empty text."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]
