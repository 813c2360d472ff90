"""Retrieval of chunks: exact nearest neighbours, keywords, and both fused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guard import Leak, Matcher
from .search import canonical_space, fuse, keyword_search, ranked

CANDIDATES, TOP_K = 20, 6
#: English words that a lexical search leaves out (fixed values of a common short list).
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def dot(vector: str | Column, query: list[float]) -> Column:
    """Inner product of an array column and a literal vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    products = F.zip_with(v, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The k rows of largest inner product (cosine, for vectors of length 1), ties to the smaller key. Filter before."""
    return ranked(vectors.withColumn("score", dot(vector, query)), F.desc("score"), F.asc(key), limit=k, mode="dense")


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """query_id, key, score, rank for a set of queries (query_id, vector), a row's own id left out.

    The set goes to the tasks in blocks of a fixed size. Each task multiplies its batches by a block and keeps k rows
    of each query, so what is shuffled is tasks x queries x k, not pairs.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    out = None
    ids = queries.select("query_id").orderBy("query_id")
    n = ids.count()
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        box = spark.sparkContext.broadcast(([r["query_id"] for r in part], np.array([r["vector"] for r in part], np.float64).reshape(len(part), -1)))

        def run(frames: Iterator[pd.DataFrame], box=box) -> Iterator[pd.DataFrame]:
            names, q = box.value
            best: list[list] = [[] for _ in names]
            for frame in frames:
                if not len(frame) or not len(names):
                    continue
                own = frame[key].to_numpy()
                scores = np.stack(frame[vector].to_numpy()).astype(np.float64) @ q.T
                for i, name in enumerate(names):
                    s = scores[:, i]
                    some = np.argpartition(-s, min(k, len(s) - 1))[: k + 1]
                    some = np.flatnonzero(s >= s[some].min())  # ties at the edge
                    rows = [(-s[j], own[j]) for j in some.tolist() if own[j] != name]
                    best[i] = sorted([*best[i], *rows])[:k]
            yield pd.DataFrame([(n, i, -s) for n, b in zip(names, best, strict=True) for s, i in b], columns=["query_id", key, "score"])

        found = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {kind}, score double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def matching(rows: DataFrame, conditions: dict | None) -> DataFrame:
    """A value is an equality, a list is a choice, None and '' are ignored."""
    for name, value in (conditions or {}).items():
        if value is None or value == "":
            continue
        if isinstance(value, (list, tuple)):
            rows = rows.where(F.col(name).isin(*[canonical_space(v) if name == "space" else v for v in value]))
        else:
            rows = rows.where(F.col(name) == (canonical_space(value) if name == "space" else value))
    return rows


def lexical(chunks: DataFrame, question: str, k: int, conditions: dict | None = None) -> DataFrame:
    """chunk_id, score, rank of chunks that have any word of the question, by BM25 over embed_text, stop words aside."""
    from ..functions.text import tokens

    terms = " ".join(dict.fromkeys(w for w in tokens(question, False) if w not in STOP_WORDS))
    pages = matching(chunks, conditions).select(F.col("chunk_id").alias("id"), F.lit("").alias("title"), F.col("embed_text").alias("body_text"))
    return keyword_search(pages, terms, k, any_term=True).select(F.col("id").alias("chunk_id"), (-F.col("score")).alias("lexical_score"), "rank", F.lit("lexical").alias("mode"))


def retrieve(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, question: str, embedder, matcher: Matcher, k: int = TOP_K, mode: str = "hybrid", conditions: dict | None = None, candidates: int = CANDIDATES, ann=None) -> DataFrame:
    """The k best chunks of a question, with the fields of their documents.

    The question is masked as the corpus is. ann(vector, k, conditions) may serve neighbours from an index; if it
    fails, they are searched exactly. Filters come before the cut in both legs.
    """
    from .embed import query_vector

    masked = matcher.mask(question.strip())
    if matcher.leaks(masked):
        raise Leak("protected entity leaked at retrieval query")
    n = max(candidates, k)
    vector = query_vector(embedder, masked)
    allowed = matching(chunks, conditions)
    dense = None
    if ann is not None and mode != "exact":
        try:
            dense = ann(vector, n, conditions)
        except Exception as e:  # the index is a copy; the vectors themselves are here
            import warnings

            warnings.warn(f"index failed, searching exactly: {e}", stacklevel=2)
    if dense is None:
        own = vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi") if conditions else vectors
        dense = nearest(own, vector, n)
    dense = dense.select("chunk_id", "rank", F.lit("dense").alias("mode"), F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    if mode == "hybrid":
        words = lexical(chunks, masked, n, conditions).withColumn("lexical_rank", F.col("rank"))
        top = ranked(fuse([dense, words], "chunk_id"), F.desc("rrf"), F.asc("_place"), limit=k, mode=mode).withColumnRenamed("rrf", "score")
    else:
        top = dense.where(F.col("rank") <= k).withColumn("score", F.col("dense_score")).withColumn("lexical_rank", F.lit(None).cast("int")).drop("mode").withColumn("mode", F.lit(mode))
    docs = documents.select("doc_id", F.col("title").alias("doc_title"), "filename", "file_type")
    return top.select("chunk_id", "rank", "score", "dense_score", "dense_rank", "lexical_rank").join(chunks.drop("file_type"), "chunk_id").join(docs, "doc_id", "left").orderBy("rank")
