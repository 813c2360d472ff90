"""Exact top-k search by MaxScore over sharded postings of vector components.

A component is a term: its postings list the rows where it is positive, and those where it is negative, with the
amounts. A query term reads the list of its own sign, which holds all that it can add; the other sign only takes
away. Each list has a bound, weight times its largest amount. Sorted by bound, the terms whose bounds add up to less
than the score of the k-th result so far are non-essential: a row that is in none of the other lists cannot enter.
Essential postings are traversed, rows that the non-essential bounds cannot lift to the threshold are dropped, the
others are probed term by term for as long as they compete, and what is left is scored in full.

Queries and rows meet in cells, a block of queries against a slice of rows; a task holds one block and streams the
slice through it, a batch at a time, each batch a shard with postings of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ship

#: Queries in a block, rows in a slice, and slices at most; slices of more rows are only streamed for longer.
BLOCK, SLICE, SLICES = 4096, 4096, 2048
#: Rows that are scored in full to get a first threshold; terms that are probed at a time.
WARM, PROBE = 64, 8


class Shard:
    """Postings by sign of the columns of an integer matrix."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.lists: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.bounds = np.zeros((2, x.shape[1]), np.int64)
        for side, signed in enumerate((x, -x)):
            column, row = np.nonzero(signed.T > 0)
            amount = signed[row, column]
            cuts = np.searchsorted(column, np.arange(1, x.shape[1]))
            self.lists.append(list(zip(np.split(row, cuts), np.split(amount, cuts), strict=True)))
            if len(x):
                self.bounds[side] = np.maximum(signed.max(axis=0), 0)

    def search(self, query: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id), those so far in `best` included; rows of the query's own id take no part."""
        own = self.ids != query
        first = np.flatnonzero(own[:WARM]) if len(best) < k else np.zeros(0, np.int64)
        best = self._take(first, q, k, best)
        own[first] = False
        threshold = -best[-1][0] if len(best) == k else 0
        if threshold <= 0:
            return self._take(np.flatnonzero(own), q, k, best)
        dims = np.flatnonzero(q)
        side = (q[dims] < 0).astype(np.int64)
        weight = np.abs(q[dims])
        bound = weight * self.bounds[side, dims]
        order = np.argsort(bound, kind="stable")
        upto = np.cumsum(bound[order])
        cut = int(np.searchsorted(upto, threshold, side="left"))  # bounds of the first `cut` terms add up to less
        total = np.zeros(len(self.ids), np.int64)
        for t in order[cut:].tolist():
            row, amount = self.lists[side[t]][dims[t]]
            total[row] += weight[t] * amount
        rest = int(upto[cut - 1]) if cut else 0
        live = np.flatnonzero((total > 0) & (total + rest >= threshold) & own)
        total = total[live]
        for end in range(cut, 0, -PROBE):
            if not len(live):
                break
            some = order[max(0, end - PROBE) : end]
            total = total + (np.maximum(self.x[live[:, None], dims[some]] * np.sign(q[dims[some]]), 0) * weight[some]).sum(axis=1)
            rest = int(upto[end - PROBE - 1]) if end > PROBE else 0
            keep = total + rest >= threshold
            live, total = live[keep], total[keep]
        return self._take(live, q, k, best)

    def _take(self, rows: np.ndarray, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if not len(rows):
            return best
        score, ids = self.x[rows] @ q, self.ids[rows]
        top = np.lexsort((ids, -score))[:k]
        return sorted([*best, *zip((-score[top]).tolist(), ids[top].tolist(), strict=True)])[:k]


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of different lengths end in zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = col.flatten().to_numpy()
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _cells(k: int):
    def found(ids: list[int], best: list[list]) -> pa.RecordBatch:
        rows = [(q, -s, i) for q, b in zip(ids, best, strict=True) for s, i in b]
        return pa.record_batch({n: pa.array([r[j] for r in rows], pa.int64()) for j, n in enumerate(("query_id", "score", "vec_id"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, queries, best = None, [], np.zeros((0, 0), np.int64), []
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    if ids:
                        yield found(ids, best)
                    cell, ids, queries, best = cells[a], [], np.zeros((0, 0), np.int64), []
                x = _matrix(part.column("x"))
                width = max(x.shape[1], queries.shape[1])
                x, queries = _wide(x, width), _wide(queries, width)
                if kinds[a] == 0:
                    ids += part.column("vec_id").to_pylist()
                    queries = np.concatenate((queries, x))
                    best += [[] for _ in range(len(part))]
                elif ids:
                    shard = Shard(part.column("vec_id").to_numpy(), x)
                    best = [shard.search(i, q, k, b) for i, q, b in zip(ids, queries, best, strict=True)]
        if ids:
            yield found(ids, best)

    return run


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x: floor(scale * component) as longs. Null vectors, and those with a null or non-finite component, go."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    ints = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", ints.alias("x"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows (vec_id long, x array<long>) of largest inner product with each query.

    Ties go to the smaller vec_id; rows of the query's own vec_id take no part; fewer than k rows give all of them.
    Missing components count as 0. Repeated rows are ranked each; queries of one vec_id are one query, the least of
    them. Other columns are not returned; empty tables give an empty table. Products must stay within 63 bits.
    """
    ship(rows.sparkSession)
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks, slices = (max(1, -(-queries.count() // block)), min(SLICES, max(1, -(-rows.count() // size))))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = queries.select(spread(blocks).alias("b"), every(slices).alias("s"), F.lit(0).alias("kind"), "vec_id", "x")
    found = rows.select(every(blocks).alias("b"), spread(slices).alias("s"), F.lit(1).alias("kind"), "vec_id", "x")
    cells = asks.unionByName(found).select((F.col("b") * slices + F.col("s")).cast("long").alias("cell"), "kind", "vec_id", "x")
    dealt = cells.repartition(min(blocks * slices, 20_000), "cell").sortWithinPartitions("cell", "kind", "vec_id")
    best = dealt.mapInArrow(_cells(k), "query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_maxscore_topk(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), q AS (
  SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.x), len(v.x)) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
