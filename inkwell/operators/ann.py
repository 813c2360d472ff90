"""An optional approximate index: random projections in buckets, over vectors of length 1, where distance orders as cosine does."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import dot, matching
from .search import ranked


class LshIndex:
    """Serves retrieve(ann=index.search). The projections are drawn from a seed and the dimension alone, so every row is hashed alike."""

    def __init__(self, points: DataFrame, bucket: float = 1.0, tables: int = 6, seed: int = 7, key: str = "chunk_id"):
        """points: key, vector array<float>, and the columns that searches may filter by."""
        self.points, self.key = points.withColumn("_v", array_to_vector("vector")), key
        self.model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(self.points)

    def search(self, vector: list[float], k: int, conditions: dict | None = None) -> DataFrame:
        """key, score, rank of up to k neighbours, filtered before the cut."""
        rows = matching(self.points, conditions)
        near = self.model.approxNearestNeighbors(rows, Vectors.dense(vector), k)
        return ranked(near.withColumn("score", dot("vector", vector)), F.desc("score"), F.asc(self.key), limit=k, mode="dense").select(self.key, "score", "rank")


def recall(index: LshIndex, vectors: DataFrame, queries: list[list[float]], k: int = 10) -> float:
    """The share of true neighbours that the index finds, over some queries."""
    from .retrieve import nearest

    hit = total = 0
    for q in queries:
        want = {r[0] for r in nearest(vectors, q, k, index.key).select(index.key).collect()}
        hit += len(want & {r[0] for r in index.search(q, k).select(index.key).collect()})
        total += len(want)
    return hit / max(total, 1)
