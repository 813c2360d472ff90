"""Embedding of texts: a protocol, retries, and a deterministic embedder that needs no service."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import model_key

BATCH, ATTEMPTS, BACKOFF = 16, 4, 0.5


class Embedder(Protocol):
    model: str
    dim: int
    query_prefix: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Fatal(RuntimeError):
    """An error that another attempt will not mend."""


class HashedWords:
    """Counts of words in buckets by their 32-bit FNV-1a hash, scaled to length 1."""

    query_prefix = ""

    def __init__(self, dim: int = 64, model: str = "hashed-words"):
        self.dim, self.model = dim, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"[a-z0-9_]+", text.lower()):
                h = 0x811C9DC5
                for b in w.encode():
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                v[h % self.dim] += 1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


_factories: dict[str, Callable[[], Embedder]] = {"hashed-words": HashedWords}
_made: dict[str, Embedder] = {}


def register(name: str, factory: Callable[[], Embedder]) -> None:
    """Make an embedder known by name; tasks build their own from the factory."""
    _factories[name] = factory
    _made.pop(name, None)


def get(name: str = "hashed-words") -> Embedder:
    if name not in _made:
        _made[name] = _factories[name]()  # an embedder that fails to start is not kept
    return _made[name]


def embed_all(embedder: Embedder, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in batches; a batch is tried again with growing pauses, and sizes are checked."""
    out: list[list[float]] = []
    for i in range(0, len(texts), BATCH):
        for attempt in range(ATTEMPTS):
            try:
                got = embedder.embed(texts[i : i + BATCH])
                break
            except Fatal:
                raise
            except Exception:
                if attempt == ATTEMPTS - 1:
                    raise
                sleep(BACKOFF * 2**attempt)
        if any(len(v) != embedder.dim for v in got):
            raise Fatal(f"{embedder.model} gave vectors of another size than {embedder.dim}")
        out += got
    return out


def embed_column(df: DataFrame, factory: Callable[[], Embedder], text: str = "embed_text", out: str = "vector") -> DataFrame:
    """df with a vector array<float>, and model_key and dim; one embedder for each task, Arrow batches in and out."""
    made = factory()
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = factory()
        for frame in frames:
            frame[out] = embed_all(embedder, frame[text].fillna("").tolist())
            yield frame

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, {out} array<float>").select(*names, F.lit(model_key(made.model)).alias("model_key"), F.lit(made.dim).alias("dim"), out)


def query_vector(embedder: Embedder, question: str) -> list[float]:
    return embed_all(embedder, [embedder.query_prefix + question])[0]
