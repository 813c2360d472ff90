"""Cross-entropy difference: how much better a target model than a background model predicts each document.

Both models are word bigrams over one vocabulary, hashed word numbers, with the same hashed bigram cells and the same
smoothing. Every token of the corpus is counted, in the model its document belongs to. The numbers of cells grow with
the corpus, with the square root of its bytes; counts leave a task as sparse blocks of cells and are added up by block,
so no task counts the whole model. Background counts are scaled to the target's size, which makes the models match.
A document's own counts are taken out of its model before it is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, ship, text_bytes, written
from .decontaminate import words_of

#: log2 of the vocabulary and of the bigram cells of a corpus of up to 2**LEAST bytes; the models take 2 * 4 * (2**WORDS + 2**PAIRS) bytes.
WORDS, PAIRS, LEAST = 16, 20, 27
#: log2 of the cells of a block; bytes of text whose tokens are counted at a time; weight of the unigram in a bigram's estimate.
BLOCK, CHUNK, PRIOR = 16, 8 << 20, 8.0


def bits_for(size: int) -> tuple[int, int]:
    """log2 of the vocabulary and of the bigram cells of a corpus of so many bytes: twice the cells for four times the text."""
    more = max(0, math.ceil((math.log2(max(size, 1)) - LEAST) / 2))
    return WORDS + more, PAIRS + more


def cells(data: np.ndarray, off: np.ndarray, words: int, pairs: int) -> tuple[np.ndarray, ...]:
    """(text number, word number, bigram cell or -1 at a text's first word, word number before) of each token."""
    _, _, _, doc, h = words_of(data, off)
    word = (h >> np.uint64(64 - words)).astype(np.int64)
    before = np.concatenate((h[:1], h[:-1]))
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + h
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    pair = (mixed >> np.uint64(64 - pairs)).astype(np.int64)
    if len(doc):
        pair[np.concatenate(([True], doc[1:] != doc[:-1]))] = -1
    return doc, word, pair, np.concatenate((word[:1], word[:-1]))


def _counts(words: int, pairs: int):
    """Sparse counts of each piece of text: the cells of a block, words before pairs and side after side, and their counts."""
    size = (1 << words) + (1 << pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for batch in pieces_of(batches, "text", 1 << 20):
            data, off = text_bytes(batch.column("text"))
            doc, word, pair, _ = cells(data, off, words, pairs)
            side = np.asarray(batch.column("target").to_numpy(zero_copy_only=False), np.int64)[doc] * size
            held += [side + word, (side + pair + (1 << words))[pair >= 0]]
            total += len(data)
            if total >= CHUNK:
                yield _sparse(held)
                held, total = [], 0
        if held:
            yield _sparse(held)

    return run


def _sparse(held: list[np.ndarray]) -> pa.RecordBatch:
    cell, count = np.unique(np.concatenate(held), return_counts=True)
    block = cell >> BLOCK
    edges = np.concatenate((np.flatnonzero(np.diff(block, prepend=-1)), [len(cell)]))
    low, count = (cell & ((1 << BLOCK) - 1)).astype("<u2"), count.astype("<u4")
    part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
    return pa.record_batch({"block": pa.array(block[edges[:-1]], pa.int64()), "cells": part(low), "counts": part(count)})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks added up; a partition holds its share of the model's blocks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, low, count in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts")), strict=True):
            table = sums.setdefault(block, np.zeros(1 << BLOCK, np.int64))
            table[np.frombuffer(low, "<u2")] += np.frombuffer(count, "<u4")  # each cell once
    for block, table in sums.items():
        yield pa.record_batch({"block": pa.array([block], pa.int64()), "table": pa.array([table.astype("<f4").tobytes()], pa.binary())})


@dataclass
class Models:
    """Counts of the target (row 1) and, scaled to it, of the background (row 0)."""

    words: np.ndarray
    pairs: np.ndarray
    scale: np.ndarray
    bits: tuple[int, int]

    def losses(self, data: np.ndarray, off: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, mean loss in bits under background and target) of each text; 0 for a text without words."""
        n = len(off) - 1
        doc, word, pair, before = cells(data, off, *self.bits)
        tokens = np.bincount(doc, minlength=n)
        own_word, own_pair = _own(doc, word, self.bits[0]), _own(doc, np.where(pair < 0, 0, pair + 1), self.bits[1] + 1)
        own_before = np.concatenate((own_word[:1], own_word[:-1]))
        out = np.zeros((2, n))
        for side in (0, 1):
            mine = (target[doc] == side) * self.scale[side]
            total = self.words[side].sum(dtype=np.float64) - mine * tokens[doc]
            one = (self.words[side][word] - mine * own_word + 1) / (total + self.words.shape[1])
            given = np.maximum(self.words[side][before] - mine * own_before, 0)
            both = np.maximum(self.pairs[side][np.maximum(pair, 0)] - mine * own_pair, 0)
            p = np.where(pair < 0, one, (np.minimum(both, given) + PRIOR * one) / (given + PRIOR))
            out[side] = np.bincount(doc, weights=-np.log2(p), minlength=n) / np.maximum(tokens, 1)
        return tokens, out


def _own(doc: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """How often each token's key is in its own text."""
    if not len(doc):
        return np.zeros(0, np.int64)
    _, inverse, count = np.unique(doc << bits | key, return_inverse=True, return_counts=True)
    return count[inverse]


def train_models(docs: DataFrame, words: int | None = None, pairs: int | None = None) -> Models:
    """Models of docs (text, target boolean) that count all their tokens; words, pairs: log2 of the cells, by the corpus if not given."""
    ship(docs.sparkSession)
    if words is None or pairs is None:
        found = bits_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        words, pairs = words or found[0], pairs or found[1]
    size = (1 << words) + (1 << pairs)
    rows = docs.select("text", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_counts(words, pairs), "block long, cells binary, counts binary")
    got = rows.repartition("block").mapInArrow(_added, "block long, table binary").collect()
    table = np.zeros(-(-2 * size >> BLOCK) << BLOCK, np.float32)
    for r in got:
        table[r.block << BLOCK : (r.block + 1) << BLOCK] = np.frombuffer(r.table, "<f4")
    table = table[: 2 * size].reshape(2, size)
    tokens = table[:, : 1 << words].sum(axis=1, dtype=np.float64)
    scale = np.array([tokens[1] / tokens[0] if tokens.all() else 1.0, 1.0])
    table *= scale[:, None].astype(np.float32)
    return Models(table[:, : 1 << words], table[:, 1 << words :], scale, (words, pairs))


def _score(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1 << 20):
            target = np.asarray(batch.column("target").to_numpy(zero_copy_only=False), np.int64)
            tokens, (background, mine) = box.value.losses(*text_bytes(batch.column("text")), target)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(tokens, pa.int64()), "target_loss": pa.array(mine), "background_loss": pa.array(background), "score": pa.array(mine - background)})

    return run


def cross_entropy_difference(docs: DataFrame, words: int | None = None, pairs: int | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (bits a token) and score, their difference: lower is more like the target.

    docs: doc_id, text, target boolean (null: background). Null, empty and wordless texts have no tokens and score 0.
    Each row is scored, repeated rows too (a copy counts like any other document); texts are read whole, other
    columns are not returned, and an empty table gives an empty table. With an empty target or background that model
    is the uniform one.
    """
    models = train_models(docs, words, pairs)
    rows = docs.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(models)), f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def op3_cross_entropy(spark, sf_dir: str) -> DataFrame:
    """Target: documents that are labelled good and not toxic; background: all others.

    Labels are as many as documents may be, so they are joined by a shuffle at any size, once, into a table.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("target", F.lit(True))
    return cross_entropy_difference(written(docs.join(good.hint("merge"), "doc_id", "left"), "targets"))
