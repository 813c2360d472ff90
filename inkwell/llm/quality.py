"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled documents and flattened into arrays; documents are
scored where they are read, a batch at a time, by walking all of its rows down each tree together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import beside, pieces_of, rejoined, ship, text_bytes
from .suffix_dedup import _power_tables

#: Labelled documents that a model is fitted on at most; those of least hash are taken.
SAMPLE = 20_000
FOLDS, THRESHOLD = 5, 0.3
_SPACE = (0x20, *range(0x09, 0x0E))
_SIGNS = b".,!?;:|#$%&*<>{}=\"'()-_/@+"
FEATURES = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "space", "wide", "control", *(f"sign_{chr(c)}" for c in _SIGNS),
    "word_mean", "word_std", "word_long", "word_short", "word_upper_start", "word_upper_end", "word_sign_end", "distinct_words", "top_word",
    "distinct_pairs", "line_mean", "distinct_lines", "sentence_mean",
)


def _classes() -> np.ndarray:
    kind = np.full(256, 5, np.uint8)
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A] = 0, 1, 2
    kind[list(_SPACE)] = 3
    kind[0x80:] = 4
    for i, c in enumerate(_SIGNS):
        kind[c] = 6 + i
    return kind


_KIND = _classes()


def _spans(inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, stop = inside.copy(), inside.copy()
    if len(inside):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        stop[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different values, most frequent one's count) of each text."""
    key = np.sort((h >> np.uint64(20)) ^ (doc.astype(np.uint64) << np.uint64(44)))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    owner = (key[head] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, np.diff(np.append(head, len(key))))
    return np.bincount(owner, minlength=n), top


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text in UTF-8; shares of an empty text are 0."""
    n, size = len(off) - 1, np.diff(off)
    text = np.repeat(np.arange(n), size)
    kinds = 6 + len(_SIGNS)
    kind = _KIND[data]
    counts = np.bincount(text * kinds + kind, minlength=n * kinds).reshape(n, kinds).astype(np.float64)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    up, down = _power_tables(len(data) + 2)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])

    def hashed(begin, end):
        h = (sums[end] - sums[begin]) * down[begin]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    begin, end = _spans(kind != 3, edge)
    doc = text[begin] if len(begin) else np.zeros(0, np.int64)
    words = np.bincount(doc, minlength=n)
    width = (end - begin).astype(np.float64)
    per = lambda x: np.bincount(doc, weights=x, minlength=n) / np.maximum(words, 1)
    mean = per(width)
    h = hashed(begin, end)
    distinct, top = _distinct(doc, h, n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, _ = _distinct(doc[pair], h[pair] * np.uint64(0x9E3779B97F4A7C15) ^ h[pair + 1], n)
    lb, le = _spans(data != 0x0A, edge)
    line = text[lb] if len(lb) else np.zeros(0, np.int64)
    lines = np.bincount(line, minlength=n)
    distinct_lines, _ = _distinct(line, hashed(lb, le), n)
    last = kind[end - 1] if len(end) else np.zeros(0, np.uint8)
    first = kind[begin] if len(begin) else np.zeros(0, np.uint8)
    before_last = kind[np.maximum(end - 2, 0)] if len(end) else last
    ends = np.bincount(doc, weights=np.isin(data[end - 1], list(b".!?")) if len(end) else None, minlength=n) if len(doc) else np.zeros(n)
    total = np.maximum(size, 1)
    share = counts / total[:, None]
    w = np.maximum(words, 1)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(lines), *share.T[[0, 1, 2, 3, 4, 5]], *share.T[6:],
        mean, np.sqrt(np.maximum(per(width**2) - mean**2, 0)), per(width > 12), per(width < 3), per(first == 1), per((last == 1) | (before_last == 1)), per(last >= 5), distinct / w, top / w,
        pairs / np.maximum(words - 1, 1), size / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1), words / np.maximum(ends, 1),
    ]
    return np.column_stack(columns).astype(np.float32)


@dataclass
class Trees:
    """Flattened trees: a leaf points to itself. raw score = base + sum of the leaves' values."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            raw += self.value[at]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1, level by level, by histograms of gradients over quantile bins."""
    mean = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def node(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    roots = []
    if len(y) and 0 < y.sum() < len(y):
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(f)]
        code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        cells = code + np.arange(f) * bins
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            root = node(g.sum() / (h.sum() + l2) * rate)
            roots.append(root)
            at = np.full(n, root)
            open_ = [root]
            for _ in range(depth):
                slot = {k: i for i, k in enumerate(open_)}
                live = np.flatnonzero(np.isin(at, open_))
                number = np.array([slot[k] for k in at[live].tolist()])
                where = (number[:, None] * f * bins + cells[live]).ravel()
                hist = [np.bincount(where, weights=None if w is None else np.repeat(w[live], f), minlength=len(open_) * f * bins).reshape(-1, f, bins).cumsum(axis=2) for w in (g, h, None)]
                sums, weights, counts = hist
                all_g, all_h, all_n = (z[:, :, -1:] for z in hist)
                gain = sums**2 / (weights + l2) + (all_g - sums) ** 2 / (all_h - weights + l2) - all_g**2 / (all_h + l2)
                gain[(counts < least) | (all_n - counts < least)] = -1
                fresh = []
                for i, k in enumerate(open_):
                    j, b = np.unravel_index(np.argmax(gain[i]), gain[i].shape)
                    if gain[i, j, b] <= 1e-6 or b >= len(cuts[j]):
                        continue
                    gl, hl = sums[i, j, b], weights[i, j, b]
                    sides = [node(a / (c + l2) * rate) for a, c in ((gl, hl), (all_g[i, j, 0] - gl, all_h[i, j, 0] - hl))]
                    nodes["feature"][k], nodes["threshold"][k], nodes["left"][k], nodes["right"][k] = int(j), float(cuts[j][b]), *sides
                    mine = live[number == i]
                    at[mine] = np.where(code[mine, j] <= b, *sides)
                    fresh += sides
                open_ = fresh
                if not open_:
                    break
            raw += np.array(nodes["value"])[at]
    return Trees(base, np.array(roots, np.int64), *(np.array(nodes[k], t) for k, t in (("feature", np.int64), ("threshold", np.float32), ("left", np.int64), ("right", np.int64), ("value", np.float64))), depth)


def _remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % FOLDS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "text", 1 << 20):
        x = statistics(*text_bytes(batch.column("text")))
        rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        yield pa.record_batch({"quality": batch.column("quality"), "x": rows})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on up to `sample` labelled rows outside the held-out fold; the bound makes their ids fit a broadcast."""
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_remainder() != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    table = found.select("quality", "text").mapInArrow(_features, "quality int, x array<float>").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, len(FEATURES)), np.float32)
    y = table.column("quality").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, np.int64)  # the order of arrival must not matter
    return fit(x[order], y[order])


def _score(box, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1 << 20):
            score = box.value.score(statistics(*text_bytes(batch.column("text"))))
            yield pa.record_batch({c: batch.column(c) for c in batch.schema.names if keep_text or c != "text"} | {"score": pa.array(score)})

    return run


def score_documents(docs: DataFrame, model: Trees, keep_text: bool = False) -> DataFrame:
    """row (a struct of the other columns of docs), text if asked for, score: how likely the text has label 1, 0 to 1.

    Only the text is an input. Null texts count as empty, which is scored like any other; texts of any length are
    read whole. Rows, repeated ones too, keep their number; an empty table gives an empty table. With no labels, or
    labels of one kind, the score is the smoothed share of label 1.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = beside(docs)
    box = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(box, keep_text), f"row {rows.schema['row'].dataType.simpleString()}, {'text string, ' if keep_text else ''}score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, model).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", (_remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to have label 0."""
    scored = score_documents(docs, train(docs, labels), True).where(F.col("score") >= THRESHOLD)
    return rejoined(scored, docs.columns, text=F.col("text"))
