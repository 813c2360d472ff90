"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and components of the links.

Fingerprints within `radius` bits agree on at least one of radius + 1 or more blocks of bits. With b blocks, any
choice of b - radius blocks is a table; its bits are a shard key, and two linked fingerprints share a shard in some
table. Each shard is one BK-tree: children hang from their parent by their Hamming distance, and a search follows
only edges within the radius. The number of blocks grows with the number of fingerprints, so that shards stay small;
a shard that is large all the same is cut into chunks, and every pair of chunks is a tree and a set of queries, so no
task gathers more than two chunks. A tree's links are joined into stars before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, ship, text_bytes, written
from .components import components

#: Different fingerprints in a chunk of a shard.
CHUNK = 4096
#: Fingerprints whose trees are searched together, and searches at a time against one tree.
FOREST, SEARCHES = 100_000, 1024
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LANES = np.uint64(0x0101010101010101)


def word_grams(data: np.ndarray, off: np.ndarray, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the word n-grams, repeats included, text after text, their number in each text) of texts in UTF-8.

    A text of fewer than n words is one gram.
    """
    low = data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)
    word = ~_SPACE[low] if len(low) else np.zeros(0, bool)
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts_of_text = off[:-1][off[1:] > off[:-1]]
    first[starts_of_text] = word[starts_of_text]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    # words and one space after each
    width = end - begin
    place = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(width + 1, out=place[1:])
    joined = np.full(place[-1], 0x20, np.uint8)
    ids = np.flatnonzero(word)
    joined[np.repeat(place[:-1] - begin, width) + ids] = low[ids]
    raw = joined.tobytes()
    doc = np.searchsorted(off, begin, side="right") - 1
    words = np.bincount(doc, minlength=len(off) - 1)
    head = np.cumsum(words) - words
    grams = np.where(words > 0, np.maximum(1, words - n + 1), 0)
    gram_head = np.cumsum(grams) - grams
    i = np.repeat(head - gram_head, grams) + np.arange(grams.sum())
    j = i + np.minimum(n, np.repeat(words, grams)) - 1
    h = np.fromiter(map(_hasher(raw, seed), place[i].tolist(), (place[j] + width[j]).tolist()), np.uint64, len(i))
    return h, grams


def fingerprints(data: np.ndarray, off: np.ndarray, n: int = 3, seed: int = 42) -> np.ndarray:
    """Of texts in UTF-8: bit i is set if over half of the hashes of the word n-grams have it, repeats counted."""
    return majority(*word_grams(data, off, n, seed))


def majority(h: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The bits that over half of each text's hashes have; 0 for a text without hashes."""
    out = np.zeros(len(grams), np.uint64)
    if not len(h):
        return out
    gram_head = np.cumsum(grams) - grams
    # sums of up to 255 bits fit a byte, eight counters to a word
    has = np.flatnonzero(grams)
    cuts = np.concatenate([np.arange(a, a + g, 255) for a, g in zip(gram_head[has].tolist(), grams[has].tolist(), strict=True)])
    owner = np.searchsorted(cuts, gram_head[has])
    over = np.zeros((len(has), 64), bool)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        over[:, bit::8] = counts * 2 > grams[has][:, None]
    out[has] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _hasher(raw: bytes, seed: int):
    digest = xxhash.xxh64_intdigest
    return lambda a, b: digest(raw[a:b], seed)


def _fingerprint_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1 << 20):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fingerprints(*text_bytes(batch.column("text")), n).view(np.int64))})

    return run


def simhash(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long). Null and blank texts get 0."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches(n), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def tables(count: int, radius: int, bits: int = 64, full: int = 256) -> list[int]:
    """Masks of the tables: the fewest blocks with which even shards would hold `full` fingerprints or fewer."""
    for blocks in range(radius + 1, 2 * radius + 6):
        if count >> (bits * (blocks - radius) // blocks) <= full or blocks == 2 * radius + 5:
            break
    edges = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


class Forest:
    """BK-trees over different fingerprints, one for each shard, in flat arrays; built and searched level by level."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        """shard: number of each value's shard, from 0, in order."""
        n = len(values)
        self.values = values
        self.root = np.searchsorted(shard, np.arange(shard[-1] + 1)) if n else np.zeros(0, np.int64)
        self.child = np.full(n * 65, -1, np.int32)
        at = self.root[shard]
        live = np.flatnonzero(at != np.arange(n))
        while len(live):
            slot = at[live] * 65 + np.bitwise_count(values[live] ^ values[at[live]])
            empty = self.child[slot] < 0
            self.child[slot[empty][::-1]] = live[empty][::-1]  # the first of a slot stays
            below = self.child[slot]
            at[live] = below
            live = live[below != live]

    def search(self, values: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all pairs within the radius."""
        query, node = np.arange(len(values)), self.root[shard]
        found = []
        while len(query):
            d = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found.append((query[hit], node[hit]))
            more = []
            for k in range(-radius, radius + 1):
                key = d + k
                ok = (key >= 0) & (key <= 64)
                below = self.child[node[ok] * 65 + key[ok]]
                more.append((query[ok][below >= 0], below[below >= 0].astype(np.int64)))
            query, node = (np.concatenate(x) for x in zip(*more, strict=True))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def stars(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index that each of n can reach over the links."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
        differ = label[u] != label[v]
        u, v = u[differ], v[differ]
    return label


def _links(radius: int):
    """Rows sorted by cell, trees before queries; a cell is a shard, or a pair of chunks of one."""

    def solve(cell: np.ndarray, fp: np.ndarray, query: np.ndarray) -> pa.RecordBatch:
        values = fp.view(np.uint64)
        tree = np.flatnonzero(~query)
        number = np.cumsum(np.concatenate(([0], cell[tree][1:] != cell[tree][:-1]))) if len(tree) else np.zeros(0, np.int64)
        forest = Forest(values[tree], number)
        names = cell[tree][forest.root]
        twin = ~np.isin(names, cell[query])  # a shard or chunk against itself
        ask = np.concatenate((np.flatnonzero(query), tree[twin[number]]))
        ask = ask[np.isin(cell[ask], names)]
        order = np.argsort(names)
        of = order[np.searchsorted(names[order], cell[ask])]
        label = np.arange(len(values))
        sizes = np.bincount(number)[of]
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // (SEARCHES * CHUNK))) + 1
        for part in np.split(np.arange(len(ask)), edges):
            q, t = forest.search(values[ask[part]], of[part], radius)
            u, v = ask[part][q], tree[t]
            label = stars(len(values), np.concatenate((label[u], np.arange(len(values)))), np.concatenate((label[v], label)))
        far = np.flatnonzero(label != np.arange(len(values)))
        u, v = fp[far], fp[label[far]]
        return pa.record_batch({"u": pa.array(u[u != v]), "v": pa.array(v[u != v])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            cell, fp = (batch.column(c).to_numpy() for c in ("cell", "fp"))
            query = batch.column("query").to_numpy(zero_copy_only=False)
            held.append((cell, fp, query))
            size += len(cell)
            if size >= FOREST:
                cell, fp, query = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(cell, cell[-1])) if (np.diff(cell) >= 0).all() else 0
                if cut:  # the last cell may go on
                    yield solve(cell[:cut], fp[:cut], query[:cut])
                    held, size = [(cell[cut:], fp[cut:], query[cut:])], len(cell) - cut
        if size:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def near_links(values: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that join all different fingerprints (column fp) within the radius; stars stand for their pairs."""
    masks = tables(values.count(), radius)
    shard = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)]
    rows = values.select("fp", F.explode(F.array(*shard)).alias("s")).select("fp", F.xxhash64("s.t", "s.key").alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shard", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    cells = rows.join(sizes, "shard").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("fp", F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), (F.col("mine") > F.col("other")).alias("query"))
    return cells.repartition("cell").sortWithinPartitions("cell", "query", "fp").mapInArrow(_links(radius), "u long, v long")


def simhash_groups(docs: DataFrame, radius: int = 3, n: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of up to `radius` differing bits lead to, itself included.

    One row for each row of docs, other columns are not returned. Null and blank texts have fingerprint 0 and link
    like any other; a null doc_id stays null and names a component only if it has no other id. Repeated rows share a
    component. An empty table gives an empty table.
    """
    prints = written(simhash(docs, n), "fingerprints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(near_links(values.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = values.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(lows, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

