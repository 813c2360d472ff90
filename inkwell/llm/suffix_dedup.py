"""Removal of byte strings that repeat across a corpus, by longest-previous-factor arrays over anchored shards.

A byte goes if a string of `window` bytes that covers it starts anywhere else too, in the same text or another one.
A global suffix array does not distribute, so suffixes are first sharded so that only suffixes that can agree on
`window` bytes meet:

1. Every window has one anchor, the k-gram of least hash inside it (leftmost of equals). It depends on the window's
   bytes alone, so equal windows have equal anchors at equal offsets. Windows that follow one another mostly share
   an anchor; such a run of windows is a *region*.
2. An anchor value found once in the corpus settles its region: nothing in it repeats. Regions of one value that
   are byte for byte the same repeat in full. Both are settled by counts.
3. The rest, values whose regions differ, are shards. Identical regions of a shard are folded into their first
   one, then the shard's suffixes are sorted offset by offset, each order induced from the one before. In suffix
   order, suffixes that agree on `window` bytes are runs; a suffix has an earlier match (its longest previous
   factor reaches `window`) if a smaller text position stands before or after it in its run, and a later match if
   a larger one does.
4. A shard of more than `most` different regions is not gathered: its windows are counted by hash instead, with
   partial sums before the shuffle, which is exact for any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, row_key, ship, text_bytes, written

#: Bytes of an anchor; a window of `window` bytes holds window - GRAM + 1 of them.
GRAM = 64
#: A run of windows is packed as first * 2**SHIFT + count.
SHIFT = 12
#: Positions are kept in the low bits of a packed minimum.
LOW = np.uint64((1 << 24) - 1)
CHUNK = 1 << 20
#: Rows of two longs that may be broadcast.
BROADCAST = 200_000
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram: differences of one prefix sum, scaled back and mixed."""
    n = len(data)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    h = sums[k:] - sums[: n - k + 1]
    h *= down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row, from prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def regions(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window start, number of windows, anchor position, anchor hash) of each region of the texts."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.view(np.uint64)
    h = gram_hashes(data, gram)
    least = sliding_min((h & ~LOW) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
    at = (least & LOW).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    has = off[1:] - off[:-1] >= window
    np.add.at(inside, off[:-1][has], 1)
    np.add.at(inside, off[1:][has] - window + 1, -1)
    inside = np.cumsum(inside)[: len(at)] > 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    new[off[:-1][has]] = True  # texts that adjoin
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(at)))
    start, count = start[inside[start]], count[inside[start]]
    return start, count, at[start], h[at[start]]


def _members(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", CHUNK):
            data, off = text_bytes(batch.column("text"))
            step = int(LOW) - window
            cuts = [(0, data, off)] if len(data) <= step else [(c, d := data[c : c + step + window - 1], np.array([0, len(d)])) for c in range(0, len(data), step)]
            for shift, part, offs in cuts:
                start, count, _, h1 = regions(part, offs, window, gram)
                if not len(start):
                    continue
                raw = part.tobytes()
                h2 = np.fromiter((xxhash.xxh3_64_intdigest(raw[p : p + n]) for p, n in zip(start.tolist(), (count + window - 1).tolist(), strict=True)), np.uint64, len(start))
                doc = np.searchsorted(offs, start, side="right") - 1
                yield pa.record_batch({
                    "row": batch.column("row").take(pa.array(doc)),
                    "doc_id": batch.column("doc_id").take(pa.array(doc)),
                    "pos": pa.array(((start - offs[doc] + shift) << SHIFT) | count),
                    "h1": pa.array(h1.view(np.int64)),
                    "h2": pa.array(h2.view(np.int64)),
                })

    return run


def factor_flags(parts: list[bytes], lead: np.ndarray, group: np.ndarray, windows: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each region, which of its window starts have a match at an earlier, and at a later, text position.

    parts: bytes of the regions, in text order inside a group; lead: bytes before the anchor; windows: window starts.
    """
    m, left, right = len(parts), int(lead.max()), int(max(len(p) for p in parts))
    table = np.zeros((m, left + right), np.uint8)
    for i, p in enumerate(parts):
        table[i, left - lead[i] : left - lead[i] + len(p)] = np.frombuffer(p, np.uint8)
    tails = [parts[i][lead[i] :] for i in range(m)]
    rank = np.empty(m, np.int64)
    rank[sorted(range(m), key=lambda i: (group[i], tails[i]))] = np.arange(m)
    flags = [(np.zeros(n, bool), np.zeros(n, bool)) for n in windows.tolist()]
    live, floor = np.arange(m), lead - windows + 1  # offsets lead .. floor before the anchor start a window
    for back in range(left + 1):
        if back:
            live = live[lead[live] >= back]
            order = np.lexsort((rank[live], table[live, left - back], group[live]))
            rank[live[order]] = np.arange(len(live))
        else:
            order = np.argsort(rank[live])
        ask = live[order]
        ask = ask[floor[ask] <= back]
        if len(ask) < 2:
            continue
        cols = table[:, left - back : left - back + window]
        differ = (group[ask[1:]] != group[ask[:-1]]) | (cols[ask[1:]] != cols[ask[:-1]]).any(axis=1)
        heads = np.flatnonzero(np.concatenate(([True], differ)))
        if len(heads) == len(ask):
            continue
        run = np.cumsum(np.concatenate(([False], differ)))
        first, last = np.minimum.reduceat(ask, heads)[run], np.maximum.reduceat(ask, heads)[run]
        for i in np.flatnonzero(first != last).tolist():
            x = int(ask[i])
            flags[x][0][lead[x] - back] = x > first[i]
            flags[x][1][lead[x] - back] = x < last[i]
    return flags


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True)


def _spans_of(rows: dict, at: int, first: int, mask: np.ndarray, later: bool) -> None:
    for start, n in _runs(mask):
        rows["row"].append(at)
        rows["pos"].append(((first + start) << SHIFT) | n)
        rows["later"].append(later)


def _solve(window: int, budget: int):
    """Streams over rows sorted by shard; whole shards are gathered until their bytes reach the budget."""
    cols = ("h1", "row", "pos", "lead", "bytes")

    def flush(held: list[tuple]) -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        group = np.cumsum([0, *(a[0] != b[0] for a, b in zip(held[1:], held, strict=False))])
        count = np.array([x[2] & ((1 << SHIFT) - 1) for x in held])
        rows: dict = {"row": [], "pos": [], "later": []}
        for x, (earlier, later) in zip(held, factor_flags([x[4] for x in held], np.array([x[3] for x in held]), group, count, window), strict=True):
            _spans_of(rows, x[1], x[2] >> SHIFT, earlier, False)
            _spans_of(rows, x[1], x[2] >> SHIFT, later, True)
        return pa.record_batch({"row": pa.array(rows["row"], pa.int64()), "pos": pa.array(rows["pos"], pa.int64()), "later": pa.array(rows["later"], pa.bool_())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if held and held[-1][:3] == x[:3]:  # a repeated row
                    continue
                if size >= budget and held[-1][0] != x[0]:
                    if (out := flush(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if (out := flush(held)) is not None:
            yield out

    return run


def _cut(window: int, gram: int):
    """Bytes of the regions that a row is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {k: [] for k in ("h1", "row", "doc_id", "pos", "lead", "bytes")}
            for row, doc_id, text, asked in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text", "asked")), strict=True):
                for a in asked:
                    first, n = a["pos"] >> SHIFT, a["pos"] & ((1 << SHIFT) - 1)
                    part = text[first : first + n + window - 1]
                    _, _, at, h = regions(np.frombuffer(part, np.uint8), np.array([0, len(part)]), window, gram)
                    for k, v in zip(out, (a["h1"], row, doc_id, a["pos"], int(at[0]), part), strict=True):
                        out[k].append(v)
            yield pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.binary()), strict=True)})

    return run


def _windows(window: int):
    """Every window of a region as a hash, for shards too large to gather."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, row, doc_id, pos, part in zip(*(batch.column(c).to_pylist() for c in ("h1", "row", "doc_id", "pos", "bytes")), strict=True):
                first, n = pos >> SHIFT, pos & ((1 << SHIFT) - 1)
                yield pa.record_batch({
                    "h1": pa.array([h1] * n, pa.int64()), "row": pa.array([row] * n, pa.int64()), "doc_id": pa.array([doc_id] * n, batch.schema.field("doc_id").type), "first": pa.array(range(first, first + n), pa.int64()),
                    "w": pa.array([xxhash.xxh3_128_digest(part[i : i + window]) for i in range(n)], pa.binary()),
                })

    return run


def repeated_spans(docs: DataFrame, window: int = 400, keep_first: bool = False, most: int = 20_000, gram: int = GRAM) -> DataFrame:
    """Runs of repeated window starts: row, pos (first * 2**SHIFT + count); row is row_key(doc_id, text).

    keep_first: only windows with an earlier match, in the order of (doc_id, row, position). Else windows with any other.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(row_key("doc_id", "text").alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    members = written(base.mapInArrow(_members(window, gram), f"row long, doc_id {kind}, pos long, h1 long, h2 long"), "anchors")
    values = members.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.min("h2").alias("low"), F.max("h2").alias("high")).where("n > 1")
    # written, so that the join has an exchange on either side and can split a value that many regions share
    values = written(values.select("h1", (F.col("low") != F.col("high")).alias("mixed")), "values")
    common = written(members.join(values, "h1"), "repeats")
    if keep_first:
        firsts = common.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "pos")).alias("f")).select("h1", "h2", "f.row", "f.pos")
        full = common.join(firsts.withColumn("is_first", F.lit(True)), ["h1", "h2", "row", "pos"], "left").where("is_first is null").select("row", "pos")
    else:
        full = common.where("not mixed").select("row", "pos")
    # one region of each class of a mixed value
    classes = written(common.where("mixed").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "pos")).alias("f")), "classes")
    if not keep_first:
        many = classes.where("n > 1").select("h1", "h2")
        if many.count() <= BROADCAST:  # then regions stay where they are, however many share a value; else the join splits such a value
            many = F.broadcast(many)
        full = full.unionByName(common.where("mixed").join(many, ["h1", "h2"]).select("row", "pos"))
    shards = classes.groupBy("h1").agg(F.count(F.lit(1)).alias("regions"))
    sized = written(classes.select("h1", "f.row", "f.pos").join(shards, "h1"), "shards")

    def parts(which: DataFrame) -> DataFrame:
        asked = which.groupBy("row").agg(F.collect_list(F.struct("h1", "pos")).alias("asked"))
        return base.join(asked, "row").mapInArrow(_cut(window, gram), f"h1 long, row long, doc_id {kind}, pos long, lead int, bytes binary")

    solved = parts(sized.where(F.col("regions") <= most)).repartition("h1").sortWithinPartitions("h1", "doc_id", "row", "pos").mapInArrow(_solve(window, 1 << 20), "row long, pos long, later boolean")
    if keep_first:
        solved = solved.where("not later")
    out = full.unionByName(solved.select("row", "pos"))
    large = sized.where(F.col("regions") > most)
    if large.isEmpty():
        return out
    every = written(parts(large).mapInArrow(_windows(window), f"h1 long, row long, doc_id {kind}, first long, w binary"), "windows")
    seen = every.groupBy("h1", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "first")).alias("f")).where("n > 1")
    big = every.join(seen, ["h1", "w"])
    if keep_first:
        big = big.where(F.struct("doc_id", "row", "first") > F.col("f"))
    return out.unionByName(big.select("row", F.shiftleft("first", SHIFT).bitwiseOR(F.lit(1)).alias("pos")))


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text = text or b""
                cover = np.zeros(len(text) + 1, np.int32)
                for r in runs or ():
                    cover[r >> SHIFT] += 1
                    cover[(r >> SHIFT) + (r & ((1 << SHIFT) - 1)) + window - 1] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                spans = [{"start": s, "length": n} for s, n in _runs(gone)]
                removed.append(spans)
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text": batch.column("text"),
                "spans": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
            })

    return run


def suffix_dedup(docs: DataFrame, window: int = 400, keep_first: bool = False, most: int = 20_000) -> DataFrame:
    """doc_id, text (binary), spans array<struct<start, length>> of removed bytes, kept (binary, what is left).

    Null texts count as empty, texts shorter than `window` stay whole, rows of one id and text are copies of one
    another, null ids and other columns are allowed (the latter are not returned). keep_first keeps the first of
    several copies, in the order of doc_id; otherwise every copy goes. An empty table gives an empty table.
    """
    runs = repeated_spans(docs, window, keep_first, most).groupBy("row").agg(F.collect_list("pos").alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select(row_key("doc_id", "text").alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    return base.join(runs, "row", "left").mapInArrow(_apply(window), f"doc_id {kind}, text binary, spans array<struct<start: long, length: long>>, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("repeats"))


def brute_force(texts: list[bytes], window: int) -> list[bytes]:
    """What is left of each text, from a table of all windows; the test's yardstick."""
    starts: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            w = hashlib.sha1(t[i : i + window]).digest()
            starts[w] = starts.get(w, 0) + 1
    kept = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if starts[hashlib.sha1(t[i : i + window]).digest()] > 1:
                gone[i : i + window] = True
        kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
    return kept
