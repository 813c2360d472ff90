"""Best-fit packing by minimum bin slack.

Only lengths matter for packing, and there are at most `capacity` of them, so the plan is made on the histogram of
lengths, which is as small for any corpus. Each bin starts with the longest piece left; subset sums over the
available lengths, a bitset in one integer, give the fullest feasible rest, which is then removed. The same bin is
repeated for as long as its pieces last, just as the next searches would find it again. Pieces are numbered within
their length in parallel, and the plan turns (length, number) into a sequence and an offset by arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import pieces_of, ship, text_bytes, written
from .suffix_dedup import _power_tables

#: Pieces in a task that numbers them.
SLICE = 100_000
#: Words whose ids a worker remembers.
REMEMBERED = 600_000
_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class HashTable:
    """Numbers of 64-bit hashes in order of their addition; open addressing over arrays, for many keys at a time."""

    def __init__(self, bits: int = 20):
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Their numbers, -1 where unknown; a key is never 0."""
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.values[at], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = slot = (at[open_] + 1) & mask
            key = self.keys[slot]
            hit = key == h[open_]
            out[open_[hit]] = self.values[slot[hit]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Different keys that are not known yet; the arrays grow so that half of them stays free."""
        if 2 * (self.size + len(h)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            known = self.keys[used[np.argsort(self.values[used])]]
            self.__init__((4 * (self.size + len(h))).bit_length())
            self.add(known)
        mask = len(self.keys) - 1
        at, number = (h & np.uint64(mask)).astype(np.int64), np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = h[free]
            done = free[self.keys[at[free]] == h[free]]
            self.values[at[done]] = number[done]
            rest = np.ones(len(h), bool)
            rest[done] = False
            h, at, number = h[rest], (at[rest] + 1) & mask, number[rest]


class WordTokenizer:
    """Ids of a BPE with word ends over lower-cased words, as the tokenizers library gives them.

    Words are cut and hashed for a whole batch at once and only words not met before go through the model. That holds
    for characters whose composition and lower case do not depend on their neighbours; other texts, and texts with
    the strings of special tokens, go through the library as they are.
    """

    SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self._forget()
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.bytes_as = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.kind = np.full(1 << 16, 9, np.uint8)  # 0 space, 1 letter, 2 number, 3 other, 9 not handled here
        self.lower = np.arange(1 << 16, dtype=np.uint32)
        import unicodedata

        for c in chain(range(0x250), range(0x2010, 0x2028), (0x20AC,)):
            low = chr(c).lower()
            if len(low) == 1 and (low == chr(c) or ord(low) < 0x250):
                self.lower[c] = ord(low)
                self.kind[c] = 0 if c in self.SPACES else {"L": 1, "N": 2}.get(unicodedata.category(low)[0], 3)

    def _forget(self) -> None:
        self.known = HashTable()
        #: The ids of known word i are flat[begin[i]:][:width[i]].
        self.flat, self.begin, self.width = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        model, table = self.whole.model, self.bytes_as
        ids = [[t.id for t in model.tokenize(w.encode().decode("latin-1").translate(table))] for w in words]
        self.known.add(hashes)
        width = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(width) - width))
        self.width = np.concatenate((self.width, width))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(width.sum()))))

    def _words(self, chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, one after the last) character of the words of lower-cased texts."""
        kind = self.kind[chars]
        new = np.ones(len(chars) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[off] = True
        # 's 't 'm 'd 're 've 'll stand alone if the quote starts a run of its own
        quote = np.flatnonzero((chars[:-1] == 0x27) & new[:-2] & new[1:-1] & (kind[1:] == 1)) if len(chars) > 1 else np.zeros(0, np.int64)
        edge = np.zeros(len(chars) + 1, bool)
        edge[off] = True
        for q in quote[~edge[quote + 1]].tolist() if len(quote) else ():
            two = "".join(map(chr, chars[q + 1 : q + 3])) if q + 2 < len(chars) and not edge[q + 2] else chr(chars[q + 1])
            n = 2 if two[0] in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if n:
                new[q + 1] = False
                new[q + n] = True
        start = np.flatnonzero(new)
        first, after = start[:-1], start[1:]
        ok = kind[first] != 0
        return first[ok], after[ok]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets) of texts in UTF-8."""
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=at[1:])
        coff = at[off]
        n = len(off) - 1
        bad = np.zeros(len(chars) + 1, np.int32)
        small = np.minimum(chars, 0xFFFF).astype(np.int64)
        np.cumsum(self.kind[small] == 9, out=bad[1:])
        hard = bad[coff[1:]] > bad[coff[:-1]]
        for s in self.special:
            raw = data.tobytes()
            p = raw.find(s.encode())
            while p >= 0:
                hard[np.searchsorted(off, p, side="right") - 1] = True
                p = raw.find(s.encode(), p + 1)
        low = self.lower[small]
        first, after = self._words(low, coff)
        up, down = _power_tables(len(low) + 2)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        h = (sums[after] - sums[first]) * down[first]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        doc = np.searchsorted(coff, first, side="right") - 1
        easy = ~hard[doc]
        first, after, h, doc = first[easy], after[easy], h[easy], doc[easy]
        h = np.maximum(h, np.uint64(1))
        if self.known.size > REMEMBERED:
            self._forget()
        number = self.known.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            _, lead = np.unique(h[missing], return_index=True)
            lead = missing[lead]
            letters = low.astype("<u4").tobytes()
            spans = zip(first[lead].tolist(), after[lead].tolist(), strict=True)
            self._learn(h[lead], [letters[4 * a : 4 * b].decode("utf-32-le") for a, b in spans])
            number[missing] = self.known.find(h[missing])
        size = self.width[number]
        place = np.cumsum(size) - size
        out = self.flat[np.repeat(self.begin[number] - place, size) + np.arange(size.sum())]
        counts = np.bincount(doc, weights=size, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
        if hard.any():
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(hard).tolist():
                parts[i] = np.array(self.whole.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            out, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return out, np.concatenate(([0], np.cumsum(counts)))


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _cut(path: str, capacity: int, end: int, digest: Callable[[bytes], int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(path)
        for batch in pieces_of(batches, "text", 1 << 20):
            ids, off = tokens.encode(*text_bytes(batch.column("text")))
            rows: list = []
            for i in range(len(batch)):
                own = np.append(ids[off[i] : off[i + 1]], np.uint32(end)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((i, k, start, len(part), digest(part.tobytes()) if digest else part.tobytes()))
            at, piece, start, length, made = zip(*rows, strict=True)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(at)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids": pa.array(made, pa.int64() if digest else pa.binary()),
            })

    return run


def fullest(available: list[list[int]], room: int) -> dict[int, int]:
    """The multiset of available (length, count), longest first, whose sum is the largest up to `room`."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length, count in available:
        if length > room:
            continue
        count, n = min(count, room // length), 1
        while count > 0:
            n = min(n, count)
            steps.append((length, n, reach))
            reach |= reach << length * n & mask
            count -= n
            n *= 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> left & 1:
            out[length] = out.get(length, 0) + n
            left -= length * n
    return out


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> how many, how often)."""
    left = [[n, c] for n, c in sorted(histogram.items(), reverse=True) if c]
    at = {n: x for x in left for n in x[:1]}
    plan = []
    while left:
        longest = left[0][0]
        left[0][1] -= 1
        bin_ = fullest([x for x in left if x[1]], capacity - longest)
        left[0][1] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(at[n][1] // k for n, k in bin_.items())
        for n, k in bin_.items():
            at[n][1] -= k * times
        plan.append((bin_, times))
        left = [x for x in left if x[1]]
    return plan


def _place(box, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, many, base, inner = box.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            i = np.searchsorted(key, length << 44 | number, side="right") - 1
            k = number - (key[i] & ((1 << 44) - 1))
            yield pa.record_batch({c: batch.column(c) for c in names} | {"sequence_id": pa.array(base[i] + k // many[i]), "offset": pa.array(inner[i] + k % many[i] * length)})

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (column length, 1 to capacity, and doc_id, piece) with sequence_id and offset added."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    key, many, base, inner = [], [], [], []
    used, sequence = dict.fromkeys(histogram, 0), 0
    for bin_, times in pack_plan(histogram, capacity):
        offset = 0
        for length, k in sorted(bin_.items(), reverse=True):
            key.append(length << 44 | used[length])
            many.append(k)
            base.append(sequence)
            inner.append(offset)
            used[length] += k * times
            offset += k * length
        sequence += times
    order = np.argsort(np.array(key, np.int64))
    box = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (key, many, base, inner)))
    slices = 1 + sum(histogram.values()) // SLICE
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    heads = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece")) - 1
    numbered = sliced.withColumn("inside", inside).join(heads, ["length", "slice"]).withColumn("number", F.col("head") + F.col("inside"))
    names = pieces.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.select(*names, "number").mapInArrow(_place(box, names), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: the ids of every text, then `end`, in full sequences.

    Only texts of more than `capacity` ids are cut. ids holds unsigned little-endian 32-bit ids, or what `digest`
    makes of them. A null or blank text is the end id alone. Each row is packed, repeated rows too; a null doc_id
    stays null, other columns are not returned, and an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, end, digest), f"doc_id {kind}, piece int, start long, length long, ids {'long' if digest else 'binary'}")
    return pack(written(pieces, "pieces"), capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), digest=zlib.crc32).withColumnRenamed("ids", "ids_crc32")
