"""Benchmark decontamination by a distributed positional inverted index.

`build_index` stores the postings of the training text: the index is partitioned by documents, and each row of the
table is a shard that holds, for every term of some megabytes of text, the ascending word positions at which it occurs.
It is written once and searched as often as one likes. A phrase is found by taking the postings of its rarest term in
the shard, less the term's offset in the phrase, and intersecting them with the offset-adjusted postings of its other
terms, rarest first; a shard that lacks one of the terms is done at once. Proximity starts from the rarest term too.
Postings never leave their shard, so nothing is shuffled. The benchmark goes to the shards in blocks of a fixed size,
each a pass of its own over the stored postings, whatever the benchmark's size is.

`remove_leaks` reads each text once, to search and to cut it, where one block holds the benchmark: it then makes the
shards of its text as it goes, with the postings of the benchmark's terms only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import beside, pieces_of, rejoined, row_key, ship, text_bytes, written
from .suffix_dedup import _power_tables

#: Bytes of benchmark text in a block, which is what a task holds of it at a time.
BLOCK = 4 << 20
#: Bytes of text in a shard of the stored index.
SHARD = 2 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, first byte, byte after the last, text number, 64-bit hash) of the words of texts."""
    low = data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)
    word = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    start, stop = word.copy(), word.copy()
    if len(low):
        start[1:] &= ~word[:-1] | edge[1:-1]
        stop[:-1] &= ~word[1:] | edge[1:-1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _power_tables(len(low) + 2)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
    h = (sums[end] - sums[begin]) * down[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return low, begin, end, np.searchsorted(off, begin, side="right") - 1, h


class PositionalIndex:
    """Postings of terms in a shard of texts: the numbers of the words at which each occurs, counted through all texts."""

    def __init__(self, n_words: np.ndarray, first: np.ndarray, frequency: np.ndarray, positions: np.ndarray):
        """Of term t: positions[first[t] : first[t] + frequency[t]]."""
        self.n_words, self.first, self.frequency, self.positions = n_words, first, frequency, positions
        self.end = np.cumsum(n_words)
        self.head = self.end - n_words  # number of each text's first word

    @classmethod
    def of_texts(cls, data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> PositionalIndex:
        """Of the terms of a vocabulary, sorted hashes of words; their ranks are the term numbers."""
        low, begin, end, doc, h = words_of(data, off)
        seen = np.zeros(1 << 16, bool)
        seen[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
        term = np.minimum(np.searchsorted(vocabulary, h[at]), max(len(vocabulary) - 1, 0))
        ok = vocabulary[term] == h[at] if len(vocabulary) else np.zeros(0, bool)
        at, term = at[ok], term[ok]
        frequency = np.bincount(term, minlength=len(vocabulary))
        out = cls(np.bincount(doc, minlength=len(off) - 1), np.cumsum(frequency) - frequency, frequency, at[np.argsort(term, kind="stable")])
        out.low, out.begin, out.stop = low, begin, end
        return out

    @classmethod
    def of_row(cls, terms: pa.Array, counts: np.ndarray, positions: np.ndarray, n_words: np.ndarray, vocabulary: pa.Array) -> PositionalIndex:
        """A stored shard, for the words of a vocabulary; their places in it are the term numbers."""
        at = pc.index_in(vocabulary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.concatenate((np.cumsum(counts), [0]))
        counts = np.concatenate((counts, [0]))
        return cls(n_words, ends[at] - counts[at], counts[at], positions)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term] + self.frequency[term]]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, positions, side="right")

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms follow one another in one text."""
        found = None
        for i in np.argsort(self.frequency[terms], kind="stable").tolist():
            here = self.postings(terms[i]) - i
            if found is None:
                found = here[here >= 0]
            elif len(here):
                at = np.searchsorted(here, found)
                found = found[here[np.minimum(at, len(here) - 1)] == found]
            else:
                found = here
            if not len(found):
                return found
        return found[found + len(terms) <= self.end[self.text_of(found)]]

    def near(self, terms: np.ndarray, slop: int) -> dict[int, tuple[int, int]]:
        """{text: (length, first position)} of its shortest stretch of up to `slop` words that holds all terms, the first of equals.

        Occurrences of the rarest term lead: those stay that have every other term less than `slop` words away.
        """
        order = sorted(set(terms.tolist()), key=lambda t: self.frequency[t])
        center = self.postings(order[0])
        text = self.text_of(center)
        low, high = np.maximum(center - slop + 1, self.head[text]), np.minimum(center + slop, self.end[text])
        for t in order[1:]:
            here = self.postings(t)
            ok = np.searchsorted(here, low) < np.searchsorted(here, high)
            center, text, low, high = center[ok], text[ok], low[ok], high[ok]
        best: dict[int, tuple[int, int]] = {}
        for doc, a, b in zip(text.tolist(), low.tolist(), high.tolist(), strict=True):
            around = sorted((int(p), t) for t in order for p in self.postings(t)[slice(*np.searchsorted(self.postings(t), [a, b]))])
            last: dict[int, int] = {}
            for p, t in around:
                last[t] = p
                if len(last) == len(order):
                    first = min(last.values())
                    if p - first < slop:
                        best[doc] = min(best.get(doc, (slop + 1, 0)), (p - first + 1, first))
        return best

    def word(self, number: int) -> bytes:
        return self.low[self.begin[number] : self.stop[number]].tobytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the postings of all terms."""
    for batch in pieces_of(batches, "text", SHARD):
        low, begin, end, doc, h = words_of(*text_bytes(batch.column("text")))
        _, first, term = np.unique(h, return_index=True, return_inverse=True)
        width = end - begin
        same = (width == width[first][term]).all() if len(h) else True
        if same and len(h):  # words of one hash are one word: compare them byte by byte
            shift = np.repeat(begin[first][term] - begin, width)
            here = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(width.sum())
            same = (low[here] == low[here + shift]).all()
        if not same:
            numbers: dict[bytes, int] = {}
            term = np.array([numbers.setdefault(low[a:b].tobytes(), len(numbers)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            first = np.unique(term, return_index=True)[1]
        lengths = (end - begin)[first] if len(h) else np.zeros(0, np.int64)
        parts = (np.repeat(begin[first] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())) if len(h) else np.zeros(0, np.int64)
        numbers = {"ends": np.concatenate(([0], np.cumsum(lengths))), "counts": np.bincount(term, minlength=len(first)) if len(h) else lengths, "positions": np.argsort(term, kind="stable")}
        one = pa.array([0, len(batch)], pa.int32())
        lists = {"doc_ids": batch.column("doc_id"), "row": batch.column("row"), "n_words": pa.array(np.bincount(doc, minlength=len(batch)), pa.int64())}
        yield pa.record_batch(
            {"shard": pa.array([uuid.uuid4().hex])}
            | {c: pa.ListArray.from_arrays(one, v) for c, v in lists.items()}
            | {"terms": pa.array([low[parts].tobytes()], pa.binary())}
            | {c: pa.array([v.astype("<i4").tobytes()], pa.binary()) for c, v in numbers.items()}
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The stored positional index of docs (doc_id, text), a row for each shard: its documents and the postings of all its terms.

    shard string; doc_ids, row (row_key of id and text) and n_words, arrays with a value for each document; terms, the
    different words one after the other, and as little-endian 32-bit numbers: ends (of the words in terms, from 0 on),
    counts (of each term) and positions (term after term; words are numbered through the shard).
    Null and empty texts have no words; repeated rows are documents of their own; an empty table has no shards.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    return written(rows.mapInArrow(_store, f"shard string, doc_ids array<{kind}>, row array<long>, n_words array<long>, terms binary, ends binary, counts binary, positions binary"), "postings")


class Queries:
    """Windows of benchmark items: each different one once, with the items that have it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        low, begin, end, doc, h = words_of(*text_bytes(texts))
        found: dict[tuple, set] = {}
        self.window = window
        words = [low[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        for i, (name, _) in enumerate(items):
            at = np.flatnonzero(doc == i) if len(items) < 2 else np.arange(*np.searchsorted(doc, [i, i + 1]))
            for k in range(max(1, len(at) - window + 1) if len(at) else 0):
                found.setdefault(tuple(at[k : k + window].tolist()), set()).add(name)
        merged: dict[tuple, tuple] = {}
        for at, names in found.items():
            key = tuple(words[i] for i in at)
            merged.setdefault(key, (at, set()))[1].update(names)
        self.vocabulary, first = np.unique(h, return_index=True)
        self.vocabulary_words = pa.array([words[i] for i in first.tolist()], pa.binary())
        self.words = list(merged)
        self.items = [sorted(names) for _, names in merged.values()]
        self.terms = [np.searchsorted(self.vocabulary, h[list(at)]) for at, _ in merged.values()]
        full = [i for i, t in enumerate(self.terms) if len(t) == window]
        self.full = np.array(full, np.int64)
        self.matrix = np.array([self.terms[i] for i in full], np.int64).reshape(len(full), window)
        self.short = [i for i, t in enumerate(self.terms) if len(t) != window]

    def search(self, index: PositionalIndex) -> list[tuple[int, int, int]]:
        """(text, first word, window) of every occurrence."""
        able = self.full[(index.frequency[self.matrix] > 0).all(axis=1)].tolist() if len(self.full) else []
        out = []
        for w in [*able, *self.short]:
            found = index.phrase(self.terms[w])
            for p, doc in zip(found.tolist(), index.text_of(found).tolist(), strict=True):
                if not hasattr(index, "low") or all(index.word(p + k) == x for k, x in enumerate(self.words[w])):
                    out.append((doc, p - int(index.head[doc]), w))
        return out


_KIND = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[tuple[dict, PositionalIndex]]:
    for batch in batches:
        for i in range(len(batch)):
            part = {c: batch.column(c)[i].values for c in ("doc_ids", "row", "n_words")} | {"shard": batch.column("shard")[i].as_py()}
            terms, ends, counts, positions = (batch.column(c)[i].as_buffer() for c in ("terms", "ends", "counts", "positions"))
            words = pa.Array.from_buffers(pa.binary(), len(counts) // 4, [None, ends, terms])
            yield part, PositionalIndex.of_row(words, *(np.frombuffer(x, "<i4").astype(np.int64) for x in (counts, positions)), part["n_words"].to_numpy(), vocabulary)


def _found(part: dict, **columns: pa.Array) -> pa.RecordBatch:
    n = len(part["doc_ids"])
    return pa.record_batch({"shard": pa.array([part["shard"]] * n, pa.string()), "at": pa.array(np.arange(n), pa.int64()), "doc_id": part["doc_ids"], "row": part["row"]} | columns)


def _search(box):
    """Each document of each shard with its matches of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = box.value
        for part, index in _shards(batches, queries.vocabulary_words):
            matches: list = [[] for _ in range(len(part["doc_ids"]))]
            for doc, at, w in queries.search(index):
                matches[doc] += [{"item_id": name, "start": at, "length": len(queries.words[w])} for name in queries.items[w]]
            yield _found(part, n_words=part["n_words"], matches=pa.array(matches, _KIND))

    return run


def _cut(box, contaminated: int):
    """Rows of fewer items than `contaminated`, without the words of their matches, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = box.value
        for batch in pieces_of(batches, "text", 1 << 20):
            index = PositionalIndex.of_texts(*text_bytes(batch.column("text")), queries.vocabulary)
            spans: list = [[] for _ in range(len(batch))]
            names: list[set] = [set() for _ in range(len(batch))]
            for doc, at, w in queries.search(index):
                spans[doc].append((at, len(queries.words[w])))
                names[doc].update(queries.items[w])
            yield _without(batch, spans, names, contaminated)

    return run


def _cut_known(contaminated: int):
    """The same for texts whose matches are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1 << 20):
            matches = [m or [] for m in batch.column("matches").to_pylist()]
            yield _without(batch, [[(m["start"], m["length"]) for m in own] for own in matches], [{m["item_id"] for m in own} for own in matches], contaminated)

    return run


def _without(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]], names: list[set], contaminated: int) -> pa.RecordBatch:
    data, off = text_bytes(batch.column("text"))
    texts = batch.column("text").to_pylist()
    for i in (i for i, own in enumerate(spans) if own):
        mine = data[off[i] : off[i + 1]]
        _, begin, end, _, _ = words_of(mine, np.array([0, len(mine)]))
        gone = np.zeros(len(mine) + 1, np.int32)
        for start, length in spans[i]:
            gone[begin[start]] += 1
            gone[end[start + length - 1]] -= 1
        texts[i] = mine[np.cumsum(gone)[:-1] <= 0].tobytes().decode()
    stay = pa.array([len(own) < contaminated for own in names], pa.bool_())
    return pa.record_batch({"row": batch.column("row"), "text": pa.array(texts, pa.string()), "cut": pa.array([bool(own) for own in spans], pa.bool_())}).filter(stay)


_MATCHES = "array<struct<item_id: string, start: long, length: long>>"


def _blocks(benchmark: DataFrame, window: int, block: int) -> list:
    """The benchmark's windows, broadcast in blocks of a bounded size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    blocks = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block + 1
    parts = (items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) for i in range(blocks))
    return [benchmark.sparkSession.sparkContext.broadcast(Queries([(r.item_id, r.text) for r in part.collect()], window)) for part in parts]


def _searched(index: DataFrame, boxes: list) -> DataFrame:
    """doc_id, row, n_words, matches of all blocks: each block is a pass of its own over the stored index."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    passes = [index.mapInArrow(_search(box), f"shard string, at long, doc_id {kind}, row long, n_words long, matches {_MATCHES}") for box in boxes]
    out = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            out = out.unionByName(more.where(F.size("matches") > 0))
        out = out.groupBy("shard", "at").agg(*[F.first(c).alias(c) for c in ("doc_id", "row", "n_words")], F.flatten(F.collect_list("matches")).alias("matches"))
    return out.select("doc_id", "row", "n_words", "matches")


def phrase_matches(index: DataFrame, benchmark: DataFrame, window: int = 8, block: int = BLOCK) -> DataFrame:
    """benchmark_matches of the documents of a stored index."""
    ship(index.sparkSession)
    return _searched(index, _blocks(benchmark, window, block)).select("doc_id", "n_words", "matches")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, matches array<struct<item_id string, start, length>> in words, one row for each row of docs.

    Texts are compared as words in lower case (A-Z only) of digits, letters and all characters beyond ASCII. A match
    is an occurrence of `window` words in a row of an item, or of a whole item with fewer. Null or wordless texts
    have no words and no matches. Rows of one item_id are one item; a null item_id counts as the empty string.
    Repeated documents are each searched; other columns are not returned.
    """
    return phrase_matches(build_index(docs), benchmark, window, block)


def _near(box, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = box.value
        for part, index in _shards(batches, queries.vocabulary_words):
            places: list = [[] for _ in range(len(part["doc_ids"]))]
            for w, terms in enumerate(queries.terms):
                if (index.frequency[terms] > 0).all():
                    for doc, (length, first) in index.near(terms, slop).items():
                        places[doc] += [{"item_id": name, "start": first - int(index.head[doc]), "length": length} for name in queries.items[w]]
            found = _found(part, matches=pa.array(places, _KIND))
            yield found.filter(pa.array([bool(p) for p in places], pa.bool_()))

    return run


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int = 8, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, length: where a document's words come near an item's.

    index: build_index(); queries: item_id, text, a few words each. A row for each document and item of which all the
    words stand in a stretch of up to `slop` words, in any order and however often: its shortest such stretch, the first
    of equals. Items without words match nothing; repeated documents are each searched.
    """
    ship(index.sparkSession)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    out = None
    for box in _blocks(queries, 1 << 30, block):
        found = index.mapInArrow(_near(box, slop), f"shard string, at long, doc_id {kind}, row long, matches {_MATCHES}")
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.start", "m.length")


def covered_words(matches: str = "matches"):
    """Words inside any match, as a column: matches in order of start, each adding what lies beyond those before it."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["e"]))).alias("n"), F.greatest(acc["e"], x["e"]).alias("e"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def matched_items(matches: str = "matches"):
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.select("doc_id", "n_words", covered_words().alias("n_hit"), matched_items().alias("items"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: op7_decontaminate by a join of all windows, for tables of a test's size; a word holds no space.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark),
 q AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
 m AS (SELECT p.doc_id, p.i, p.n, q.item_id FROM p JOIN q ON p.g = q.g AND p.n = q.n),
 h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
 s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, contaminated: int = 2, block: int = BLOCK) -> DataFrame:
    """docs without benchmark text; rows and columns stay as they are but for the following.

    A document in which `contaminated` items or more occur goes; of the others, the words of every match, and what
    stands between them, are cut out of the text, and n_chars follows it.
    """
    ship(docs.sparkSession)
    boxes, rows = _blocks(benchmark, window, block), beside(docs)
    kind = f"row {rows.schema['row'].dataType.simpleString()}, text string, cut boolean"
    if len(boxes) == 1:
        out = rows.mapInArrow(_cut(boxes[0], contaminated), kind)
    else:
        hits = _searched(build_index(docs), boxes).where(F.size("matches") > 0).groupBy(F.col("row").alias("__row")).agg(F.first("matches").alias("matches"))
        keyed = rows.withColumn("__row", row_key("row.doc_id", "text"))
        out = keyed.join(hits, "__row", "left").select("row", "text", "matches").mapInArrow(_cut_known(contaminated), kind)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return rejoined(out, docs.columns, **new)
