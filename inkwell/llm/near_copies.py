"""Near copies: SimHash finds the closest texts, an exact join finds the rest, exact similarity decides.

Sets of word 5-grams with a Jaccard similarity of 0.8 or more are linked. SimHash fingerprints of the 5-grams go through
the BK-trees of `simhash`: what they link within three bits is a candidate. 64 bits cannot tell a similarity of 0.8 from
a lower one, and a radius that would reach it cannot be sharded, so an exact join completes the links. Sets that are
that similar share a gram early on in any order that holds for all sets: one that leaves, in either set, no fewer grams
from there on than the two must share. Only the grams that can be the first such one are dealt out, with their
positions, so no pair is missed. The order puts grams that many texts have last, by their counts in a sample: that
changes how many candidates there are, not which pairs are found.

Equal sets are one set. A gram of few sets makes candidates of all its pairs. A gram of many sets makes candidates with
a few pivots, the sets in which it comes first; sets that the verified links leave in different components are then
compared in full, chunk by chunk, so no task gathers more than two chunks.

Candidates grow faster than the corpus, links hardly do, so no text travels for a pair that cannot be similar. A set has a
bitmap of a bit or more for each member: bit i is the parity of the members that hash to i. Bitmaps of two sets differ in
no more bits than there are members in only one of them, so pairs whose bitmaps differ in too many bits are dropped without
loss. The rest is verified on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import pieces_of, ship, text_bytes, written
from .components import components
from .simhash import majority, near_links, word_grams

#: Words of a gram; the similarity as a fraction.
GRAM, SHARE = 5, (4, 5)
#: Documents of the sample that orders grams, and how many of them must have a gram for it to be a frequent one.
SAMPLE, FREQUENT = 20_000, 10
#: Sets of a gram that are compared in full at once; pivots of a gram that has more; sets in a chunk of such a gram.
FEW, PIVOTS, CHUNK = 64, 8, 4096
#: Bytes of the bitmap that is dealt out with a gram of many sets; longer bitmaps are folded to it.
SHORT = 64
#: Rows of two longs that may be broadcast.
BROADCAST = 200_000
#: Bits in which fingerprints of the closest texts differ at most.
RADIUS = 3
#: Candidates that leave a task at a time; members of sets that a verifying task remembers.
ROWS, HELD = 1 << 16, 1 << 22


def sets_of(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted different grams of each text."""
    return _sets(*word_grams(data, off, GRAM))


def _sets(h: np.ndarray, grams: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(h, np.cumsum(grams)[:-1])] if len(grams) else []


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-n * SHARE[0] // SHARE[1]) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SHARE[1] >= (len(a) + len(b) - both) * SHARE[0]


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the members by hash: a power of two of bytes, at least SHORT, and at least as many bits as members."""
    bits = max(8 * SHORT, 1 << max(len(s) - 1, 0).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps, a row each, as they would be with `size` bytes."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, size), axis=1)


def _within(differing: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Whether sets of so many members together can be similar if at least so many are in only one of the two."""
    return differing * sum(SHARE) <= members * (SHARE[1] - SHARE[0])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "text", 1 << 20):
        sets = sets_of(*text_bytes(batch.column("text")))
        yield pa.record_batch({"token": pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))})


def _sketches(box):
    """Fingerprint, digest, size and bitmaps of each text's set, and its first members in the order that the sample gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = box.value
        for batch in pieces_of(batches, "text", 1 << 20):
            h, grams = word_grams(*text_bytes(batch.column("text")), GRAM)
            sets = _sets(h, grams)
            first = []
            for s in sets:
                at = np.minimum(np.searchsorted(frequent, s), max(len(frequent) - 1, 0))
                weight = np.where(frequent[at] == s, count[at], 0) if len(frequent) else np.zeros(len(s), np.int64)
                first.append(s[np.lexsort((s, weight))[: prefix_length(len(s))]].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in first]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            bitmaps = [bitmap(s) for s in sets]
            short = [b if len(b) == SHORT else folded(np.frombuffer(b, np.uint8)[None], SHORT).tobytes() for b in bitmaps]
            full = [b if len(b) > SHORT else None for b in bitmaps]
            yield pa.record_batch({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "digest": pa.array(_digests(sets)), "fp": pa.array(majority(h, grams).view(np.int64)), "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": tokens, "short": pa.array(short, pa.binary()), "full": pa.array(full, pa.binary())})

    return run


def _column(values: pa.Array) -> np.ndarray:
    """Short bitmaps as rows of longs, other columns as they are."""
    return values.to_numpy() if pa.types.is_integer(values.type) else text_bytes(values)[0].reshape(-1, SHORT).view(np.uint64)


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Rows of one token at a time, from rows sorted by token."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [_column(batch.column(c)) for c in columns]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        edges = np.flatnonzero(np.diff(held[0])) + 1
        if len(edges):
            several = np.split(np.arange(edges[-1]), edges[:-1])
            yield from ([c[x] for c in held] for x in several if len(x) > 1)
            held = [c[edges[-1] :] for c in held]
    if held and len(held[0]) > 1:
        yield held


def _able(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets a and b, which have a gram at these positions, can be similar if that gram is the first they share."""
    most = np.minimum(n[a], n[b])
    shared = -(-(n[a] + n[b]) * SHARE[0] // sum(SHARE))
    return (most * SHARE[1] >= np.maximum(n[a], n[b]) * SHARE[0]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= shared)


def _pair_batches(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for pair in found:
        held.append(pair)
        size += len(pair[0])
        if size >= ROWS:
            yield _pair_batch(held)
            held, size = [], 0
    if size:
        yield _pair_batch(held)


def _pair_batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array(np.concatenate(x)) for c, x in zip(("a", "b"), zip(*held, strict=True), strict=True)})


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the sets of a gram of few."""

    def pairs():
        for _, digest, n, pos in _groups(batches, ["token", "digest", "n", "pos"]):
            order = np.argsort(digest)
            digest, n, pos = digest[order], n[order], pos[order]
            a, b = np.triu_indices(len(n), 1)
            ok = _able(n, pos, a, b)
            yield digest[a[ok]], digest[b[ok]]

    return _pair_batches(pairs())


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in the cells of large groups: all but the largest component against all."""

    def pairs():
        for _, digest, n, pos, root, short in _groups(batches, ["cell", "digest", "n", "pos", "root", "short"]):
            _, inverse, sizes = np.unique(root, return_inverse=True, return_counts=True)
            small = inverse != np.argmax(sizes)
            for i in np.flatnonzero(small):
                b = np.flatnonzero((inverse != inverse[i]) & (~small | (digest > digest[i])))
                b = b[_able(n, pos, np.full(len(b), i), b)]
                b = b[_within(np.bitwise_count(short[b] ^ short[i]).sum(axis=1, dtype=np.int64), n[b] + n[i])]
                yield np.minimum(digest[b], digest[i]), np.maximum(digest[b], digest[i])

    return _pair_batches(pairs())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose bitmaps do not rule them out."""
    for batch in batches:
        sides = [text_bytes(batch.column(c)) for c in ("ma", "mb")]
        sizes = np.stack([np.diff(off) for _, off in sides], axis=1)
        differing = np.zeros(len(sizes), np.int64)
        for pair in np.unique(sizes, axis=0):
            at = np.flatnonzero((sizes == pair).all(axis=1))
            x, y = (folded(data[off[at][:, None] + np.arange(size)], pair.min()) for (data, off), size in zip(sides, pair, strict=True))
            differing[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        ok = pa.array(_within(differing, batch.column("members").to_numpy()))
        yield pa.record_batch({"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    size = 0
    for batch in batches:
        for piece in pieces_of(pieces_of([batch], "ta", 1 << 20), "tb", 1 << 20):
            if size > HELD:
                held, size = {}, 0
            keys = [piece.column(c).to_pylist() for c in ("a", "b")]
            for key, column in zip(keys, ("ta", "tb"), strict=True):
                at = {k: i for i, k in enumerate(key) if k not in held}
                if at:
                    sets = sets_of(*text_bytes(piece.column(column).take(pa.array(list(at.values())))))
                    held.update(zip(at, sets, strict=True))
                    size += sum(map(len, sets))
            ok = pa.array([similar(held[x], held[y]) for x, y in zip(*keys, strict=True)], pa.bool_())
            yield pa.record_batch({"u": piece.column("a").filter(ok), "v": piece.column("b").filter(ok)})


def _able_rows(left: str, right: str) -> Column:
    """_able() on columns n and pos of two sides of a join."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    shared = F.ceil((n + m) * SHARE[0] / sum(SHARE))
    return (F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]) & (F.least(n - F.col(f"{left}.pos"), m - F.col(f"{right}.pos")) >= shared)


def _prefix_order(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams that many texts of a sample have, sorted, and their counts. The sample orders grams, no more."""
    total = max(docs.count(), 1)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(total)) < SAMPLE)
    seen = sample.mapInArrow(_members, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT).toArrow()
    frequent = seen.column("token").to_numpy().view(np.uint64) if len(seen) else np.zeros(0, np.uint64)
    order = np.argsort(frequent)
    return frequent[order], seen.column("count").to_numpy()[order] if len(seen) else np.zeros(0, np.int64)


def _closest(one: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: sets of one fingerprint, and those of fingerprints that the BK-trees link."""
    prints = written(one.groupBy("fp").agg(F.min("digest").alias("a")), "prints")
    links = near_links(prints.select("fp"), RADIUS)
    ends = [prints.select(F.col("fp").alias(c), F.col("a").alias(d)) for c, d in (("u", "a"), ("v", "b"))]
    same = one.join(prints, "fp").select("a", F.col("digest").alias("b"))
    return same.unionByName(links.join(ends[0], "u").join(ends[1], "v").select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _pivoted(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Candidates of each set of a large gram with the gram's pivots; these are chosen before anything is shuffled."""
    mine = rows.join(large.select("token"), "token")
    rank = F.row_number().over(Window.partitionBy("token").orderBy("pos", "digest"))
    pivots = written(mine.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).drop("rank"), "pivots")
    met = mine.alias("x").join(pivots.alias("y"), "token").where(F.col("x.digest") != F.col("y.digest")).where(_able_rows("x", "y"))
    return met.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b"))


def _row() -> Column:
    """64-bit key of a row by id and text; a missing id is not the same as a missing text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def _groups_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest, and the (none, doc_id, row) that is least in the row's group; rows without an id come last."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(_row().alias("row"), "doc_id", "text")
    box = spark.sparkContext.broadcast(_prefix_order(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = written(docs.mapInArrow(_sketches(box), f"row long, doc_id {kind}, digest long, fp long, n long, tokens array<long>, short binary, full binary"), "sketches")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("low")
    values = written(sketches.groupBy("digest").agg(low), "sets")
    # copies have the same members: the one of least id stands for them
    named = values.select("digest", F.col("low.row").alias("row"))
    one = written(sketches.join(named, ["digest", "row"], "left_semi").dropDuplicates(["digest"]), "one")
    marks = one.select("digest", "n", F.coalesce("full", "short").alias("bitmap"))
    rows = one.select("digest", "n", F.posexplode("tokens").alias("pos", "token"))
    shorts = one.select("digest", "n", "short", F.posexplode("tokens").alias("pos", "token"))
    large = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > FEW), "large")

    def links(candidates: DataFrame) -> DataFrame:
        met = candidates.distinct()
        for c in ("a", "b"):
            met = met.join(marks.select(F.col("digest").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"m{c}")), c)
        met = met.select("a", "b", "ma", "mb", (F.col("na") + F.col("nb")).alias("members"))
        pairs = written(met.mapInArrow(_near, "a long, b long"), "candidates")
        wanted = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
        ids = written(wanted.join(named, "digest").select("digest", "row"), "wanted")
        if ids.count() <= BROADCAST:  # then the texts that are not wanted are not shuffled
            ids = F.broadcast(ids)
        texts = docs.join(ids, "row").select("digest", "text")
        texts = written(texts.dropDuplicates(["digest"]), "candidate_texts")
        left = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
        both = left.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_verify, "u long, v long")

    few = rows.join(large, "token", "left_anti").repartition("token").sortWithinPartitions("token")
    first = few.mapInArrow(_first_pairs, "a long, b long").unionByName(_pivoted(rows, large)).unionByName(_closest(one))
    found = written(links(first), "similar")
    roots = written(components(found), "roots")
    chunks = F.ceil(F.col("sets") / CHUNK).cast("int")
    cells = shorts.join(large, "token").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("digest"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cells = cells.select(F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "digest", "n", "pos", "root", "short")
    more = written(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_other_pairs, "a long, b long").distinct(), "others")
    if not more.isEmpty():
        roots = written(components(found.unionByName(links(more))), "roots")
    rooted = values.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("least"))
    return sketches.select("row", "doc_id", "digest").join(rooted.join(lows, "root").select("digest", "least"), "digest")


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of similar texts lead to, itself included; once for each id and set.

    docs: doc_id, text. Null and blank texts are copies of each other. A null doc_id stays null and names a component
    only if it has no other id.
    """
    return _groups_of(docs).select("doc_id", "digest", F.col("least.doc_id").alias("component_id")).distinct().select("doc_id", "component_id")


def keep_one_copy(docs: DataFrame) -> DataFrame:
    """The row of docs that has the smallest id in each group of near copies; one without an id only if none has one.

    Rows of one id, or of none, are told apart by their texts, so a text of its own stays whatever its id is. Of rows
    that agree in id and text one stays.
    """
    kept = _groups_of(docs).where("row = least.row").select(F.col("row").alias("__row")).distinct()
    rows = docs.withColumn("__row", _row()).join(kept, "__row").dropDuplicates(["__row"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
