"""From files to searchable chunks, as one set-at-a-time job: only what changed is read, masked, cut and embedded."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chunker_config, document_id, model_key
from ..sources.files import extracted
from . import chunker, guard
from .store import SLICE, Store, changes, duplicates, reuse, without

SENSITIVITIES = ("Public", "Internal", "Client-Confidential", "Restricted")
#: A file whose document agrees in all of these is left alone; the settings include whether Restricted text is embedded.
NO_OP = ["source_sha256", "registry_version", "sensitivity", "chunker_config"]


class EmptyRegistry(RuntimeError):
    pass


def masked_blocks(blocks: str, matcher: guard.Matcher):
    """Texts and headings of an array of blocks masked; one pass over an array keeps a document in one row."""
    kind = f"array<{chunker.BLOCK}>"

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            return None if v is None else [{**b, "text": matcher.mask(b["text"]), "heading_path": [matcher.mask(h) for h in b["heading_path"]]} for b in v]

        return values.map(one)

    return run(F.col(blocks))


def prepare(files: DataFrame, matcher: guard.Matcher, target: int = chunker.TARGET, overlap: float = chunker.OVERLAP, merge: int = chunker.MERGE, staged: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, occurrences) of files (doc_id, filename, content); nothing leaves unmasked.

    staged writes a table and reads it again, so that a file is read, masked and cut once.
    """
    read = extracted(files)
    every = F.concat_ws("\n", "filename", "title", F.array_join(F.flatten(F.transform("blocks", lambda b: F.concat(F.array(b["text"]), b["heading_path"]))), "\n"))
    hits = guard.scan(F.when(F.col("error").isNull(), every), matcher)
    docs = staged(read.withColumns({"title": guard.mask("title", matcher), "filename": guard.mask("filename", matcher), "blocks": masked_blocks("blocks", matcher), "error": guard.mask("error", matcher), "_found": hits}))
    chunks = staged(chunker.chunk_documents(docs.drop("_found").where("error is null and not needs_ocr"), target, overlap, merge))
    return docs.drop("_found"), chunks, docs.select("doc_id", F.inline("_found"))


def with_vectors(store: Store, chunks: DataFrame, factory: Callable, size: int) -> DataFrame:
    """Vectors of chunks: those of unchanged texts, those that an earlier job left behind, and new ones, made slice by slice."""
    model = model_key(factory().model)
    texts = chunks.select("chunk_id", "doc_id", "chunk_sha256", "embed_text")
    known = lambda: reuse(texts, store.read("vectors").unionByName(store.read("pending")), model)
    store.embed_slices(lambda: known().where("vector is null"), factory, "pending", size)
    return known().select("chunk_id", "doc_id", "chunk_sha256", F.lit(model).alias("model_key"), F.size("vector").alias("dim"), "vector")


def ingest(store: Store, files: DataFrame, registry: guard.Registry, key: bytes, factory: Callable, space: str = "release", sensitivity: str = "Internal", embed_restricted: bool = False, force: bool = False, target: int = chunker.TARGET, overlap: float = chunker.OVERLAP, merge: int = chunker.MERGE, size: int = SLICE) -> DataFrame:
    """Bring files (source_key, filename, content) into the store; doc_id, filename, outcome of each.

    Outcomes: ingested, unchanged (same bytes under the same registry, sensitivity and settings), duplicate (the bytes
    are stored under another key), failed, needs_ocr, restricted and empty. Only rows of documents that change are written.
    """
    if not registry.active():
        raise EmptyRegistry("the registry is empty; nothing may be ingested unmasked")
    if sensitivity not in SENSITIVITIES:
        raise ValueError(f"sensitivity must be one of {', '.join(SENSITIVITIES)}")
    config = f"{chunker_config(chunker.VERSION, target, overlap, merge)}/r{int(embed_restricted)}"
    keyed = files.select(document_id(key, F.lit(space), "source_key").alias("doc_id"), "filename", "content", F.sha2("content", 256).alias("source_sha256"), F.octet_length("content").cast("long").alias("source_bytes")).dropDuplicates(["doc_id"])
    new = keyed.select("doc_id", "filename", "source_sha256", F.lit(registry.version).cast("long").alias("registry_version"), F.lit(sensitivity).alias("sensitivity"), F.lit(config).alias("chunker_config"))
    stored = store.read("documents").where("status <> 'failed'")
    seen = changes(stored, new, "doc_id", NO_OP).where("change <> 'gone'")
    if force:
        seen = seen.withColumn("change", F.when(F.col("change") == "unchanged", "changed").otherwise(F.col("change")))
    copies = duplicates(seen.where("change = 'new'"), stored).select("doc_id")
    work = without(seen.where("change <> 'unchanged'").select("doc_id"), copies, "doc_id")
    now = F.lit(datetime.now(UTC))
    with store.staging() as staged:
        seen, copies, work = staged(seen), staged(copies), staged(work)
        if not work.isEmpty():
            todo = keyed.join(work, "doc_id", "left_semi")
            docs, chunks, found = prepare(todo, registry.matcher(), target, overlap, merge, staged)
            closed = sensitivity == "Restricted" and not embed_restricted
            status = F.when(F.col("error").isNotNull(), "failed").when(F.col("needs_ocr"), "needs_ocr").when(F.lit(closed), "restricted").when(F.size("blocks") == 0, "empty").otherwise("ready")
            chunks = chunks.drop("chunker_config").withColumns({"chunker_config": F.lit(config), "space": F.lit(space), "sensitivity": F.lit(sensitivity)})
            chunks = chunks.join(docs.select("doc_id", "file_type"), "doc_id").where(F.lit(not closed))
            guard.assert_clean(chunks, registry.matcher(), "text", "embed_text", "heading_path", where="ingest")
            vectors = with_vectors(store, chunks, factory, size)
            others = store.read("vectors").where(F.col("model_key") != model_key(factory().model)).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
            counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
            records = docs.join(counts, "doc_id", "left").withColumns(
                {"space": F.lit(space), "sensitivity": F.lit(sensitivity), "status": status, "registry_version": F.lit(registry.version).cast("long"), "chunker_config": F.lit(config), "ingested_at": now, "chunk_count": F.coalesce("chunk_count", F.lit(0))}
            )
            jobs = docs.select("doc_id", F.lit("indexed").alias("stage"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", now.alias("at"))
            sources = todo.select("doc_id", "filename", "content", F.lit(space).alias("space"), F.lit(sensitivity).alias("sensitivity"))
            fresh = {"documents": records, "chunks": chunks, "vectors": vectors.unionByName(others), "occurrences": found, "jobs": jobs, "sources": sources}
            store.commit({"pending": store.read("pending").limit(0)}, {name: df.select([c for c in store.read(name).columns if c in df.columns]) for name, df in fresh.items()}, work)
        outcome = store.read("documents").select("doc_id", F.when(F.col("status") == "ready", "ingested").otherwise(F.col("status")).alias("stored"))
        flags = seen.select("doc_id", "filename", "change").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").join(outcome, "doc_id", "left")
        done = flags.select("doc_id", "filename", F.when(F.col("copy"), "duplicate").when(F.col("change") == "unchanged", "unchanged").otherwise(F.col("stored")).alias("outcome"))
        return store.outcomes(done)


def remask(store: Store, registry: guard.Registry, key: bytes, factory: Callable, **settings) -> int:
    """Mask the documents of older registry versions anew from their sources; chunks whose text stays keep their vectors."""
    stale = store.stale(registry)
    n = 0
    groups = stale.select("space", "sensitivity").distinct().collect()  # a handful: spaces x sensitivities
    for g in groups:
        own = stale.where((F.col("space") == g["space"]) & (F.col("sensitivity") == g["sensitivity"])).select("doc_id")
        n += own.count()
        _again(store, own, registry, factory, **settings)
    return n


def _again(store: Store, ids: DataFrame, registry: guard.Registry, factory: Callable, size: int = SLICE, **settings) -> None:
    with store.staging() as staged:
        ids = staged(ids)
        sources = store.read("sources").join(ids, "doc_id", "left_semi")
        docs, chunks, found = prepare(sources.select("doc_id", "filename", "content"), registry.matcher(), staged=staged, **settings)
        old = store.read("documents").join(ids, "doc_id", "left_semi")
        facts = old.select("doc_id", "space", "sensitivity", "file_type", "chunker_config")
        chunks = chunks.drop("chunker_config").join(facts, "doc_id").join(old.where("status <> 'restricted'").select("doc_id"), "doc_id", "left_semi")
        vectors = with_vectors(store, chunks, factory, size)
        counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        records = old.drop("title", "filename", "registry_version", "chunk_count").join(docs.select("doc_id", "title", "filename"), "doc_id").join(counts, "doc_id", "left")
        records = records.withColumns({"registry_version": F.lit(registry.version).cast("long"), "chunk_count": F.coalesce("n", F.lit(0))}).drop("n")
        fresh = {"documents": records, "chunks": chunks.select(store.read("chunks").columns), "vectors": vectors, "occurrences": found}
        store.commit({"pending": store.read("pending").limit(0)}, fresh, ids)


def protect(store: Store, registry: guard.Registry, surface: str, key: bytes, factory: Callable, kind: str = "org", **settings) -> int:
    """A reviewed candidate becomes a protected name, and every document is masked anew under the registry that has it."""
    registry.add(surface, kind)
    return remask(store, registry, key, factory, **settings)


def after_change(store: Store, registry: guard.Registry, key: bytes, factory: Callable, **settings) -> int | None:
    """remask after a change of the registry, where anything is stored; an error is a warning, and the documents stay stale."""
    try:
        return None if store.read("documents").isEmpty() else remask(store, registry, key, factory, **settings)
    except Exception as e:  # the change itself must stand
        warnings.warn(f"masking anew failed: {e}", stacklevel=2)
        return None
