"""The corpus store: tables of parts under an atomic pointer, and the joins behind incremental ingest.

A store is a folder with one folder of parts for each table and a small file that names the parts of all of them. A
commit writes new parts and the ids of the documents that they replace, then replaces that file: readers see all of it
or nothing, a job that dies leaves the old state, and what did not change is not written again. Every FAN parts of one
level become one part of the next, so a row is written once for each level. Files are reached through Hadoop, so the
folder can be in any store.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import guard

# ---------------------------------------------------------------- joins


def changes(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """key, change (new, gone, changed, unchanged) and the new fields; compare: the fields that make a no-op."""
    o = old.select(F.col(key).alias("_key"), F.struct(*compare).alias("_old"))
    n = new.withColumn("_new", F.struct(*compare))
    kind = F.when(F.col("_new").isNull(), "gone").when(F.col("_key").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    both = n.join(o, n[key] == o["_key"], "full").withColumn("change", kind)
    return both.select(F.coalesce(key, "_key").alias(key), "change", *[c for c in new.columns if c != key])


def duplicates(new: DataFrame, stored: DataFrame, key: str = "doc_id", sha: str = "source_sha256") -> DataFrame:
    """Rows of new whose bytes are stored under another key, with that key."""
    known = stored.groupBy(sha).agg(F.min(key).alias("duplicate_of"))
    return new.join(known, sha).where(F.col("duplicate_of") != F.col(key))


def reuse(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """chunks with the vector that the model gave the same text of the same document before, or null."""
    own = vectors.where(F.col("model_key") == model).select("doc_id", "chunk_sha256", "vector").dropDuplicates(["doc_id", "chunk_sha256"])
    return chunks.join(own, ["doc_id", "chunk_sha256"], "left")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, *key: str) -> DataFrame:
    return stored.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_missing(stored: DataFrame, fresh: DataFrame, *key: str) -> DataFrame:
    return stored.unionByName(fresh.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def count_by(rows: DataFrame, *names: str) -> DataFrame:
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def weighted_mode(rows: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """The value of most weight in each group, the smallest of equals."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("weight"), F.col(value))).alias(value))


# ---------------------------------------------------------------- parts

#: So many parts of one level are merged.
FAN = 8
#: Vectors are made and kept in slices of about so many chunks; a job that dies loses one slice.
SLICE = 50_000
#: pending holds the vectors of an ingest that is not committed yet.
TABLES = {
    "documents": "doc_id string, title string, filename string, space string, sensitivity string, file_type string, source_sha256 string, source_bytes long, warnings array<string>, status string, registry_version long, chunker_config string, chunk_count long, ingested_at timestamp",
    "chunks": "chunk_id string, doc_id string, chunk_index int, heading_path array<string>, text string, embed_text string, page_start int, page_end int, block_types array<string>, token_estimate int, overlap_tokens int, chunk_sha256 string, chunker_version string, chunker_config string, space string, sensitivity string, file_type string",
    "vectors": "chunk_id string, doc_id string, chunk_sha256 string, model_key string, dim int, vector array<float>",
    "sources": "doc_id string, filename string, space string, sensitivity string, content binary",
    "occurrences": "doc_id string, layer string, entity_id long, rule string, surface string, start int, confidence double, status string",
    "pending": "chunk_id string, doc_id string, chunk_sha256 string, model_key string, dim int, vector array<float>",
    "jobs": "doc_id string, stage string, status string, error string, at timestamp",
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        where, fs = self._file("current.json")
        if not fs.exists(where):
            return {"version": 0, "tables": {}, "settings": {"model": "hashed-words"}}
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self._live(name, self.state()["tables"].get(name, []))

    def _live(self, name: str, parts: list[dict]) -> DataFrame:
        """Rows of parts whose documents no later part replaces."""
        out = self.spark.createDataFrame([], TABLES[name]).withColumn("_part", F.lit(0))
        gone = None
        for i, part in enumerate(parts):
            if part["rows"]:
                out = out.unionByName(self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{part['rows']}").withColumn("_part", F.lit(i)))
            if part["gone"] and i:
                keys = self.spark.read.schema("doc_id string").parquet(f"{self.path}/gone/{part['gone']}").select(F.col("doc_id").alias("_gone"), F.lit(i).alias("_until"))
                gone = keys if gone is None else gone.unionByName(keys)
        if gone is not None:
            out = out.join(gone, (out["doc_id"] == gone["_gone"]) & (out["_part"] < gone["_until"]), "left_anti")
        return out.drop("_part")

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"p-{uuid.uuid4().hex}"
        if name == "gone":
            df.select("doc_id").distinct().write.parquet(f"{self.path}/gone/{part}")
            return part
        columns = self.spark.createDataFrame([], TABLES[name])
        out = columns.unionByName(df, allowMissingColumns=True).select(columns.columns)
        if name == "vectors":  # the models lie side by side
            out.write.partitionBy("model_key").parquet(f"{self.path}/{name}/{part}")
        else:
            out.write.parquet(f"{self.path}/{name}/{part}")
        return part

    def commit(self, tables: dict[str, DataFrame] | None = None, add: dict[str, DataFrame | None] | None = None, gone: DataFrame | None = None, **settings) -> dict:
        """Name new parts of tables all at once.

        tables: tables as a whole. add: new rows of tables, in which the rows of the documents (doc_id) in gone are replaced.
        """
        state = self.state()
        fresh = {name: [{"rows": self._write(name, df), "gone": None, "level": 0}] for name, df in (tables or {}).items()}
        left = self._write("gone", gone) if gone is not None else None
        for name, df in (add or {}).items():
            part = {"rows": None if df is None else self._write(name, df), "gone": left, "level": 0}
            fresh[name] = self._merged(name, [*state["tables"].get(name, []), part])
        state = {"version": state["version"] + 1, "tables": state["tables"] | fresh, "settings": state["settings"] | settings}
        self._name(state)
        return state

    def _merged(self, name: str, parts: list[dict]) -> list[dict]:
        """The last parts, where there are FAN of one level, as one part of the next."""
        while len(parts) >= FAN and len({p["level"] for p in parts[-FAN:]}) == 1:
            before, last = parts[:-FAN], parts[-FAN:]
            keys = [self.spark.read.schema("doc_id string").parquet(f"{self.path}/gone/{p['gone']}") for p in last if p["gone"]] if before else []
            gone = keys[0] if keys else None
            for more in keys[1:]:
                gone = gone.unionByName(more)
            merged = {"rows": self._write(name, self._live(name, last)), "gone": None if gone is None else self._write("gone", gone), "level": last[0]["level"] + 1}
            parts = [*before, merged]
        return parts

    @contextmanager
    def staging(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes a table and reads it again; the tables go at the end."""
        folder = f"staging/{uuid.uuid4().hex}"

        def staged(df: DataFrame) -> DataFrame:
            path = f"{self.path}/{folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield staged
        finally:
            where, fs = self._file(folder)
            fs.delete(where, True)

    def outcomes(self, df: DataFrame) -> DataFrame:
        """What became of each file of a run, kept as a table of that run until it is vacuumed."""
        path = f"{self.path}/runs/r-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self, hours: float = 24) -> int:
        """Delete parts that the store no longer names and that are older than any reader or writer still at work."""
        tables = self.state()["tables"]
        named = {p[k] for parts in tables.values() for p in parts for k in ("rows", "gone") if p[k]}
        n = 0
        for name in (*TABLES, "gone", "runs", "staging"):
            where, fs = self._file(name)
            for f in fs.listStatus(where) if fs.exists(where) else ():
                if f.getPath().getName() not in named and f.getModificationTime() < (time.time() - hours * 3600) * 1000:
                    n += fs.delete(f.getPath(), True)
        return n

    def _name(self, state: dict) -> None:
        draft, fs = self._file(f"next-{uuid.uuid4().hex}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        where, _ = self._file("current.json")
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        gateway = self.spark.sparkContext._gateway
        overwrite = gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, where, overwrite)

    @property
    def model(self) -> str:
        return self.state()["settings"]["model"]

    # ------------------------------------------------------------ lifecycle

    def delete(self, ids: list[str]) -> dict:
        gone = self.spark.createDataFrame([(i,) for i in ids], "doc_id string")
        return self.commit(add=dict.fromkeys(TABLES), gone=gone)

    def wipe(self) -> dict:
        return self.commit({name: self.spark.createDataFrame([], TABLES[name]) for name in TABLES})

    def status(self) -> dict:
        docs, chunks, vectors = self.read("documents"), self.read("chunks"), self.read("vectors")
        embedded = vectors.groupBy("model_key").agg(F.count_distinct("chunk_id").alias("n"))
        return {
            "version": self.state()["version"], "model": self.model, "documents": docs.count(), "chunks": chunks.count(),
            "by_status": {r.status: r.n for r in count_by(docs, "status").collect()}, "embedded": {r.model_key: r.n for r in embedded.collect()},
            "failed": self.read("jobs").where("status = 'failed'").count(),
        }

    def missing_vectors(self, model: str) -> DataFrame:
        return self.read("chunks").join(self.read("vectors").where(F.col("model_key") == model).select("chunk_id"), "chunk_id", "left_anti")

    def embed_missing(self, factory: Callable, model: str, size: int = SLICE) -> dict:
        """Vectors of a model for chunks that have none, kept slice by slice; the models in use are left as they are."""
        return self.embed_slices(lambda: self.missing_vectors(model), factory, "vectors", size)

    def embed_slices(self, missing: Callable[[], DataFrame], factory: Callable, into: str, size: int = SLICE) -> dict:
        """Embed what is missing, and add each slice to a table; a job that is started again finds what is there."""
        from .embed import embed_column

        columns = ["chunk_id", "doc_id", "chunk_sha256", "embed_text"]
        slices = -(-missing().count() // size)
        for i in range(slices):
            own = missing().where(F.pmod(F.xxhash64("chunk_id"), F.lit(slices)) == i)
            self.commit(add={into: embed_column(own.select(*columns), factory).drop("embed_text")})
        return self.state()

    def activate(self, model: str) -> dict:
        """Make a model the one that is searched, if it has every chunk."""
        left = self.missing_vectors(model).count()
        if left:
            raise ValueError(f"{left} chunks have no vector of {model}")
        return self.commit(model=model)

    def prune(self) -> dict:
        return self.commit({"vectors": self.read("vectors").where(F.col("model_key") == self.model)})

    def reindex(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A serving copy of the active model's vectors, made anew; its size must be that of the store."""
        own = self.read("vectors").where(F.col("model_key") == self.model).join(self.read("chunks").select("chunk_id", "space", "sensitivity", "file_type"), "chunk_id")
        made = build(own)
        if made.count() != own.count():
            raise RuntimeError("the index does not hold as many points as the store")
        return made

    def stale(self, registry: guard.Registry) -> DataFrame:
        return self.read("documents").where(F.coalesce("registry_version", F.lit(-1)) < registry.version)

    # ------------------------------------------------------------ backup

    def backup(self, path: str) -> dict:
        """A copy of every table, and a manifest of their sizes."""
        counts = {}
        for name in TABLES:
            df = self.read(name)
            df.write.parquet(f"{path}/{name}")
            counts[name] = df.count()
        manifest = {"counts": counts, "settings": self.state()["settings"]}
        self.spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")
        return manifest

    def restore(self, path: str, replace: bool = False) -> dict:
        if not replace and self.read("documents").count():
            raise ValueError("the store is not empty; pass replace=True")
        manifest = json.loads(self.spark.read.text(f"{path}/manifest").first()[0])
        tables = {name: self.spark.read.schema(TABLES[name]).parquet(f"{path}/{name}") for name in TABLES}
        for name, df in tables.items():
            if df.count() != manifest["counts"][name]:
                raise ValueError(f"the backup of {name} is not whole")
        return self.commit(tables, **manifest["settings"])


def rank_window(*order: Column) -> Column:
    return F.row_number().over(Window.orderBy(*order))
