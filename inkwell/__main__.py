"""Command line: python -m inkwell COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import answer, embed, guard, retrieve
from .operators.ingest import ingest, remask
from .operators.store import Store
from .sources.files import scan


def registry_of(path: str) -> guard.Registry:
    out = guard.Registry()
    if Path(path).exists():
        for e in json.loads(Path(path).read_text()):
            out.add(e["canonical"], e.get("type", "org"), tuple(e.get("aliases", ())))
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkwell", description=__doc__)
    p.add_argument("--home", default="inkwell-home", help="folder of the store")
    p.add_argument("--registry", default="registry.json", help="JSON list of {canonical, type, aliases}")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *rest in (
        ("ingest", "path"), ("status",), ("mask", "text"), ("scan", "path"), ("search", "question"), ("ask", "question"), ("delete", "doc_id"), ("remask",),
        ("reembed", "model"), ("activate", "model"), ("prune",), ("backup", "path"), ("restore", "path"), ("wipe",), ("doctor",),
    ):
        one = sub.add_parser(name)
        for r in rest:
            one.add_argument(r)
        if name == "ingest":
            one.add_argument("--space", default="release")
            one.add_argument("--sensitivity", default="Internal")
            one.add_argument("--force", action="store_true")
        if name == "restore":
            one.add_argument("--replace", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    store, registry = Store(spark, a.home), registry_of(a.registry)
    matcher, key = registry.matcher(), b"inkwell"
    factory = lambda: embed.get(store.model)
    if a.command == "ingest":
        ingest(store, scan(spark, a.path), registry, key, embed.HashedWords, a.space, a.sensitivity, force=a.force).groupBy("outcome").count().show()
    elif a.command == "mask":
        print(matcher.mask(a.text))
    elif a.command == "scan":
        found = guard.leaking(spark.read.option("recursiveFileLookup", True).text(a.path, wholetext=True).withColumn("path", F.input_file_name()), matcher, "value")
        found.select("path").show(1000, False)
        return int(not found.isEmpty())
    elif a.command in ("search", "ask"):
        hits = retrieve.retrieve(store.read("chunks"), store.read("vectors").where(F.col("model_key") == store.model), store.read("documents"), a.question, factory(), matcher)
        if a.command == "search":
            hits.select("rank", "score", "doc_title", F.substring("text", 1, 100).alias("text")).show(20, False)
        else:
            print(answer.ask(hits, a.question, answer.Extractive(), matcher).answer)
    elif a.command in ("status", "doctor"):
        state = store.status()
        print(json.dumps(state, indent=1))
        if a.command == "doctor":
            whole = state["embedded"].get(state["model"], 0) == state["chunks"]
            print("registry:", f"{len(registry.active())} names" if registry.active() else "EMPTY", "| vectors:", "complete" if whole else "MISSING")
            return int(not registry.active() or not whole)
    elif a.command == "delete":
        store.delete([a.doc_id])
    elif a.command == "remask":
        print(remask(store, registry, key, embed.HashedWords))
    elif a.command == "reembed":
        store.embed_missing(lambda: embed.get(a.model), a.model)
    elif a.command == "activate":
        store.activate(a.model)
    elif a.command == "prune":
        store.prune()
    elif a.command == "backup":
        print(json.dumps(store.backup(a.path)))
    elif a.command == "restore":
        store.restore(a.path, a.replace)
    elif a.command == "wipe":
        store.wipe()
    return 0


if __name__ == "__main__":
    sys.exit(main())
