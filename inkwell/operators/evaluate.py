"""Offline evaluation over golden questions: deterministic metrics, as aggregates over DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import floor_percentile, round3

GOLDEN = "id string, question string, type string, expect array<struct<doc: string, section: string, page: int>>, must_contain array<string>"
# Words that carry no content (English, German, Romanian).
STOP_WORDS = frozenset(
    (
        "a an the and or but of to in on at for by with from as is are was were be been being this that these those it its "
        "into than then there their they them which who whom whose what when where why how can could should would may might must will shall "
        "also not no yes any all each every some such only very more most other same both either neither our your his her has have had do does did "
        "der die das und oder ist sind ein eine einer mit von zu im den dem des auf für nicht si sau este sunt cu de la in pe un o"
    ).split()
)


def load_golden(spark: SparkSession, *paths: str) -> DataFrame:
    """Items of JSON lines; blank lines and // comments are skipped, a bad line is an error that names it."""
    lines = spark.read.text(list(paths)).withColumn("line", F.trim("value")).where((F.col("line") != "") & ~F.startswith("line", F.lit("//")))
    items = lines.select(F.input_file_name().alias("file"), "line", F.from_json("line", GOLDEN + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("g"))
    bad = items.where(F.col("g._bad").isNotNull() | F.col("g.id").isNull()).first()
    if bad:
        raise ValueError(f"{bad.file}: not a golden item: {bad.line[:80]}")
    return items.select("file", "g.*").drop("_bad").withColumn("type", F.coalesce("type", F.lit("answer")))


def relevant(expect: Column, filename: Column, title: Column, heading_path: Column, text: Column, page_start: Column, page_end: Column) -> Column:
    """Some expectation names the document, and the section and the page if it has them."""
    name = F.lower(F.concat_ws(" ", F.coalesce(filename, F.lit("")), F.coalesce(title, F.lit(""))))
    crumb, body = F.lower(F.array_join(heading_path, " > ")), F.lower(F.coalesce(text, F.lit("")))
    last = F.coalesce(page_end, page_start)

    def one(e: Column) -> Column:
        section = F.lower(F.coalesce(e["section"], F.lit("")))
        place = (section == "") | crumb.contains(section) | body.contains(section)
        page = e["page"].isNull() | F.coalesce((e["page"] >= page_start) & (e["page"] <= last), F.lit(False))
        return name.contains(F.lower(F.coalesce(e["doc"], F.lit("")))) & place & page

    return F.exists(F.coalesce(expect, F.array().cast("array<struct<doc: string, section: string, page: int>>")), one)


def retrieval_metrics(hits: DataFrame, items: DataFrame) -> DataFrame:
    """recall_at_5, recall_at_10 and mrr_at_10 of answerable items; hits: id, rank, relevant."""
    first = hits.where("relevant and rank <= 10").groupBy("id").agg(F.min("rank").alias("first"))
    rows = items.where("type = 'answer'").join(first, "id", "left")
    rate = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return rows.agg(F.count(F.lit(1)).alias("answerable"), round3(rate(5)).alias("recall_at_5"), round3(rate(10)).alias("recall_at_10"), round3(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr_at_10"))


def content_words(text: str) -> list[str]:
    return [w for w in re.findall(r"(?:[^\W_]|[_+-]){3,}", text.lower()) if w not in STOP_WORDS]


def groundedness(answer: str, sources: dict[int, str]) -> tuple[int, int]:
    """(sentences checked, grounded): with citations and three content words, half of which are in the cited texts."""
    checked = grounded = 0
    for s in re.split(r"(?<=[.!?])\s+|\n+", answer):
        cites = [int(n) for m in re.findall(r"\[\d{1,2}(?:\s*[,–-]\s*\d{1,2})*\]", s) for n in re.findall(r"\d{1,2}", m)]
        words = content_words(re.sub(r"\[[\d,\s–-]+\]", "", s))
        if cites and len(words) >= 3:
            pool = " ".join(sources.get(n, "").lower() for n in cites)
            checked += 1
            grounded += 2 * sum(w in pool for w in words) >= len(words)
    return checked, grounded


def answer_metrics(results: DataFrame) -> DataFrame:
    """One row of rates. results: type, refused, uncited, cited, cited_relevant, must_found, must_total, checked, grounded, total_ms."""
    answer, refuse = F.col("type") == "answer", F.col("type") == "refuse"
    rate = lambda when, what: round3(F.avg(F.when(when, what.cast("double"))))
    must = answer & (F.col("must_total") > 0)
    sums = lambda a, b, when: round3(F.sum(F.when(when, F.col(a))) / F.nullif(F.sum(F.when(when, F.col(b))), F.lit(0)))
    every = F.collect_list("total_ms")
    return results.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(answer).alias("answerable"), F.count_if(refuse).alias("refuse_items"),
        rate(refuse, F.col("refused")).alias("refusal_accuracy"), rate(answer, F.col("refused")).alias("false_refusal_rate"),
        rate(must, F.col("must_found") == F.col("must_total")).alias("must_contain_all"), rate(must, F.col("must_found") / F.col("must_total")).alias("must_contain_share"),
        sums("cited_relevant", "cited", answer).alias("citation_accuracy"), sums("grounded", "checked", F.lit(True)).alias("groundedness"),
        rate(answer & ~F.col("refused"), F.col("uncited")).alias("uncited_rate"), floor_percentile(every, 0.5).alias("total_ms_p50"), floor_percentile(every, 0.95).alias("total_ms_p95"),
    )


def run_matrix(configs: dict[str, dict], run) -> dict[str, dict]:
    """run(**config) -> a one-row DataFrame, for each named configuration."""
    return {name: run(**config).first().asDict() for name, config in configs.items()}


def as_tsv(results: dict[str, dict]) -> str:
    names = list(dict.fromkeys(k for r in results.values() for k in r))
    return "\n".join(["\t".join(["config", *names]), *("\t".join([c, *(json.dumps(r.get(k)) for k in names)]) for c, r in results.items())])


def run(items: DataFrame, retrieve, ask, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, retrieval metrics, answer metrics) of golden items, which are few: one retrieval and one answer each.

    retrieve(question, k) -> hits as a DataFrame; ask(hits, question) -> an Answer.
    """
    spark = items.sparkSession
    hits, rows = None, []
    for it in items.collect():
        found = retrieve(it.question, k).persist()  # k rows, used four times
        expect = F.lit(None).cast("array<struct<doc: string, section: string, page: int>>")
        if it.expect:
            expect = F.array(*[F.struct(F.lit(e.doc).alias("doc"), F.lit(e.section).alias("section"), F.lit(e.page).cast("int").alias("page")) for e in it.expect])
        good = relevant(expect, F.col("filename"), F.col("doc_title"), F.col("heading_path"), F.col("text"), F.col("page_start"), F.col("page_end"))
        one = found.select(F.lit(it.id).alias("id"), "rank", "chunk_id", good.alias("relevant"))
        hits = one if hits is None else hits.unionByName(one)
        a = ask(found, it.question)
        right = {r.chunk_id for r in one.where("relevant").collect()}
        cited = [c for c in a.citations if c["cited"]]
        checked, grounded = groundedness(a.answer, {c["n"]: c["text"] for c in a.citations})
        must = list(it.must_contain or ())
        rows.append((it.id, it.type, a.answer, a.refused, a.uncited, len(cited), sum(c["chunk_id"] in right for c in cited), sum(m.lower() in a.answer.lower() for m in must), len(must), checked, grounded, int(a.seconds * 1000)))
    results = spark.createDataFrame(rows, "id string, type string, answer string, refused boolean, uncited boolean, cited int, cited_relevant int, must_found int, must_total int, checked int, grounded int, total_ms int")
    return results, retrieval_metrics(hits, items), answer_metrics(results)
