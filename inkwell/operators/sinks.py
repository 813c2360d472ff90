"""What leaves, and what is kept of it: masked exports, imported pages, audit events and evaluation results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import escape_html
from ..sources.files import extracted
from ..sources.markup import blocks_to_html
from . import guard, wiki


class Closed(PermissionError):
    pass


def masked_html(pages: DataFrame, matcher: guard.Matcher) -> DataFrame:
    """id, html of pages as whole documents, masked and checked; Restricted pages are refused."""
    if not pages.where("sensitivity = 'Restricted'").isEmpty():
        raise Closed("Restricted pages cannot be exported")
    masked = pages.select("id", guard.mask("title", matcher).alias("title"), guard.mask(F.coalesce("body_html", F.lit("")), matcher).alias("body"))
    guard.assert_clean(masked, matcher, "title", "body", where="export")
    page = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escape_html("title"), F.lit("</title></head><body><h1>"), escape_html("title"), F.lit("</h1>"), F.col("body"), F.lit("</body></html>"))
    return masked.select("id", page.alias("html"))


def export_html(pages: DataFrame, matcher: guard.Matcher, path: str) -> None:
    """One text file a partition, each line a page with its newlines as references."""
    masked_html(pages, matcher).select(F.regexp_replace("html", "\r?\n", "&#10;")).write.text(path)


@F.pandas_udf(StringType())
def _html(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: blocks_to_html([] if b is None else list(b)))


def import_pages(pages: DataFrame, files: DataFrame, space: str, at: str) -> DataFrame:
    """pages with a new page for each file (filename, content) that can be read."""
    read = extracted(files).where("error is null")
    rows = read.select(F.lit(space).alias("space"), "title", _html("blocks").alias("body_html"), F.lit("source-capture").alias("type"))
    return wiki.create(pages, rows, at)


def audit(events: DataFrame, action: str, detail: str | Column, at: str) -> DataFrame:
    """events (ts, action, detail) with one more; details never hold a protected name, so pass what is masked."""
    one = events.sparkSession.range(1).select(F.lit(at).alias("ts"), F.lit(action).alias("action"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    return events.unionByName(one, allowMissingColumns=True)


def tail(events: DataFrame, limit: int = 200) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("action")).limit(limit)


def write_results(summary: DataFrame, results: DataFrame, path: str) -> None:
    """A run of the evaluation as JSON lines, its summary beside it."""
    results.write.json(f"{path}/results")
    summary.coalesce(1).write.json(f"{path}/summary")
