"""Grounded answers: contexts that fit, prompts, generation, citations and refusals."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, token_estimate
from .chunker import CRUMB, sentences
from .guard import Leak, Matcher

BUDGET, EXTRA = 1200, 20
PROMPT_VERSION = "qa-v1"
#: What a model says that has found nothing (fixed value).
NOT_FOUND = "Not found in the ingested material."
SYSTEM = (
    "Answer from the numbered sources alone and cite them after each statement as [n]. "
    f'If they do not hold the answer, say exactly "{NOT_FOUND}". '
    "Names like CLIENT_A or [PERSON_EMAIL] stand for real ones: keep them as they are. Be brief, in the language of the question."
)
_CITE = r"\[(\d{1,2}(?:\s*[,–-]\s*\d{1,2})*)\]"


class Generator(Protocol):
    model: str

    def generate(self, system: str, user: str): ...  # yields pieces of text


class Extractive:
    """Quotes the sentence of the sources that shares most words with the question; needs no service."""

    model = "extractive"

    def generate(self, system: str, user: str):
        body, _, question = user.rpartition("\n\nQuestion: ")
        want = set(re.findall(r"\w{4,}", question.lower()))
        best, text, number = 0, "", 0
        for part in re.split(r"\n\n(?=\[\d+\] )", body.partition("\n\n")[2]):
            m = re.match(r"\[(\d+)\][^\n]*\n", part)
            for s in sentences(part[m.end() :]) if m else ():
                shared = len(want & set(re.findall(r"\w{4,}", s.lower())))
                if shared > best:
                    best, text, number = shared, s.strip(), int(m[1])
        yield f"{text} [{number}]" if best >= 2 else NOT_FOUND


def fit_contexts(hits: DataFrame, budget: int = BUDGET, by: list[str] | None = None) -> DataFrame:
    """The best-ranked texts whose estimates fit the budget, at least one; by: columns of one answer each."""
    cost = token_estimate("text") + EXTRA
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(*(by or [F.lit(0)])).orderBy("rank")
    sums = hits.withColumn("_used", F.sum(cost).over(before)).withColumn("_n", F.row_number().over(first))
    return sums.where((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def source_label() -> Column:
    """Title and headings, neighbours that repeat left out, and the pages."""
    parts = F.concat(F.array(F.coalesce("doc_title", F.lit(""))), F.col("heading_path"))
    kept = F.filter(F.transform(parts, lambda x, i: F.when((x != "") & ((i == 0) | (x != F.get(parts, i - 1))), x)), lambda x: x.isNotNull())
    pages = F.when(F.col("page_start").isNull(), "").when(F.coalesce("page_end", "page_start") != F.col("page_start"), F.format_string(" (p. %d-%d)", "page_start", "page_end")).otherwise(F.format_string(" (p. %d)", "page_start"))
    return F.concat(F.array_join(kept, CRUMB), pages)


def prompt(question: str, contexts: list) -> str:
    """contexts: rows with label and text, best first."""
    return "Sources:\n\n" + "\n\n".join(f"[{i}] {c['label']}\n{c['text']}" for i, c in enumerate(contexts, 1)) + f"\n\nQuestion: {question}"


def cited_numbers(answer: str, n: int) -> list[int]:
    out: dict[int, None] = {}
    for m in re.finditer(_CITE, answer):
        for part in re.split(r"\s*,\s*", m[1]):
            ends = [int(x) for x in re.split(r"\s*[–-]\s*", part)]
            a, b = ends[0], ends[1] if len(ends) > 1 else ends[0]
            out |= dict.fromkeys(i for i in range(a, min(b, a + 20) + 1) if 1 <= i <= n)
    return list(out)


def citations(c: str | Column, n: str | Column | int) -> Column:
    """cited_numbers of a column, in the JVM."""
    most = F.lit(n) if isinstance(n, int) else col(n)
    lists = F.flatten(F.transform(F.regexp_extract_all(col(c), F.lit(_CITE), F.lit(1)), lambda m: F.split(m, r"\s*,\s*")))

    def span(part: Column) -> Column:
        ends = F.transform(F.split(part, r"\s*[–-]\s*"), lambda x: x.cast("int"))
        a = F.get(ends, F.lit(0))
        b = F.least(F.coalesce(F.get(ends, F.lit(1)), a), a + 20)
        return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.filter(F.flatten(F.transform(lists, span)), lambda i: (i >= 1) & (i <= most)))


def is_refusal(answer: str) -> bool:
    return re.sub('^"|"$', "", answer.strip()).startswith(NOT_FOUND[:-1])


def refused(c: str | Column) -> Column:
    return F.startswith(F.regexp_replace(F.trim(col(c)), '^"|"$', ""), F.lit(NOT_FOUND[:-1]))


class MaskingStream:
    """Masks an answer while it comes: the text so far is masked anew, and its end is held back at a word's edge
    for as long as a protected name could still be growing there."""

    SLACK = 40

    def __init__(self, matcher: Matcher, text: str = "", sent: int = 0):
        self.matcher, self.text, self.sent, self.replaced = matcher, text, sent, False

    def push(self, delta: str) -> str:
        self.text += delta
        return self._out(self.matcher.longest + self.SLACK)

    def close(self) -> str:
        return self._out(0)

    def _out(self, hold: int) -> str:
        masked = self.matcher.mask(self.text)
        self.replaced |= masked != self.text
        end = len(masked)
        if hold:
            end = masked.rfind(" ", 0, max(0, end - hold) + 1) + 1
        out = masked[self.sent : end] if end > self.sent else ""
        self.sent = max(self.sent, end)
        return out


@dataclass
class Answer:
    question: str
    answer: str
    refused: bool
    uncited: bool
    replaced: bool
    citations: list[dict]
    versions: dict
    seconds: float


def ask(hits: DataFrame, question: str, generator: Generator, matcher: Matcher, budget: int = BUDGET) -> Answer:
    """An answer from retrieved chunks; without any, the model is not asked. Nothing protected leaves."""
    began = time.monotonic()
    masked = matcher.mask(question.strip())
    sources = fit_contexts(hits, budget).withColumn("label", source_label()).orderBy("rank").collect()
    replaced, text = False, NOT_FOUND
    if sources:
        user = prompt(masked, sources)
        if matcher.leaks(user):
            raise Leak("protected entity leaked at prompt")
        stream = MaskingStream(matcher)
        text = "".join([*(stream.push(d) for d in generator.generate(SYSTEM, user)), stream.close()]).strip()
        replaced = stream.replaced
    no = is_refusal(text)
    cited = [] if no else cited_numbers(text, len(sources))
    rows = [{"n": i, "chunk_id": s["chunk_id"], "label": s["label"], "text": s["text"], "cited": i in cited} for i, s in enumerate(sources, 1)]
    return Answer(masked, text, no, not no and not cited, replaced, rows, {"prompt": PROMPT_VERSION, "model": generator.model}, time.monotonic() - began)
