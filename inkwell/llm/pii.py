"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, scheme separators and words that
announce a secret or an account. A deterministic parser for each kind of anchor expands it to the bounds of an
address, number or value and validates it. Spans are in code points, the end excluded, and do not overlap within a
kind; every parser starts where the last of its kind ended, so a text is read in time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import beside, pieces_of, rejoined, ship

#: Order of the kinds in results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "url")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_VALUE = re.compile(r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})")
_IBAN = re.compile(r"[ \t:=#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>@:]+:[^\s/?#\"'<>@]+@[^\s\"'<>@]+")
_CUES = ("password", "passwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "account", "acct")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    for c in ("@", "+", "://"):
        found.add_word(c, (c, len(c)))
    for kind, words in (("secret", _CUES), ("iban", ("iban",))):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _plain(span: str) -> str:
    return span.replace(" ", "").replace("-", "")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, width) in _ANCHORS.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= done["ip"]:
                chain = _DOTTED.match(text, at)
                done["ip"] = chain.end()
                parts = chain.group().split(".")
                for i in range(0, len(parts) - 3, 4):
                    start = at + sum(map(len, parts[:i])) + i
                    four = parts[i : i + 4]
                    if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in four):
                        out["ip"].append((start, start + sum(map(len, four)) + 3))
            if at >= done["card"]:
                run = _DIGITS.match(text, at)
                done["card"] = run.end() if run else last + 1
                if run and run.end() - at < 64 and 16 <= len(digits := _plain(run.group())) <= 19 and luhn(digits):
                    out["card"].append(run.span())
        elif kind == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            domain = start < at and _DOMAIN.match(text, at + 1)
            if domain:
                out["email"].append((start, domain.end()))
                done["email"] = domain.end()
        elif kind == "+":
            number = at >= done["phone"] and _PHONE.match(text, at)
            if number:
                done["phone"] = number.end()
                if 8 <= sum(map(str.isdigit, number.group())) <= 15:
                    out["phone"].append(number.span())
        elif kind == "secret":
            value = at >= done["secret"] and _VALUE.match(text, last + 1)
            if value and any(c.isdigit() for c in value[1]):
                out["secret"].append(value.span(1))
                done["secret"] = value.end()
        elif kind == "iban":
            value = at >= done["iban"] and _IBAN.match(text, last + 1)
            if value and _iban(value[1].replace(" ", "")):
                out["iban"].append(value.span(1))
                done["iban"] = value.end()
        elif kind == "://":
            start = at
            while start > done["url"] and text[start - 1] in _SCHEME:
                start -= 1
            address = start < at and _AUTHORITY.match(text, last + 1)
            if address:
                out["url"].append((start, address.end()))
                done["url"] = address.end()
    return [(k, *s) for k in KINDS for s in out[k]]


def _iban(code: str) -> bool:
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each run of spans that overlap, as [KIND] of the first of them."""
    parts, end, upto = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= upto:
            parts += [text[end:a], f"[{kind.upper()}]"]
        upto = end = max(upto, b)
    return "".join([*parts, text[end:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(mask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            spans = [find_spans(t) if t else [] for t in texts]
            rest = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            if mask:
                yield pa.record_batch(rest | {"text": pa.array([masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())})
            else:
                yield pa.record_batch(rest | {"spans": pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], _SPANS)})

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>, one row for each row of docs; null and empty texts have none.

    Null ids, repeated rows and other columns are allowed; the latter are not returned. Texts of any length are read
    whole. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(False), f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets; columns and rows stay, n_chars follows the text."""
    ship(docs.sparkSession)
    rows = beside(docs)
    out = rows.mapInArrow(_scan(True), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNull() | F.col("row.n_chars").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    return rejoined(out, docs.columns, **new)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
