"""Heading-aware chunks of documents.

Packing is greedy and what a chunk carries over depends on what the one before emitted, so each document is cut by one
Python function; documents are independent, so a table of them is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from dataclasses import replace as changed

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..functions.ids import chunk_id, chunker_config
from ..functions.text import CHARS_PER_TOKEN, PROSE_CHARS, estimate

VERSION = "1.0.0"
TARGET, OVERLAP, MERGE = 450, 0.15, 0
CRUMB = " › "
BLOCK = "struct<type: string, text: string, level: int, heading_path: array<string>, page: int>"
CHUNK = "chunk_index int, heading_path array<string>, text string, embed_text string, page_start int, page_end int, block_types array<string>, token_estimate int, overlap_tokens int, chunk_sha256 string"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_OPENING = "\"„(["


def sentences(text: str) -> list[str]:
    """Cuts after . ! ? … and white space where a capital or a digit follows, an opening sign before it allowed."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        rest = text[m.end() : m.end() + 2]
        first = rest[1:2] if rest[:1] in _OPENING and rest else rest[:1]
        if first.isupper() or first.isdecimal() or rest[:1].isupper():
            out.append(text[at : m.start()])
            at = m.end()
    return [*out, text[at:]]


@dataclass(frozen=True)
class Unit:
    kind: str
    text: str
    page: int | None
    tokens: int
    carried: bool = False


def _words(text: str, kind: str, target: int) -> list[str]:
    """Pieces of whole words; a word that is too long is cut, none of it is lost."""
    most = max(1, int(target * CHARS_PER_TOKEN.get(kind, PROSE_CHARS)))
    out, now = [], ""
    for part in re.split(r"(\s+)", text):
        for w in [part[i : i + most] for i in range(0, len(part), most)]:
            if len(now) + len(w) > most and now.strip():
                out.append(now.strip())
                now = ""
            now += w
    return [*out, now.strip()] if now.strip() else out


def _packed(parts: list[str], glue: str, kind: str, target: int, head: str | None = None) -> list[str]:
    start = [head] if head is not None else []
    out, now = [], list(start)
    fits = lambda some: estimate(glue.join(some), kind) <= target
    for p in parts:
        if not fits([*now, p]) and len(now) > len(start):
            out.append(glue.join(now))
            now = list(start)
        if fits([*now, p]):
            now.append(p)
        else:
            out += [glue.join([*start, piece]) for piece in _words(p, kind, target - (estimate(head, kind) if head else 0))]
    return [*out, glue.join(now)] if len(now) > len(start) else out


def _units(block: dict, target: int) -> list[Unit]:
    kind, text = block["type"], block["text"]
    if estimate(text, kind) <= target:
        pieces = [text]
    elif kind == "table":
        head, *rows = text.split("\n")
        pieces = _packed(rows, "\n", kind, target, head)
    elif kind in ("list", "code"):
        pieces = _packed(text.split("\n"), "\n", kind, target)
    else:
        pieces = _packed(sentences(text), " ", kind, target)
    return [Unit(kind, p, block["page"], estimate(p, kind)) for p in pieces]


def _tail(units: list[Unit], budget: int) -> list[Unit]:
    """What the next chunk repeats: whole units from the end, else the last sentences; never tables."""
    out: list[Unit] = []
    used = 0
    for u in reversed(units):
        if u.kind == "table":
            break
        if used + u.tokens > budget:
            if not out:
                picked: list[str] = []
                for s in reversed(sentences(u.text)[1:]):
                    if estimate(" ".join([s, *picked]), u.kind) > budget:
                        break
                    picked.insert(0, s)
                if picked:
                    text = " ".join(picked)
                    out.append(changed(u, text=text, tokens=estimate(text, u.kind), carried=True))
            break
        out.insert(0, changed(u, carried=True))
        used += u.tokens
    return out


def _crumbs(title: str, path: list[str]) -> str:
    parts = [title, *path]
    return CRUMB.join(p for i, p in enumerate(parts) if p and (i == 0 or p != parts[i - 1]))


def _chunk(title: str, path: list[str], text: str, pages: list[int], kinds: list[str], tokens: int, overlap: int) -> dict:
    prefix = _crumbs(title, path)
    embed = f"{prefix}\n\n{text}" if prefix else text
    return {
        "heading_path": path, "text": text, "embed_text": embed, "page_start": min(pages, default=None), "page_end": max(pages, default=None),
        "block_types": list(dict.fromkeys(kinds)), "token_estimate": estimate(prefix) + tokens, "overlap_tokens": overlap, "chunk_sha256": hashlib.sha256(embed.encode()).hexdigest(),
    }


def chunk_blocks(blocks: list[dict], title: str = "", target: int = TARGET, overlap: float = OVERLAP, merge: int = MERGE) -> list[dict]:
    """Chunks of a document's blocks (type, text, heading_path, page), which never span sections unless merged."""
    sections: list[tuple[list[str], list[dict]]] = []
    for b in blocks:
        path = list(b["heading_path"] if b["heading_path"] is not None else [])
        if b["type"] == "heading" or not sections or sections[-1][0] != path:
            sections.append((path, []))
        if b["type"] != "heading":
            sections[-1][1].append(b)
    spare = int(target * overlap)
    out = []
    for path, own in sections:
        budget = max(target - estimate(_crumbs(title, path)), -(-target // 2))
        now: list[Unit] = []

        def emit(now: list[Unit], path: list[str] = path) -> None:
            if not all(u.carried for u in now):
                out.append(_chunk(title, path, "\n\n".join(u.text for u in now), [u.page for u in now if u.page is not None], [u.kind for u in now if not u.carried], sum(u.tokens for u in now), sum(u.tokens for u in now if u.carried)))

        for u in (u for b in own for u in _units(b, budget if b["type"] == "table" else budget - spare)):
            if now and sum(x.tokens for x in now) + u.tokens > budget:
                emit(now)
                now = _tail(now, spare)
                if sum(x.tokens for x in now) + u.tokens > budget:
                    now = []
            now.append(u)
        emit(now)
    if merge > 0:
        out = _merged(out, title, target, merge)
    return [{"chunk_index": i, **c} for i, c in enumerate(out)]


def _merged(chunks: list[dict], title: str, target: int, least: int) -> list[dict]:
    """Small chunks under a shared heading joined; headings that the breadcrumb loses stand before their parts."""

    def join(path: list[str], parts: list[dict]) -> dict:
        own = [CRUMB.join(p["heading_path"][len(path) :]) for p in parts]
        text = "\n\n".join(f"{o}\n{p['text']}" if o else p["text"] for o, p in zip(own, parts, strict=True))
        kinds = [k for p in parts for k in p["block_types"]]
        body = lambda p: estimate(p["text"], next((k for k in ("table", "code") if k in p["block_types"]), "paragraph"))
        pages = [x for p in parts for x in (p["page_start"], p["page_end"]) if x is not None]
        return _chunk(title, path, text, pages, kinds, sum(body(p) + estimate(o) for o, p in zip(own, parts, strict=True)), sum(p["overlap_tokens"] for p in parts))

    out: list[dict] = []
    path: list[str] = []
    parts: list[dict] = []
    for c in chunks:
        if parts:
            n = next((i for i, (a, b) in enumerate(zip(path, c["heading_path"], strict=False)) if a != b), min(len(path), len(c["heading_path"])))
            if n and join(path, parts)["token_estimate"] < least and join(path[:n], [*parts, c])["token_estimate"] <= target:
                path, parts = path[:n], [*parts, c]
                continue
            out.append(join(path, parts))
        path, parts = c["heading_path"], [c]
    return [*out, join(path, parts)] if parts else out


def chunk_documents(docs: DataFrame, target: int = TARGET, overlap: float = OVERLAP, merge: int = MERGE) -> DataFrame:
    """Chunks of docs (doc_id, title, blocks array<BLOCK>), with ids, the chunker's version and its settings."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(rows: list[dict]) -> list[dict]:
        return [{"doc_id": r["doc_id"], **c} for r in rows for c in chunk_blocks(r["blocks"] or [], r["title"] or "", target, overlap, merge)]

    out = map_rows(docs, ["doc_id", "title", "blocks"], cut, f"doc_id {kind}, {CHUNK}")
    return out.select(chunk_id(F.col("doc_id").cast("string"), "chunk_index", "chunk_sha256").alias("chunk_id"), "*", F.lit(VERSION).alias("chunker_version"), F.lit(chunker_config(VERSION, target, overlap, merge)).alias("chunker_config"))


def text_blocks(c: str = "text"):
    """Paragraphs of plain text, divided by empty lines, as blocks; in the JVM."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), r"\n[ \t]*\n\s*"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    empty = F.array().cast("array<string>")
    return F.transform(parts, lambda p: F.struct(F.lit("paragraph").alias("type"), p.alias("text"), F.lit(None).cast("int").alias("level"), empty.alias("heading_path"), F.lit(None).cast("int").alias("page")))
