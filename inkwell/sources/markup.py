"""HTML: native cleaning, and a walker that turns markup into blocks."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_rows
from ..functions.text import col, squash
from ..operators.chunker import BLOCK

# The named references that are decoded.
ENTITIES = dict(
    amp="&", lt="<", gt=">", quot='"', apos="'", nbsp=" ", ndash="–", mdash="—", lsquo="‘", rsquo="’", ldquo="“", rdquo="”", hellip="…",
    bull="•", middot="·", euro="€", copy="©", reg="®", trade="™", deg="°", laquo="«", raquo="»", times="×", rarr="→", larr="←", shy="",
)
_REFERENCE = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);")


def decode_entities(text: str) -> str:
    """Numeric references and the named ones of ENTITIES; others stay as they are."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return ENTITIES.get(name.lower(), m[0])
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _REFERENCE.sub(one, text)


def html_title(c: str | Column) -> Column:
    """Text of the first h1."""
    return squash(F.regexp_replace(F.regexp_extract(col(c), r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))


def sanitise(c: str | Column) -> Column:
    """The body without head, script, style and nav, frame divs, event handlers, script links and outside sources."""
    t = F.regexp_extract(col(c), r"(?is)<body[^>]*>(.*?)(?:</body\s*>|$)", 1)
    t = F.when(t == "", col(c)).otherwise(t)
    for tag in ("head", "script", "style", "nav"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, r"(?is)<div\b[^>]*\b(?:id|class)\s*=\s*[\"'][^\"']*(?:breadcrumb|sidebar|footer|header|nav|menu)[^\"']*[\"'][^>]*>.*?</div\s*>", "")
    t = F.regexp_replace(t, r"(?is)\s+on[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    t = F.regexp_replace(t, r"(?is)\bhref\s*=\s*([\"'])\s*javascript:[^\"']*\1", "href=\"#\"")
    t = F.regexp_replace(t, r"(?is)\s+src\s*=\s*([\"'])(?!data:)[^\"']*\1", "")
    return F.regexp_replace(t, r"(?is)</?(?:link|meta)\b[^>]*>", "")


_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_SKIP = frozenset("script style head template svg nav noscript".split())
_BREAK = frozenset("p div br section article header footer main aside blockquote tr td th ul ol li table h1 h2 h3 h4 h5 h6 pre hr dl dt dd form figure figcaption".split())
_SPACE = re.compile(r"[\s\xa0]+")


def tidy(kind: str, text: str) -> str:
    if kind in ("code", "table", "list"):
        return "\n".join(line.rstrip() for line in text.split("\n") if line.strip())
    return _SPACE.sub(" ", text).strip()


class Headings:
    """The chain of open headings."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []

    def push(self, level: int, text: str) -> list[str]:
        self.open = [*[h for h in self.open if h[0] < level], (level, text)]
        return self.path

    @property
    def path(self) -> list[str]:
        return [t for _, t in self.open]


def block(kind: str, text: str, path: list[str], level: int | None = None, page: int | None = None) -> dict:
    return {"type": kind, "text": text, "level": level, "heading_path": list(path), "page": page}


class Walker:
    """Blocks of markup, in one pass over its tags: headings, paragraphs, lists, tables and code."""

    def __init__(self, page: int | None = None):
        self.out: list[dict] = []
        self.heads, self.page = Headings(), page
        self.text, self.lines = "", []  # of the paragraph, and of the list
        self.skip: list[str] = []
        self.depth = self.level = 0
        self.code: str | None = None
        self.tables: list[dict] = []

    def add(self, kind: str, text: str, level: int | None = None) -> None:
        text = tidy(kind, text)
        if text:
            path = self.heads.push(level, text) if level else self.heads.path
            self.out.append(block(kind, text, path, level, self.page))

    def flush(self) -> None:
        text, self.text = self.text, ""
        if self.tables:
            self.tables[-1]["cell"] += " " + text
        elif self.depth:
            line = _SPACE.sub(" ", text).strip()
            if line:
                self.lines.append("  " * (self.depth - 1) + "- " + line)
        elif self.level:
            self.text = text + " "
        else:
            self.add("paragraph", text)

    def tag(self, name: str, closing: bool) -> None:
        if self.code is not None:
            if name == "pre" and closing:
                self.add("code", self.code)
                self.code = None
            elif name == "br":
                self.code += "\n"
            return
        if name in _BREAK:
            self.flush()
        if name == "pre" and not closing and not self.tables:
            self.code = ""
        elif name in ("ul", "ol") and not self.tables:
            self.depth = max(0, self.depth + (-1 if closing else 1))
            if not self.depth:
                lines, self.lines = self.lines, []
                self.add("list", "\n".join(lines))
        elif re.fullmatch("h[1-6]", name) and not self.tables and not self.depth:
            if closing and self.level:
                text, self.text, level, self.level = self.text, "", self.level, 0
                self.add("heading", text, level)
            elif not closing:
                self.text, self.level = "", int(name[1])
        elif name == "table":
            if not closing:
                self.tables.append({"rows": [], "row": [], "cell": ""})
            elif self.tables:
                done = self.tables.pop()
                self._row(done)
                if self.tables:  # a table in a cell is the cell's text
                    self.tables[-1]["cell"] += " " + " ".join(" ".join(r) for r in done["rows"])
                else:
                    self.add("table", "\n".join(" | ".join(r) for r in done["rows"]))
        elif self.tables and name in ("td", "th", "tr"):
            now = self.tables[-1]
            if name == "tr":
                self._row(now)
            elif closing:
                self._cell(now)
            else:
                now["cell"] = ""

    @staticmethod
    def _cell(t: dict) -> None:
        t["row"].append(_SPACE.sub(" ", t["cell"]).strip())
        t["cell"] = ""

    def _row(self, t: dict) -> None:
        if t["cell"].strip():
            self._cell(t)
        if any(t["row"]):
            t["rows"].append(t["row"])
        t["row"], t["cell"] = [], ""

    def feed(self, markup: str) -> list[dict]:
        at = 0
        for m in [*_TAG.finditer(markup), None]:
            raw = markup[at : m.start() if m else len(markup)]
            if raw and not self.skip:
                text = decode_entities(raw)
                if self.code is not None:
                    self.code += text
                else:
                    self.text += text
            if m is None:
                break
            at = m.end()
            name, closing = (m[2] or "").lower(), bool(m[1])
            if not name:
                continue
            if name in _SKIP:
                if closing and name in self.skip:
                    while self.skip.pop() != name:
                        pass
                elif not closing and not m[3].rstrip().endswith("/"):
                    self.skip.append(name)
            elif not self.skip:
                self.tag(name, closing)
        self.flush()
        if self.depth:
            self.add("list", "\n".join(self.lines))
        if self.level and self.text.strip():
            self.add("heading", self.text, self.level)
        return self.out


def body_of(markup: str) -> str:
    m = re.search(r"<body[^>]*>(.*?)(?:</body\s*>|\Z)", markup, re.S | re.I)
    inner = m[1] if m else markup
    for pattern in (r"<(head|script|style|nav)\b[^>]*>.*?</\1\s*>", r"<div\b[^>]*\b(?:id|class)\s*=\s*[\"'][^\"']*(?:breadcrumb|sidebar|footer|header|nav|menu)[^\"']*[\"'][^>]*>.*?</div\s*>"):
        inner = re.sub(pattern, "", inner, flags=re.S | re.I)
    return inner


def html_document(markup: str, filename: str = "") -> dict:
    """title (h1, else title element, else filename) and blocks of a page."""
    blocks = Walker().feed(body_of(markup))
    first = next((b["text"] for b in blocks if b["type"] == "heading" and b["level"] == 1), "")
    named = re.search(r"<title[^>]*>(.*?)</title>", markup, re.S | re.I)
    return {"title": first or (_SPACE.sub(" ", decode_entities(named[1])).strip() if named else "") or filename, "blocks": blocks}


def blocks_to_html(blocks: list[dict]) -> str:
    out = []
    for b in blocks:
        text = _html.escape(b["text"], quote=False)
        if b["type"] == "heading":
            n = min(max(b["level"] or 1, 1), 6)
            out.append(f"<h{n}>{text}</h{n}>")
        elif b["type"] == "list":
            out.append("<ul>" + "".join(f"<li>{x.strip().removeprefix('- ')}</li>" for x in text.split("\n")) + "</ul>")
        elif b["type"] == "table":
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r.split(" | ")) + "</tr>" for r in text.split("\n")) + "</table>")
        else:
            tag = {"code": "pre", "note": "blockquote"}.get(b["type"], "p")
            out.append(f"<{tag}>{text}</{tag}>")
    return "\n".join(out)


def html_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, title, blocks of pages (doc_id, html), on Arrow batches: the walker keeps state from tag to tag."""

    def read(rows: list[dict]) -> list[dict]:
        return [html_document(r["html"] or "") for r in rows]

    return map_rows(pages, ["html"], read, f"title string, blocks array<{BLOCK}>", ["doc_id"])
