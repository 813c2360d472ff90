"""Readers of file formats: bytes in, a title and blocks out. Each works on one file and keeps no state."""

from __future__ import annotations

import base64
import codecs
import io
import re
import zipfile
import zlib
from collections import Counter
from pathlib import PurePosixPath
from xml.etree import ElementTree

from .markup import Headings, block, decode_entities, html_document, tidy

VERSION = "1.0.0"
SUPPORTED = (".pdf", ".docx", ".doc", ".pptx", ".html", ".htm", ".md", ".markdown", ".txt", ".mhtml", ".mht")


class Unreadable(ValueError):
    pass


# ---------------------------------------------------------------- text


def _windows_1252(data: bytes) -> str:
    """Bytes that have no character are C1 controls, as browsers take them."""
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)


def decode(data: bytes, charset: str | None = None) -> str:
    """A byte order mark, then the charset that is declared, then UTF-8 if it is valid, then windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if charset:
        name = charset.strip().lower()
        if name in ("windows-1252", "cp1252", "iso-8859-1", "latin1", "latin-1", "ascii", "us-ascii"):
            return _windows_1252(data)
        try:
            return data.decode(name, "replace")
        except LookupError:
            pass
    try:
        return data.decode()
    except UnicodeDecodeError:
        return _windows_1252(data)


def title_of(filename: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[_+-]+", " ", re.sub(r"\.[^.]+$", "", PurePosixPath(filename.replace("\\", "/")).name))).strip()


def read_txt(data: bytes, filename: str) -> dict:
    paragraphs = re.split(r"\n{2,}", re.sub(r"\r\n?", "\n", decode(data)))
    return {"title": title_of(filename), "blocks": [block("paragraph", t, []) for p in paragraphs if (t := tidy("paragraph", p))]}


def read_html(data: bytes, filename: str) -> dict:
    declared = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", data[:4096], re.I)
    return html_document(decode(data, declared[1].decode() if declared else None), title_of(filename))


def quoted_printable(data: bytes) -> bytes:
    joined = re.sub(rb"=\r?\n", b"", data)
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), joined)


def is_mhtml(data: bytes) -> bool:
    return bool(re.search(rb"^\s*(?:MIME-Version|Message-ID|Content-Type:\s*multipart|From:|Subject:|Date:|X-[\w-]+:)", data[:600], re.I | re.M))


def read_mhtml(data: bytes, filename: str) -> dict:
    boundary = re.search(rb'boundary="?([^"\r\n;]+)"?', data, re.I)
    for part in re.split(rb"--" + re.escape(boundary[1]) + rb"(?:--)?[ \t]*\r?\n?", data)[1:] if boundary else ():
        head, gap, body = re.split(rb"(\r?\n\r?\n)", part, maxsplit=1) if re.search(rb"\r?\n\r?\n", part) else (part, b"", b"")
        if not gap or not re.search(rb"Content-Type:\s*text/html", head, re.I):
            continue
        coding = re.search(rb"Content-Transfer-Encoding:\s*([^\s;]+)", head, re.I)
        coding = coding[1].lower() if coding else b"7bit"
        raw = quoted_printable(body) if coding == b"quoted-printable" else base64.b64decode(re.sub(rb"[^A-Za-z0-9+/=]", b"", body)) if coding == b"base64" else body
        declared = re.search(rb'charset="?([^"\s;]+)"?', head, re.I) or re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", raw[:4096], re.I)
        return html_document(decode(raw, declared[1].decode() if declared else None), title_of(filename))
    raise Unreadable("no text/html part in the MHTML file")


def _inline(text: str) -> str:
    """Markdown inside a line as plain text."""
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"<((?:https?|mailto):[^>]+)>", r"\1", text)
    text = re.sub(r"</?[a-zA-Z][^>]*>", "", text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w*])[*_](?=\S)([^*_]+?)(?<=\S)[*_](?![\w*])", r"\1", text)
    return decode_entities(re.sub(r"\\([\\`*_{}\[\]()#+.!|>~-])", r"\1", re.sub(r"~~(.+?)~~", r"\1", re.sub(r"(`+)(.+?)\1", r"\2", text))))


_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(?:\[[ xX]\]\s+)?(.*)$")


def read_md(data: bytes, filename: str) -> dict:
    """GitHub's Markdown, as far as blocks go: headings, fences, lists, tables, quotes and paragraphs."""
    text = re.sub(r"\A---\r?\n[\s\S]*?\r?\n---\r?\n", "", decode(data))
    lines = text.replace("\r\n", "\n").expandtabs(4).split("\n")
    heads, out, i = Headings(), [], 0

    def add(kind: str, body: str, level: int | None = None) -> None:
        body = tidy(kind, body)
        if body:
            out.append(block(kind, body, heads.push(level, body) if level else heads.path, level))

    while i < len(lines):
        line = lines[i]
        fence = re.match(r"^ {0,3}(`{3,}|~{3,})", line)
        head = re.match(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line)
        if fence:
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", lines[j])), len(lines))
            add("code", "\n".join(lines[i + 1 : end]))
            i = end + 1
        elif head:
            add("heading", _inline(head[2] or ""), len(head[1]))
            i += 1
        elif re.match(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$", line) or not line.strip():
            i += 1
        elif _ITEM.match(line):
            rows, indents = [], []
            while i < len(lines) and (lines[i].strip() or (i + 1 < len(lines) and (_ITEM.match(lines[i + 1]) or lines[i + 1].startswith("  ")))):
                m = _ITEM.match(lines[i])
                if m:
                    n = len(m[1])
                    while indents and indents[-1] > n:
                        indents.pop()
                    if not indents or indents[-1] < n:
                        indents.append(n)
                    rows.append("  " * (len(indents) - 1) + "- " + _inline(m[2]))
                elif lines[i].strip():
                    rows[-1] += " " + _inline(lines[i].strip())
                i += 1
            add("list", "\n".join(rows))
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            rows = []
            while i < len(lines) and "|" in lines[i]:
                if not re.match(r"^\s*\|?[\s:|-]+\|?\s*$", lines[i]) or not rows:
                    cells = re.split(r"(?<!\\)\|", lines[i].strip().removeprefix("|").removesuffix("|"))
                    rows.append(" | ".join(_inline(c.strip()) for c in cells))
                i += 1
            add("table", "\n".join(rows))
        else:
            own = []
            while i < len(lines) and lines[i].strip() and not re.match(r"^ {0,3}(?:#{1,6}\s|`{3,}|~{3,})", lines[i]) and not (own and _ITEM.match(lines[i])):
                if own and re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                    add("heading", _inline(" ".join(own)), 1 if "=" in lines[i] else 2)
                    own = []
                    i += 1
                    break
                own.append(re.sub(r"^\s*>\s?", "", lines[i]).strip())
                i += 1
            add("paragraph", _inline(" ".join(own)))
    first = next((b["text"] for b in out if b["level"] == 1), "")
    return {"title": first or title_of(filename), "blocks": out}


# ---------------------------------------------------------------- office files

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable("not an Office file") from e


def _xml(files: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(files.read(name)) if name in files.namelist() else None


def _relations(files: zipfile.ZipFile, name: str) -> dict[str, tuple[str, str]]:
    folder = PurePosixPath(name).parent
    tree = _xml(files, f"{folder}/_rels/{PurePosixPath(name).name}.rels")
    out = {}
    for r in tree if tree is not None else ():
        target = r.get("Target", "")
        parts: list[str] = []
        for p in (target if target.startswith("/") else f"{folder}/{target}").split("/"):
            if p == "..":
                parts.pop()
            elif p not in ("", "."):
                parts.append(p)
        out[r.get("Id")] = ("/".join(parts), r.get("Type", "").rpartition("/")[2])
    return out


def _word_text(p) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
            out.append(" ")
    return "".join(out)


def read_docx(data: bytes, filename: str) -> dict:
    files = _zip(data)
    tree = _xml(files, "word/document.xml")
    if tree is None:
        raise Unreadable("not a Word file")
    levels: dict[str, int] = {}
    styles = _xml(files, "word/styles.xml")
    for s in styles.iter(f"{_W}style") if styles is not None else ():
        name = s.find(f"{_W}name")
        name = name.get(f"{_W}val", "").lower() if name is not None else ""
        if m := re.fullmatch(r"heading (\d)", name):
            levels[s.get(f"{_W}styleId", "")] = min(int(m[1]), 6)
        elif name == "title":
            levels[s.get(f"{_W}styleId", "")] = 1
    heads, out, rows = Headings(), [], []

    def flush() -> None:
        if rows:
            out.append(block("list", tidy("list", "\n".join(rows)), heads.path))
            rows.clear()

    body = tree.find(f"{_W}body")
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            flush()
            lines = []
            for tr in e.findall(f"{_W}tr"):
                cells = [re.sub(r"\s+", " ", " ".join(_word_text(p) for p in tc.iter(f"{_W}p"))).strip() for tc in tr.findall(f"{_W}tc")]
                if any(cells):
                    lines.append(" | ".join(cells))
            if lines:
                out.append(block("table", tidy("table", "\n".join(lines)), heads.path))
        elif e.tag == f"{_W}p":
            text = tidy("paragraph", _word_text(e))
            if not text:
                continue
            style = e.find(f"{_W}pPr/{_W}pStyle")
            style = style.get(f"{_W}val", "") if style is not None else ""
            m = re.fullmatch(r"(?i)heading(\d)", style)
            level = levels.get(style) or (min(int(m[1]), 6) if m else 1 if style.lower() == "title" else None)
            number = e.find(f"{_W}pPr/{_W}numPr")
            if level:
                flush()
                out.append(block("heading", text, heads.push(level, text), level))
            elif number is not None or style.lower().startswith("list"):
                at = number.find(f"{_W}ilvl") if number is not None else None
                rows.append("  " * int(at.get(f"{_W}val", "0") if at is not None else 0) + "- " + text)
            else:
                flush()
                out.append(block("paragraph", text, heads.path))
    flush()
    core = _xml(files, "docProps/core.xml")
    named = next((e.text for e in core.iter("{http://purl.org/dc/elements/1.1/}title") if e.text), "") if core is not None else ""
    first = next((b["text"] for b in out if b["level"] == 1), "")
    return {"title": (named or "").strip() or first or title_of(filename), "blocks": out}


def _slide_text(body) -> list[tuple[str, bool]]:
    out = []
    for p in body.iter(f"{_A}p"):
        text = re.sub(r"\s+", " ", "".join((e.text or "") if e.tag == f"{_A}t" else " " for e in p.iter() if e.tag in (f"{_A}t", f"{_A}br"))).strip()
        mark = p.find(f"{_A}pPr")
        bullet = mark is not None and any(mark.find(f"{_A}{t}") is not None for t in ("buChar", "buAutoNum"))
        if text:
            out.append(("  " * int(mark.get("lvl", "0") if mark is not None else 0) + text, bullet))
    return out


def read_pptx(data: bytes, filename: str) -> dict:
    files = _zip(data)
    deck = _xml(files, "ppt/presentation.xml")
    if deck is None:
        raise Unreadable("not a PowerPoint file")
    relations = _relations(files, "ppt/presentation.xml")
    heads, out, warnings, hidden, lost = Headings(), [], [], 0, Counter()
    for number, ref in enumerate(deck.iter(f"{_P}sldId"), 1):
        name = relations[ref.get(f"{_R}id")][0]
        slide = _xml(files, name)
        if slide is None:
            continue
        if slide.get("show") == "0":
            hidden += 1
            continue
        title, rest = "", []
        for shape in slide.iter():
            if shape.tag == f"{_P}sp":
                place = shape.find(f".//{_P}nvPr/{_P}ph")
                kind = place.get("type", "body") if place is not None else ""
                lines = _slide_text(shape)
                if kind in ("title", "ctrTitle") and not title:
                    title = " ".join(t.strip() for t, _ in lines)
                elif kind not in ("sldNum", "dt", "ftr") and lines:
                    rest.append(("list" if any(b for _, b in lines) or (kind in ("body", "") and len(lines) > 1 and place is not None) else "paragraph", lines))
            elif shape.tag == f"{_A}tbl":
                rows = [" | ".join(" ".join(t.strip() for t, _ in _slide_text(c)) for c in r.findall(f"{_A}tc")) for r in shape.findall(f"{_A}tr")]
                rest.append(("table", [(r, False) for r in rows]))
            elif shape.tag == f"{_A}graphicData":
                for word in ("chart", "diagram"):
                    lost[word] += word in shape.get("uri", "")
        title = title or f"Slide {number}"
        out.append(block("heading", title, heads.push(1, title), 1, number))
        for kind, lines in rest:
            if kind == "list":
                out.append(block("list", tidy("list", "\n".join(re.sub(r"^(\s*)", r"\1- ", t) for t, _ in lines)), heads.path, None, number))
            elif kind == "table":
                out.append(block("table", tidy("table", "\n".join(t for t, _ in lines)), heads.path, None, number))
            else:
                out += [block("paragraph", t.strip(), heads.path, None, number) for t, _ in lines]
        for target, sort in _relations(files, name).values():
            if sort == "notesSlide" and (notes := _xml(files, target)) is not None:
                said = [t.strip() for s in notes.iter(f"{_P}sp") if (ph := s.find(f".//{_P}nvPr/{_P}ph")) is not None and ph.get("type") == "body" for t, _ in _slide_text(s)]
                if said:
                    out.append(block("note", "Speaker notes: " + " ".join(said), heads.path, None, number))
    if hidden:
        warnings.append(f"{hidden} hidden slide(s) skipped")
    warnings += [f"{n} {w}(s) not read" for w, n in lost.items() if n]
    return {"title": out[0]["text"] if out else title_of(filename), "blocks": out, "warnings": warnings}


# ---------------------------------------------------------------- PDF

_BULLET = re.compile(r"^\s*(?:[•◦▪●‣⁃∙·*–-]|\(?\d{1,2}[.)]|\(?[a-z][.)])\s+")
_PAGE_NUMBER = re.compile(r"(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?", re.I)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/()<>\[\]]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]*", re.S)


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(len(token) % 2, "0")) if len(re.sub(rb"\s", b"", token[1:-1])) % 2 == 0 else b""
    else:
        names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else names.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else _windows_1252(raw)


def pdf_items(data: bytes) -> list[list[tuple[float, float, float, str]]]:
    """(x, y, size, text) of the strings of each page. Fonts are taken as Latin; object streams and encryption are not read."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+0\s+obj\b(.*?)\bendobj", data, re.S)}

    def stream(number: int) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", objects.get(number, b""), re.S)
        if not m:
            return b""
        if b"FlateDecode" in objects[number][: m.start()]:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error:
                return b""
        return m[1]

    root = next((n for n, o in objects.items() if re.search(rb"/Type\s*/Pages\b", o) and not re.search(rb"/Parent\b", o)), None)

    def pages(number: int, seen: frozenset = frozenset()) -> list[int]:
        o = objects.get(number, b"")
        if number in seen:
            return []
        kids = re.search(rb"/Kids\s*\[(.*?)\]", o, re.S)
        return [p for k in re.findall(rb"(\d+)\s+0\s+R", kids[1]) for p in pages(int(k), seen | {number})] if kids else [number]

    order = pages(root) if root is not None else [n for n, o in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", o)]
    out = []
    for page in order:
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+0\s+R)", objects.get(page, b""))
        content = b"\n".join(stream(int(n)) for n in re.findall(rb"(\d+)\s+0\s+R", refs[1])) if refs else b""
        items, stack, size, scale, lead = [], [], 0.0, 1.0, 0.0
        line, at = [0.0, 0.0], [0.0, 0.0]
        number = lambda i, stack=stack: float(stack[i]) if len(stack) >= -i and re.fullmatch(rb"[-+]?\d*\.?\d+", stack[i]) else 0.0
        for token in _TOKEN.findall(content):
            if not re.fullmatch(rb"[A-Za-z'\"*]+[0-9*]*", token):
                stack.append(token)
                continue
            if token == b"Tf":
                size = abs(number(-1))
            elif token == b"TL":
                lead = number(-1)
            elif token in (b"Td", b"TD"):
                lead = -number(-1) if token == b"TD" else lead
                line = [line[0] + number(-2) * scale, line[1] + number(-1) * scale]
                at = list(line)
            elif token == b"Tm":
                scale = abs(number(-3)) or 1.0
                line = [number(-2), number(-1)]
                at = list(line)
            elif token == b"BT":
                line, at, scale = [0.0, 0.0], [0.0, 0.0], 1.0
            elif token in (b"T*", b"'", b'"'):
                line = [line[0], line[1] - lead * scale]
                at = list(line)
            if token in (b"Tj", b"'", b'"', b"TJ"):
                first = len(stack) - 1 - stack[::-1].index(b"[") if token == b"TJ" and b"[" in stack else len(stack) - 1
                text = "".join(_pdf_string(t) if t[:1] in b"(<" else " " if token == b"TJ" and re.fullmatch(rb"-\d*\.?\d+", t) and float(t) < -200 else "" for t in stack[max(first, 0) :])
                if text:
                    items.append((at[0], at[1], size * scale, text))
                    at[0] += len(text) * size * scale * 0.5
            stack.clear()
        out.append(items)
    return out


def _lines(items: list[tuple[float, float, float, str]], page: int) -> list[dict]:
    out: list[dict] = []
    for x, y, size, text in items:
        now = out[-1] if out else None
        if now is None or abs(y - now["y"]) > max(size, now["size"]) * 0.5:
            out.append(now := {"text": "", "size": 0.0, "y": y, "end": x, "page": page})
        if now["text"] and not now["text"][-1].isspace() and not text[0].isspace() and x - now["end"] > size * 0.15:
            now["text"] += " "
        now["text"] += text
        now["end"] = x + len(text) * size * 0.5
        now["size"] = max(now["size"], size)
    return [{**n, "text": t} for n in out if (t := tidy("paragraph", n["text"]))]


def read_pdf(data: bytes, filename: str) -> dict:
    """Structure from layout: running heads and page numbers go, large short lines are headings, bullets are lists."""
    if b"%PDF-" not in data[:1024]:
        raise Unreadable("not a PDF file")
    pages = [_lines(items, n) for n, items in enumerate(pdf_items(data), 1)]
    chars = sum(len(x["text"]) for p in pages for x in p)
    if chars < 25 * max(1, len(pages)):
        return {"title": title_of(filename), "blocks": [], "pages": len(pages), "needs_ocr": True}
    key = lambda t: re.sub(r"\d+", "#", t).lower()
    seen = Counter(k for p in pages for k in {key(x["text"]) for x in p})
    chrome = {k for k, n in seen.items() if len(pages) >= 3 and n >= -(-len(pages) // 2)}
    lines = [x for p in pages for x in p if key(x["text"]) not in chrome and not _PAGE_NUMBER.fullmatch(x["text"])]
    sizes = Counter()
    for x in lines:
        sizes[round(x["size"] * 2) / 2] += len(x["text"])
    body = max(sizes, key=lambda s: (sizes[s], -s), default=0)
    large = lambda x: x["size"] >= 1.15 * body and len(x["text"]) <= 150 and not _BULLET.match(x["text"])
    order = sorted({round(x["size"] * 2) / 2 for x in lines if large(x)}, reverse=True)
    heads, out, last = Headings(), [], None
    for x in lines:
        size = round(x["size"] * 2) / 2
        gap = abs(last["y"] - x["y"]) if last and last["page"] == x["page"] else None
        near = gap is not None and gap <= 1.7 * max(x["size"], last["size"])
        if large(x):
            level = min(order.index(size) + 1, 3)
            if out and out[-1]["type"] == "heading" and out[-1]["level"] == level and near and last["kind"] == "heading":
                text = f"{out[-1]['text']} {x['text']}"
                out[-1] = block("heading", text, heads.push(level, text), level, x["page"])
            else:
                out.append(block("heading", x["text"], heads.push(level, x["text"]), level, x["page"]))
            kind = "heading"
        elif _BULLET.match(x["text"]):
            item = "- " + _BULLET.sub("", x["text"])
            if out and out[-1]["type"] == "list" and last["kind"] == "list":
                out[-1]["text"] += "\n" + item
            else:
                out.append(block("list", item, heads.path, None, x["page"]))
            kind = "list"
        else:
            kind = last["kind"] if last and last["kind"] in ("list", "paragraph") and near else "paragraph"
            if last and last["kind"] in ("list", "paragraph") and near:
                before = out[-1]["text"]
                out[-1]["text"] = before[:-1] + x["text"] if re.search(r"[a-zà-ÿ]-$", before) and x["text"][:1].islower() else f"{before} {x['text']}"
            else:
                out.append(block("paragraph", x["text"], heads.path, None, x["page"]))
        last = {**x, "kind": kind}
    first = next((b["text"] for b in out if b["level"] == 1), "")
    return {"title": first or title_of(filename), "blocks": out, "pages": len(pages)}


def extract(data: bytes, filename: str) -> dict:
    """title, blocks, file_type, warnings, pages and needs_ocr of a file, by its extension and then by its content."""
    ext = PurePosixPath(filename.lower().replace("\\", "/")).suffix
    if ext not in SUPPORTED:
        raise Unreadable(f"unsupported file type {ext or '(none)'}; supported: {', '.join(SUPPORTED)}")
    if not data:
        raise Unreadable("the file is empty")
    if ext == ".pdf":
        out = read_pdf(data, filename)
    elif ext == ".pptx":
        out = read_pptx(data, filename)
    elif ext == ".docx" or (ext == ".doc" and data[:4] == b"PK\x03\x04"):
        out = read_docx(data, filename)
    elif ext == ".doc" and not is_mhtml(data):
        if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise Unreadable("Word 97-2003 files are not supported; save them as .docx")
        if not re.match(rb"\s*(?:<!doctype html|<html|<\?xml[^>]*>\s*<html)", data[:512], re.I):
            raise Unreadable("not a Word, MHTML or HTML file")
        out = read_html(data, filename)
    elif ext in (".mhtml", ".mht", ".doc") or (ext in (".html", ".htm") and is_mhtml(data)):
        out = read_mhtml(data, filename)
    else:
        out = {".html": read_html, ".htm": read_html, ".md": read_md, ".markdown": read_md}.get(ext, read_txt)(data, filename)
    return {"warnings": [], "pages": None, "needs_ocr": False, **out, "title": out["title"] or "Imported Document", "file_type": ext[1:]}
