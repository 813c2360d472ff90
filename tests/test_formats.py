import io
import zipfile
import zlib

import pytest

from inkwell.sources import files
from inkwell.sources import formats as X
from inkwell.sources.markup import blocks_to_html

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("--", "."), body)
    return out.getvalue()


def kinds(got):
    return [(b["type"], b["text"]) for b in got["blocks"]]


def test_txt_and_charsets():
    assert kinds(X.extract("Grüße\n\nzwei\nZeilen".encode("cp1252"), "notes-cp1252.txt")) == [("paragraph", "Grüße"), ("paragraph", "zwei Zeilen")]
    assert X.decode(b"\xef\xbb\xbfa") == "a" and X.decode("é".encode("utf-16")) == "é"
    assert X.decode(b"\x81\x80") == "\x81€"


def test_html():
    page = b"""<html><head><title>No</title><style>p{}</style></head><body><nav>Menu</nav><script>var x = "<p>";</script><h1 onclick="x()">Env &amp; Co</h1><p>One<br>two</p>
    <ul><li>a<ol><li>b</li></ol></li><li>c</li></ul><table><tr><th>K</th><th>V</th></tr><tr><td>x</td><td><table><tr><td>in</td><td>ner</td></tr></table></td></tr></table><h2>Sub</h2><pre>  code\n  here</pre></body></html>"""
    got = X.extract(page, "a.html")
    assert got["title"] == "Env & Co"
    assert kinds(got) == [("heading", "Env & Co"), ("paragraph", "One"), ("paragraph", "two"), ("list", "- a\n  - b\n- c"), ("table", "K | V\nx | in ner"), ("heading", "Sub"), ("code", "  code\n  here")]
    assert got["blocks"][-1]["heading_path"] == ["Env & Co", "Sub"]
    assert "<pre>" in blocks_to_html(got["blocks"])


@pytest.mark.parametrize("charset", ["utf-8", "windows-1252"])
def test_mhtml(charset):
    body = "".join(f"={b:02X}" if b > 126 or b == 61 else chr(b) for b in "<html><body><h1>München Cutover</h1><p>a=b</p></body></html>".encode(charset))
    data = f'MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="XX"\r\n\r\n--XX\r\nContent-Type: text/html; charset={charset}\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n{body[:30]}=\r\n{body[30:]}\r\n--XX--\r\n'
    for name in ("a.mhtml", "a.doc", "a.html"):
        got = X.extract(data.encode("latin-1"), name)
        assert got["title"] == "München Cutover" and kinds(got)[1] == ("paragraph", "a=b")


def test_markdown():
    text = "---\ntitle: x\n---\n# Check *list*\n\nSome **bold** [link](http://x).\n\n- a\n  - b `c`\n- [x] d\n\n| K | V |\n|---|:-:|\n| 1 | 2 |\n\n```sh\nls  -l\n```\n\nSetext\n------\n> quoted\n"
    got = X.extract(text.encode(), "checklist.md")
    assert kinds(got) == [("heading", "Check list"), ("paragraph", "Some bold link."), ("list", "- a\n  - b c\n- d"), ("table", "K | V\n1 | 2"), ("code", "ls  -l"), ("heading", "Setext"), ("paragraph", "quoted")]


def test_docx():
    p = lambda text, style="", num=None: f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{f"""<w:numPr><w:ilvl w:val="{num}"/></w:numPr>""" if num is not None else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Runbook", "Title") + p("Scope", "Heading1") + p("Straße și țară") + p("a", "", 0) + p("b", "", 1) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (["Step", "Owner"], ["Go/No-Go", "Release manager"])) + "</w:tbl>" + p("Details", "Heading2")
    data = zipped(**{"word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    got = X.extract(data, "runbook.docx")
    assert kinds(got) == [("heading", "Runbook"), ("heading", "Scope"), ("paragraph", "Straße și țară"), ("list", "- a\n  - b"), ("table", "Step | Owner\nGo/No-Go | Release manager"), ("heading", "Details")]
    assert [b["level"] for b in got["blocks"] if b["level"]] == [1, 1, 2]


def test_pptx():
    shape = lambda kind, text, extra="": f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p>{extra}<a:r><a:t>{t}</a:t></a:r></a:p>" for t in text)}</p:txBody></p:sp>'
    slide = lambda inner, show="": f"<p:sld {A}{show}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    rel = lambda *rows: f'<Relationships xmlns="x">{"".join(f"""<Relationship Id="{i}" Type="{RELS}/{t}" Target="{x}"/>""" for i, t, x in rows)}</Relationships>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml"), ("r3", "slide", "slides/slide3.xml")),
        "ppt/slides/slide1.xml": slide(shape("body", ["Second", "Points"])),
        "ppt/slides/slide2.xml": slide(shape("title", ["First"]) + shape("body", ["One thing"])),
        "ppt/slides/slide3.xml": slide(shape("title", ["Hidden"]), ' show="0"'),
        "ppt/slides/_rels/slide2.xml.rels": rel(("n", "notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/notesSlides/notesSlide1.xml": slide(shape("body", ["Say hello"])),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, body in parts.items():
            z.writestr(n, body)
    got = X.extract(out.getvalue(), "deck.pptx")
    assert kinds(got) == [("heading", "First"), ("paragraph", "One thing"), ("note", "Speaker notes: Say hello"), ("heading", "Slide 2"), ("list", "- Second\n- Points")]
    assert got["warnings"] == ["1 hidden slide(s) skipped"] and [b["page"] for b in got["blocks"]] == [1, 1, 1, 2, 2]


def pdf(pages):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>".encode()}
    for i, lines in enumerate(pages):
        content = "BT " + " ".join(f"/F1 {s} Tf 1 0 0 1 {x} {y} Tm ({t}) Tj" for s, x, y, t in lines) + " ET"
        raw = zlib.compress(content.encode("latin-1"))
        objects[3 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>".encode()
        objects[4 + 2 * i] = f"<< /Length {len(raw)} /Filter /FlateDecode >>\nstream\n".encode() + raw + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())


def test_pdf():
    foot = lambda n: [(8, 50, 20, f"Confidential draft {n}"), (8, 300, 20, "")]
    first = [(20, 50, 800, "Release Runbook"), (11, 50, 760, "The cutover starts at nine and all the teams con-"), (11, 50, 746, "firm their steps in order."), (11, 50, 716, "\x95 first item"), (11, 50, 702, "\x95 second item"), *foot(1)]
    second = [(15, 50, 800, "Rollback"), (11, 50, 760, "The rollback is decided by the manager at noon."), *foot(2), (11, 300, 5, "2")]
    third = [(13, 50, 800, "Contacts"), (11, 50, 760, "Call the operations desk before any change."), *foot(3)]
    got = X.extract(pdf([first, second, third]), "runbook.pdf")
    assert kinds(got) == [
        ("heading", "Release Runbook"), ("paragraph", "The cutover starts at nine and all the teams confirm their steps in order."), ("list", "- first item\n- second item"),
        ("heading", "Rollback"), ("paragraph", "The rollback is decided by the manager at noon."), ("heading", "Contacts"), ("paragraph", "Call the operations desk before any change.")]
    assert [(b["level"], b["page"]) for b in got["blocks"] if b["level"]] == [(1, 1), (2, 2), (3, 3)]
    assert X.extract(pdf([[], []]), "scanned.pdf")["needs_ocr"]


@pytest.mark.parametrize("name,data", [("a.exe", b"x"), ("a.txt", b""), ("a.pdf", b"nope"), ("a.pptx", b"nope"), ("a.doc", b"plain"), ("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1x"), ("a.docx", b"PK")])
def test_what_cannot_be_read(name, data):
    with pytest.raises(X.Unreadable):
        X.extract(data, name)


def test_scan(spark, tmp_path):
    for name in ("a b.txt", "sub/c.md", ".hidden.txt", "~$lock.docx", "node_modules/x.md", "z.exe", "bad.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"# Text")
    rows = {r.source_key.partition("/")[2]: r for r in files.extracted(files.scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a b.txt", "sub/c.md", "bad.pdf"}
    assert rows["sub/c.md"].title == "Text" and rows["bad.pdf"].error and rows["a b.txt"].blocks[0].text == "# Text"
    assert files.safe_key("a\\..\\.\\b//c") == "a/b/c"
    with pytest.raises(PermissionError):
        files.inside("/data", "../etc")
