"""Main text of web pages by equivalence-class template deduction.

A token is a tag in its role, the path of structural elements it stands in, or the text of a block in its role. Over the
pages of a host each token has an occurrence vector, its count on every page. Tokens of equal vectors are a class;
vectors are compared by the number of pages, the total, and a sum of hashes of (page, count), all of which add up
from partial sums, so a host of any size is never gathered. Classes that are large and frequent enough are nested
into the host's template in order of their mean position. A page fits a class if it has most of the class's tokens in
that order; what lies between the tokens that fit are its slots.

The template decides the text. Its texts are the frame and go, wherever they stand; of its elements the article is the
innermost one in whose slots most of the host's varying text lies. Names of elements and classes are hints: an element
called `article` or `main` wins over its insides and its neighbours, and elements called after menus, adverts, comments
and the like are left out, but never one that holds the article. A host of one page has the page's own elements as its
template and no frame.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, ship, written

#: A class needs so many tokens, on this share of its host's pages; a page fits it with this share of its tokens.
SIZE, SUPPORT, FIT = 3, 0.5, 0.8
#: A text is the frame's if it is on this share of the host's pages, with so many pages that lack it added: two or
#: three pages that agree, near copies of each other perhaps, are no proof.
FRAME, DOUBT = 0.6, 2
#: The article has this share of the varying text; one that is called so needs less.
MOST, NAMED = 0.6, 0.2
#: Names of elements and of classes.
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|xmp"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(.*?)(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|([^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags are often left out; they separate blocks but are no part of a path.
_LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup h1 h2 h3 h4 h5 h6".split())
_BOILERPLATE = frozenset("nav footer aside form menu button select dialog head object audio video canvas".split())
_CUES = frozenset(
    "nav navbar navigation menu sidebar side footer foot ad ads adv advert adverts advertisement banner promo sponsor sponsored cookie cookies consent notice alert popup modal newsletter subscribe"
    " share sharing social related recommended comment comments disqus replies breadcrumb breadcrumbs pagination pager masthead toolbar widget login signup".split()
)
_NAMES = ("article", "main")


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Element:
    __slots__ = ("chars", "cue", "inline", "junk", "main", "name", "number", "parent", "role")

    def __init__(self, name: str, marks: list[str], parent: Element | None, inline: bool = False):
        self.name, self.parent, self.inline, self.chars = name, parent, inline, 0
        self.main = name in _NAMES or "main" in marks
        inside = parent is not None and parent.within()
        self.cue = name not in ("", "html", "body") and (name in _BOILERPLATE or (name == "header" and not inside) or not _CUES.isdisjoint(marks))
        self.junk = False
        self.role = (parent.role if inline else f"{parent.role}>{name}{''.join(f'.{m}' for m in marks)}") if parent else name
        self.number = _number(self.role)

    def within(self) -> bool:
        here = self
        while here is not None:
            if here.main:
                return True
            here = here.parent
        return False


def _marks(attributes: str | None) -> list[str]:
    return sorted({v.lower() for a in _ATTRIBUTE.findall(attributes) for v in "".join(a[1:]).split()}) if attributes else []


def parse(page: str) -> list[tuple[int, Element, str]]:
    """(token, element, text) in order: opened and closed elements with text '', and blocks of text, white space made one.

    Elements called after boilerplate are `junk`, and what is in them is, unless they hold an `article` or `main`, or
    over half of the text of a page that has neither.
    """
    at = root = Element("", [], None)
    elements, out, held = [root], [], []
    skip = False  # inside a loose element that is called after boilerplate

    def block() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            where = at
            while where.inline:
                where = where.parent
            out.append((_number(f"{where.role}\0{text}"), where, text))

    for m in _TOKEN.finditer(page):
        text, name = m[6], m[4]
        if text is not None:
            if not skip and not (at.inline and at.cue):
                held.append(html.unescape(text))
        elif name:
            name = name.lower()
            if name in _INLINE:
                if m[3]:
                    if at.inline and at.name == name:
                        at = at.parent
                elif m[5] and (marks := _marks(m[5])) and (not _CUES.isdisjoint(marks) or at.inline):
                    at = Element(name, marks, at, True)
                elif at.inline and at.name == name:
                    at = Element(name, [], at, True)
                    at.cue = at.parent.cue
                continue
            block()
            skip = False
            if m[3]:
                here = at
                while here is not None and here.name != name:
                    here = here.parent
                if name not in _LOOSE and here is not None and here.parent is not None:
                    out.append((_number(f"/{here.role}"), here, ""))
                    at = here.parent
            elif name in _LOOSE:
                skip = bool(m[5]) and not _CUES.isdisjoint(_marks(m[5]))
            elif name not in _VOID:
                while at.inline:
                    at = at.parent
                at = Element(name, _marks(m[5]), at)
                elements.append(at)
                out.append((at.number, at, ""))
    block()
    for _, element, text in out:
        while text and element is not None:
            element.chars += len(text)
            element = element.parent
    holds = set()
    for e in elements:
        if e.main and not e.cue and e.chars:
            while e is not None:
                holds.add(id(e))
                e = e.parent
    for e in elements:  # parents come first
        kept = id(e) in holds or (not holds and e.chars * 2 > root.chars)
        e.junk = (e.cue and not kept) or bool(e.parent and e.parent.junk)
    return out


def _masses(parsed: list[tuple[int, Element, str]], without: set[int] = frozenset()) -> dict[int, int]:
    """Characters under each element, by its id; 0 has those of the page. Not of junk, nor of the texts of some tokens."""
    mass: dict[int, int] = defaultdict(int)
    for t, e, text in parsed:
        if text and not e.junk and t not in without:
            mass[0] += len(text)
            while e is not None:
                mass[id(e)] += len(text)
                e = e.parent
    return mass


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors of the tokens of a batch, with the characters in them and the role each stands in; token 0 is the page."""
    names = ("pages", "total", "vector", "place", "chars", "parent", "kind")
    for batch in pieces_of(batches, "html", 16 << 20):
        found: dict[tuple[str, int], list[int]] = {}
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
            parsed = parse(page or "")
            if not parsed:
                continue  # no page to learn from
            mass, opened = _masses(parsed), set()
            seen: dict[int, list[int]] = {0: [1, 0, mass[0], 0, 0]}
            for i, (t, e, text) in enumerate(parsed):
                if e.junk:
                    continue
                kind = 2 if text else int(t == e.number)
                x = seen.setdefault(t, [0, i, 0, (e if text else e.parent).number, kind])
                x[0] += 1
                if text:
                    x[2] += len(text)
                elif kind and id(e) not in opened:
                    opened.add(id(e))
                    x[2] += mass[id(e)]
            for t, (n, first, chars, parent, kind) in seen.items():
                x = found.setdefault((host, t), [0, 0, 0, 0, 0, parent, kind])
                x[0] += 1
                x[1] += n
                x[2] = (x[2] + xxhash.xxh3_64_intdigest(b"%d:%d" % (key, n))) & ((1 << 62) - 1)
                x[3] += first
                x[4] += chars
        keys, sums = list(found), list(found.values())
        yield pa.record_batch({"host": pa.array([k[0] for k in keys], pa.string()), "token": pa.array([k[1] for k in keys], pa.int64())} | {c: pa.array([s[i] for s in sums], pa.int64()) for i, c in enumerate(names)})


def templates(pages: DataFrame) -> DataFrame:
    """host, all (pages), text (their characters), template array<struct<place, token, class, frame, chars, parent, kind>>.

    The template is the host's classes, nested in order of position. frame: on so many pages that a text is the host's.
    chars: in a text, or under an element, of all pages. kind: 1 an opened element, 2 a text.
    """
    counted = pages.mapInArrow(_count, "host string, token long, pages long, total long, vector long, place long, chars long, parent long, kind long")
    # 62-bit sums are folded in two halves, so that no number of pages overflows
    half = [F.sum(F.col("vector").bitwiseAND((1 << 31) - 1)).alias("low"), F.sum(F.shiftright("vector", 31)).alias("high")]
    sums = counted.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "place", "chars")], *half, F.max("parent").alias("parent"), F.max("kind").alias("kind"))
    sums = written(sums.where("pages > 1 or token = 0 or kind <> 2"), "tokens")  # a text of one page is a slot's, or its host has no other page
    hosts = sums.where("token = 0").select("host", F.col("pages").alias("all"), F.col("chars").alias("text"))
    frequent = sums.where("token <> 0").join(hosts, "host").where(F.col("pages") >= F.ceil(F.col("all") * SUPPORT))
    frame = F.col("pages") >= (F.col("all") + DOUBT) * FRAME
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "chars", "parent", "kind")
    classes = frequent.groupBy("host", "all", "text", frame.alias("frame"), "pages", "total", F.xxhash64("low", "high").alias("class")).agg(F.collect_list(member).alias("members"))
    classes = classes.where((F.size("members") >= SIZE) | F.col("frame"))
    rows = F.transform("members", lambda m: F.struct(m["place"].alias("place"), m["token"].alias("token"), F.col("class"), F.col("frame"), *[m[c].alias(c) for c in ("chars", "parent", "kind")]))
    return classes.select("host", "all", "text", rows.alias("rows")).groupBy("host", "all", "text").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("template"))


class Template:
    """The classes of a host's template, its texts, and the varying characters under each of its elements."""

    def __init__(self, rows: list[dict], text: int):
        self.classes: dict[int, list[int]] = defaultdict(list)
        for r in rows:
            self.classes[r["class"]].append(r["token"])
        self.texts = {r["token"] for r in rows if r["frame"] and r["kind"] == 2}
        self.mass = {r["token"]: r["chars"] for r in rows if r["kind"] == 1}
        above = {r["token"]: r["parent"] for r in rows if r["kind"] == 1}
        self.total = text
        for r in rows:
            if r["token"] in self.texts:
                self.total -= r["chars"]
                at = r["parent"]
                while at in above:
                    self.mass[at] -= r["chars"]
                    at = above[at]

    def fitting(self, at: dict[int, int]) -> set[int]:
        """Tokens of the classes that a page fits, given the first position of each token on it."""
        out: set[int] = set()
        for tokens in self.classes.values():
            last, here = -1, []
            for t in tokens:
                i = at.get(t, -1)
                if i > last:
                    last = i
                    here.append(t)
            if len(here) >= FIT * len(tokens):
                out.update(here)
        return out


def main_text(page: str, template: Template | None = None) -> str:
    """The article of a page: what its slots hold of the template's article, without the template's texts."""
    parsed = parse(page)
    at: dict[int, int] = {}
    for i, (t, _, _) in enumerate(parsed):
        at.setdefault(t, i)
    fits = template.fitting(at) if template else set()
    frame = fits & template.texts if template else set()
    elements = {id(e): e for _, e, text in parsed if not text and not e.junk}
    mass = _masses(parsed, frame)
    if mass[0] * 4 <= _masses(parsed)[0]:
        # a copy of most pages of its host: its text is no frame
        frame, mass = set(), _masses(parsed)
    chosen: set[int] = set()
    if fits:
        framed = {k: e for k, e in elements.items() if e.number in fits and mass[k]}
        chosen = _article(framed, {k: template.mass.get(e.number, 0) for k, e in framed.items()}, template.total)
    chosen = chosen or _article(elements, mass, mass[0])
    inside: dict[int, bool] = {}

    def within(e: Element) -> bool:
        if id(e) not in inside:
            inside[id(e)] = not e.junk and (id(e) in chosen or not chosen or (e.parent is not None and within(e.parent)))
        return inside[id(e)]

    return " ".join(text for t, e, text in parsed if text and t not in frame and within(e))


def _article(elements: dict[int, Element], mass: dict[int, int], total: int) -> set[int]:
    """Ids of the elements that are called article or main, if they have some of the varying text, else of the innermost kind with most of it."""
    for name in _NAMES:
        named = {k: e for k, e in elements.items() if e.name == name and mass[k] > 0}
        if max((mass[k] for k in named), default=0) >= NAMED * total > 0:
            return set(named)
    large = [e for k, e in elements.items() if mass[k] >= MOST * total > 0]
    inner = max(large, key=lambda e: e.role.count(">"), default=None)
    return {k for k, e in elements.items() if inner is not None and e.number == inner.number}


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces_of(batches, "html", 16 << 20):
        out, known = [], {}
        for i, (host, page) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True)):
            if host not in known:
                known[host] = Template(batch.column("template")[i].as_py() or [], batch.column("host_text")[i].as_py() or 0)
            out.append(main_text(page or "", known[host]))
        yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string())})


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the article of each page, its blocks joined by one space; empty if there is none.

    Null or empty html gives an empty text and is no page of its host's; a null url is a host of its own; a host of one
    page has that page's elements as its template. A page of which three quarters of the text are the template's keeps
    it: it is a copy of most pages of its host. Every row is answered, repeated ones too; pages of any length are read whole;
    other columns are not returned and an empty table gives an empty table.
    """
    ship(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(host.alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), "page_id", "url", "html")
    made = written(templates(rows.select("host", "key", "html")), "templates")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return rows.drop("key").join(made.withColumnRenamed("text", "host_text"), "host", "left").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op1_html_template(spark, sf_dir: str) -> DataFrame:
    out = extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
