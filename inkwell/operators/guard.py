"""The privacy boundary: a registry of protected names, structural patterns, masking, scanning and the leak gate.

The registry is small and driver-side; what it compiles to goes to the tasks inside the functions that use it. Masking
and scanning need match offsets, guards and one pass over an alternation, so they run on Arrow batches; masking by
patterns that need no guard also has a native form.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.arrow import slices
from ..functions.text import col

PREFIXES = {"org": "CLIENT", "person": "PERSON", "project": "PROJECT", "host": "HOST", "other": "REF"}
_LEGAL = r"SE|AG|GmbH|S\.?A\.?|SRL|S\.?R\.?L\.?|PLC|N\.?V\.?|S\.?p\.?A\.?|Ltd|Limited|Inc|LLC|B\.?V\.?|Oy|AB|A/S"
_SUFFIX = re.compile(rf"\s+(?:{_LEGAL})\.?$", re.I)
_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    auto: bool
    pattern: str
    any_case: bool = False
    only: str | None = None  # the match must match this too
    never: str | None = None  # and must not match this

    @property
    def label(self) -> str:
        return f"[{PREFIXES[self.kind]}_{self.name.upper().replace('-', '_')}]"

    def hits(self, text: str) -> list[tuple[int, int]]:
        pattern, only, never = _regexes(self)
        return [m.span() for m in pattern.finditer(text) if (not only or only.search(m[0])) and not (never and never.search(m[0]))]


@cache
def _regexes(rule: Rule) -> tuple[re.Pattern, re.Pattern | None, re.Pattern | None]:
    guard = lambda p, flags=0: re.compile(p, re.A | flags) if p else None
    return guard(rule.pattern, re.I if rule.any_case else 0), guard(rule.only), guard(rule.never, re.I if rule.name == "legal-entity" else 0)


# What the rules match, in the order in which they are tried.
RULES = (
    Rule("email", "person", True, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    Rule("salesforce-id", "other", True, r"\b[a-zA-Z0-9]{15}(?:[A-Z0-5]{3})?\b", only=r"^(?=.*\d.*\d)(?:00[0-9A-Za-z]|a[0-9A-Za-z]{2}|500|012)"),
    Rule(
        "jira-key", "project", False, r"\b[A-Z][A-Z0-9]{1,9}-\d{1,6}\b",
        never=r"^(?:ISBN|ISSN|UTF|UCS|SHA|MD|AES|RSA|DES|TLS|SSL|HTTP|ISO|IEC|EN|DIN|RFC|CVE|CWE|NIST|PCI|SOC|GDPR|ITIL|IPV|COVID|WCAG|ECMA|ES|ANSI|BS|IEEE|X|Y2K)-",
    ),
    Rule(
        "legal-entity", "org", False,
        r"\b(?:[A-Z][\w.&'-]{1,20}\s+){1,3}(?:SE|AG|GmbH|S\.A\.|SRL|S\.R\.L\.|PLC|plc|N\.V\.|NV|S\.p\.A\.|SpA|Ltd|Limited|Inc|LLC|BV|B\.V\.|Oy|AB|A/S)\b",
        never=r"^(?:Java|Jakarta|Windows|iPhone)\s+SE$",
    ),
    Rule("internal-host", "host", True, r"\b(?:[a-z0-9-]+\.)+(?:internal|intranet|local|corp|lan|test|dev|uat|sit|prod)\b", any_case=True),
    Rule("ipv4", "host", True, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    Rule("iban", "other", True, r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    Rule("vat", "other", True, r"\b(?:VAT|CUI|CIF|USt-IdNr\.?)[:\s]*[A-Z]{0,2}\d{6,12}\b", any_case=True),
)


def detect(text: str) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of every hit, by start; hits of different rules may overlap."""
    return sorted([(a, b, r) for r in RULES for a, b in r.hits(text)], key=itemgetter(0))


def normalise(name: str) -> str:
    return re.sub("[^a-z0-9]", "", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", name.lower())))


def variants(canonical: str, aliases: tuple[str, ...] = ()) -> list[str]:
    """Spellings of a name: without its legal suffix, its aliases, and each without, or with other, punctuation."""
    out: dict[str, None] = {}
    for seed in filter(None, (s.strip() for s in (canonical, _SUFFIX.sub("", canonical), *aliases))):
        spaced = re.sub(r"\s+", " ", re.sub("[.\\-_'’]", " ", seed)).strip()
        out |= dict.fromkeys((seed, re.sub("[.\\-_'’]", "", seed), spaced, re.sub("[.\\s_'’]+", "-", seed)))
    return [v for v in out if len(normalise(v)) >= 2]


def letters(n: int) -> str:
    """0 is A, 25 is Z, 26 is AA."""
    out, n = "", n + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


@dataclass(frozen=True)
class Entity:
    id: int
    canonical: str
    kind: str
    aliases: tuple[str, ...]
    pseudonym: str
    active: bool = True


@dataclass
class Registry:
    """Protected names. Each change makes a new version; rows that were masked under another one are stale."""

    entities: list[Entity] = field(default_factory=list)
    version: int = 0

    def add(self, canonical: str, kind: str = "org", aliases: tuple[str, ...] = ()) -> Entity:
        """An entity of the same normal form is returned as it is, and revived if it was retired."""
        canonical = canonical.strip()
        if not variants(canonical, tuple(aliases)):
            raise ValueError("a protected name needs two letters or digits of the Latin alphabet in some spelling")
        for i, e in enumerate(self.entities):
            if normalise(e.canonical) == normalise(canonical):
                if not e.active:
                    self.entities[i] = e = replace(e, active=True)
                    self.version += 1
                return e
        taken = {e.pseudonym for e in self.entities}
        n = sum(e.kind == kind for e in self.entities)
        name = lambda n: f"{PREFIXES.get(kind, 'REF')}_{letters(n) if kind == 'org' else f'{n + 1:02d}'}"
        while name(n) in taken:
            n += 1
        made = Entity(max((e.id for e in self.entities), default=0) + 1, canonical, kind, tuple(aliases), name(n))
        self.entities.append(made)
        self.version += 1
        return made

    def active(self) -> list[Entity]:
        return sorted((e for e in self.entities if e.active), key=lambda e: (e.kind, e.pseudonym))

    def retire(self, id_: int) -> None:
        self.entities = [replace(e, active=False) if e.id == id_ else e for e in self.entities]
        self.version += 1

    def purge(self, id_: int, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("purging an entity cannot be undone; pass confirm=True")
        kept = [e for e in self.entities if e.id != id_]
        self.version += len(kept) != len(self.entities)
        self.entities = kept

    def matcher(self) -> Matcher:
        return Matcher.of(self)

    def table(self, spark) -> DataFrame:
        rows = [(e.id, e.canonical, normalise(e.canonical), e.kind, list(e.aliases), e.pseudonym, e.active) for e in self.entities]
        return spark.createDataFrame(rows, "id long, canonical string, norm string, type string, aliases array<string>, pseudonym string, active boolean")

    @classmethod
    def of_table(cls, table: DataFrame, version: int = 0) -> Registry:
        return cls([Entity(r.id, r.canonical, r.type, tuple(r.aliases or ()), r.pseudonym, r.active) for r in table.orderBy("id").collect()], version)


@dataclass(frozen=True)
class Matcher:
    """All spellings of the active entities as one alternation, the longest first."""

    pattern: str | None
    owner: dict[str, tuple[int, str]]
    longest: int

    @classmethod
    def of(cls, registry: Registry) -> Matcher:
        forms, owner = [], {}
        for e in registry.active():
            for v in variants(e.canonical, e.aliases):
                forms.append(v)
                owner[normalise(v)] = (e.id, e.pseudonym)
        forms.sort(key=len, reverse=True)
        return cls(f"{_L}(?:{'|'.join(map(re.escape, forms))}){_R}" if forms else None, owner, max(map(len, forms), default=0))

    def finditer(self, text: str):
        return re.finditer(self.pattern, text, re.I) if self.pattern else ()

    def mask(self, text: str | None) -> str | None:
        """Structural hits first, each as a whole (the leftmost, then the longest, of those that overlap); then names."""
        if text is None:
            return None
        parts, at = [], 0
        for a, b, rule in sorted((h for h in detect(text) if h[2].auto), key=lambda h: (h[0], -h[1])):
            if a >= at:
                parts += [text[at:a], rule.label]
                at = b
        text = "".join([*parts, text[at:]])
        if not self.pattern:
            return text
        return re.sub(self.pattern, lambda m: self.owner.get(normalise(m[0]), (0, m[0]))[1], text, flags=re.I)

    def leaks(self, text: str | None) -> list[str]:
        return [m[0] for m in self.finditer(text or "")]

    def scan(self, text: str | None) -> list[dict]:
        """Names with confidence 1, and structural hits that no name covers, by start."""
        text = text or ""
        out = []
        for m in self.finditer(text):
            if owner := self.owner.get(normalise(m[0])):
                out.append({"layer": "gazetteer", "entity_id": owner[0], "rule": None, "surface": m[0], "start": m.start(), "confidence": 1.0, "status": "confirmed"})
        spans = [(x["start"], x["start"] + len(x["surface"])) for x in out]
        for a, b, r in detect(text):
            if not any(a < e and b > s for s, e in spans):
                out.append({"layer": "pattern", "entity_id": None, "rule": r.name, "surface": text[a:b], "start": a, "confidence": 0.95 if r.auto else 0.6, "status": "confirmed" if r.auto else "candidate"})
        return sorted(out, key=lambda x: x["start"])


def mask(c: str | Column, matcher: Matcher) -> Column:
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(matcher.mask)

    return masked(col(c))


def mask_patterns(c: str | Column, *names: str) -> Column:
    """Labels for hits of rules that need no guard, by regexp_replace in the JVM; rules apply one after the other."""
    out = col(c)
    for r in RULES:
        if r.name in names:
            if r.only or r.never:
                raise ValueError(f"{r.name} has a guard")
            pattern = re.sub(r"^\\b", _L, re.sub(r"\\b$", _R, r.pattern))
            out = F.regexp_replace(out, ("(?i)" if r.any_case else "") + pattern, r.label)
    return out


OCCURRENCES = "array<struct<layer: string, entity_id: long, rule: string, surface: string, start: int, confidence: double, status: string>>"


def scan(c: str | Column, matcher: Matcher) -> Column:
    @F.pandas_udf(OCCURRENCES)
    def scanned(texts: pd.Series) -> pd.Series:
        return texts.map(matcher.scan)

    return scanned(col(c))


def mask_deep(df: DataFrame, matcher: Matcher) -> DataFrame:
    """Every string of a table masked, inside structs, arrays and map values too; names of fields and map keys stay."""

    def walk(c: Column, kind: t.DataType) -> Column:
        if isinstance(kind, t.StringType):
            return mask(c, matcher)
        if isinstance(kind, t.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind]))
        if _strings(kind):
            return masked_json(c, kind)
        return c

    def masked_json(c: Column, kind: t.DataType) -> Column:
        @F.pandas_udf("string")
        def deep(texts: pd.Series) -> pd.Series:
            def leaf(x):
                return matcher.mask(x) if isinstance(x, str) else [leaf(y) for y in x] if isinstance(x, list) else {k: leaf(v) for k, v in x.items()} if isinstance(x, dict) else x

            return texts.map(lambda x: None if x is None else json.dumps(leaf(json.loads(x)), ensure_ascii=False))

        return F.from_json(deep(F.to_json(c)), kind)

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def _strings(kind: t.DataType) -> bool:
    if isinstance(kind, t.ArrayType):
        return isinstance(kind.elementType, t.StringType) or _strings(kind.elementType)
    if isinstance(kind, t.MapType):
        return isinstance(kind.valueType, t.StringType) or _strings(kind.valueType)
    return isinstance(kind, t.StructType) and any(isinstance(f.dataType, t.StringType) or _strings(f.dataType) for f in kind)


class Leak(RuntimeError):
    pass


def leaking(df: DataFrame, matcher: Matcher, *columns: str) -> DataFrame:
    """Rows in which a protected spelling stands in one of the columns; each string is tested by itself, in the JVM."""
    if not matcher.pattern:
        return df.limit(0)
    pattern = "(?iu)" + matcher.pattern
    found = F.lit(False)
    for c in columns:
        found = found | (F.exists(c, lambda x: x.rlike(pattern)) if isinstance(df.schema[c].dataType, t.ArrayType) else F.col(c).rlike(pattern))
    return df.where(F.coalesce(found, F.lit(False)))


def assert_clean(df: DataFrame, matcher: Matcher, *columns: str, where: str = "egress") -> DataFrame:
    """df, unless a protected name is left in it; the error names the place, not the name."""
    if not leaking(df, matcher, *columns).isEmpty():
        raise Leak(f"protected entity leaked at {where}")
    return df


def unmask(text: str, registry: Registry, reveal) -> str:
    """Pseudonyms replaced by what reveal(entity) gives, in one pass, the longest first, retired ones too."""
    names = {e.pseudonym: e for e in registry.entities}
    if not names:
        return text
    pattern = f"{_L}(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))}){_R}"
    return re.sub(pattern, lambda m: reveal(names[m[0]]) or m[0], text)


def occurrences(docs: DataFrame, matcher: Matcher, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each hit: key, and the fields of OCCURRENCES, as columns from the start: no struct is made of a hit in Arrow."""
    fields = t.StructType([docs.select(key).schema[0], *t.DataType.fromDDL(OCCURRENCES).elementType.fields])
    kinds = list(to_arrow_schema(fields))[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [matcher.scan(x) for x in part.column(1).to_pylist()]
            keys = part.column(0).take(pa.array([i for i, hits in enumerate(found) for _ in hits], pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([h[f.name] for hits in found for h in hits], f.type) for f in kinds]], names=fields.names)

    return docs.select(key, text).mapInArrow(run, fields)


def replace_occurrences(stored: DataFrame, fresh: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """What is stored, with the rows of some keys replaced by fresh ones."""
    return stored.join(keys.select(key).distinct(), key, "left_anti").unionByName(fresh)


def review_queue(found: DataFrame, pages: DataFrame, limit: int = 300) -> DataFrame:
    """Candidates with the titles of their pages, the most certain first."""
    rows = found.where("status = 'candidate'").join(pages.select(F.col("id").alias("page_id"), "title"), "page_id", "left")
    return rows.withColumn("title", F.coalesce("title", F.lit("(no page)"))).orderBy(F.desc("confidence"), "surface").limit(limit)
