"""Search over pages: filters, keyword search by BM25, fuzzy search, and their fusion by reciprocal ranks."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = ("space", "tag", "type", "sensitivity", "owner", "status", "before", "after")
#: Retired keys of spaces (fixed values).
SPACE_ALIASES = {"deployment": "release", "environment": "release", "stakeholder": "release"}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, LIMIT, QUERY_CHARS = 60, 50, 400


@dataclass
class Query:
    text: str
    filters: dict[str, str] = field(default_factory=dict)


def canonical_space(key: str) -> str:
    return SPACE_ALIASES.get(key, key)


def parse_query(raw: str) -> Query:
    """Words and quoted phrases; name:value of a known field is a filter, the last of a name wins."""
    filters, terms = {}, []
    for token in re.findall(r'(?:[^\s"]+|"[^"]*")+', raw[:QUERY_CHARS]):
        name, colon, value = token.partition(":")
        if colon and value and name.isalpha() and name.isascii() and name.lower() in FIELDS:
            filters[name.lower()] = re.sub(r'^"|"$', "", value)
        else:
            terms.append(token)
    return Query(" ".join(terms).strip(), filters)


def apply_filters(pages: DataFrame, filters: dict[str, str], tags: DataFrame | None = None) -> DataFrame:
    """Equalities and text comparisons that reach the scan; tag: a semi-join with tags (page_id, name), or the column tags."""
    for name, value in filters.items():
        if name == "space":
            pages = pages.where(F.col("space") == canonical_space(value))
        elif name == "before":
            pages = pages.where(F.col("updated_at").cast("string") < value)
        elif name == "after":
            pages = pages.where(F.col("updated_at").cast("string") > value)
        elif name == "tag":
            pages = pages.join(tags.where(F.col("name") == value).select(F.col("page_id").alias("id")), "id", "left_semi") if tags is not None else pages.where(F.array_contains("tags", value))
        else:
            pages = pages.where(F.col(name) == value)
    return pages


def ranked(df: DataFrame, *order: Column, limit: int, mode: str) -> DataFrame:
    """The first rows in an order, numbered from 1. The limit comes first, so one task only numbers `limit` rows."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("mode", F.lit(mode))


# ---------------------------------------------------------------- keyword search


class Malformed(ValueError):
    pass


class Expression:
    """AND, OR, NOT, NEAR(a b, n), quotes, prefix*, ^first and column:term, as a tree over phrases."""

    def __init__(self, raw: str, stemmed: bool):
        self.stemmed, self.phrases = stemmed, []
        if re.search(r'\b(?:AND|OR|NOT|NEAR)\b|["*^]|:', raw):
            self.parts = re.findall(r'"(?:[^"]|"")*"|[()*^:,+]|[^\s"()*^:,+]+', raw)
            if raw.count('"') % 2:
                raise Malformed(raw)
            self.tree = self._or()
            if self.parts:
                raise Malformed(raw)
        else:
            words = [self._phrase(w) for w in raw.replace('"', "").split()]
            self.tree = ("and", words)

    def _peek(self) -> str:
        return self.parts[0] if self.parts else ""

    def _chain(self, word: str, kind: str, below) -> tuple:
        found = [below()]
        while self._peek() == word:
            self.parts.pop(0)
            found.append(below())
        return found[0] if len(found) == 1 else (kind, found)

    def _or(self) -> tuple:
        return self._chain("OR", "or", self._and)

    def _and(self) -> tuple:
        found = [self._not()]
        while self._peek() == "AND" or (self._peek() and self._peek() not in ("OR", "NOT", ")", ",", "*", ":", "+")):
            if self._peek() == "AND":
                self.parts.pop(0)
            found.append(self._not())
        return found[0] if len(found) == 1 else ("and", found)

    def _not(self) -> tuple:
        return self._chain("NOT", "not", self._one)

    def _one(self, column: str | None = None) -> tuple:
        part = self.parts.pop(0) if self.parts else ""
        if part == "(":
            found = self._or()
            if not self.parts or self.parts.pop(0) != ")":
                raise Malformed("(")
            return found
        if part == "NEAR" and self._peek() == "(":
            self.parts.pop(0)
            inner, gap = [], 10
            while self._peek() not in (")", ""):
                if self._peek() == ",":
                    self.parts.pop(0)
                    gap = int(self.parts.pop(0))
                else:
                    inner.append(self._one())
            if not self.parts or not inner:
                raise Malformed("NEAR")
            self.parts.pop(0)
            return ("near", inner, gap)
        if not part or part in ("AND", "OR", "NOT", ")", "*", ":", ",", "+"):
            raise Malformed(part)
        if part == "^":
            name, number = self._one(column)
            self.phrases[number]["first"] = True
            return name, number
        if self._peek() == ":" and part in ("title", "body_text"):
            self.parts.pop(0)
            return self._one(part)
        word = part[1:-1].replace('""', '"') if part.startswith('"') else part
        out = self._phrase(word, column)
        if self._peek() == "*":
            self.parts.pop(0)
            self.phrases[out[1]]["prefix"] = True
        return out

    def _phrase(self, word: str, column: str | None = None) -> tuple:
        self.phrases.append({"words": T.tokens(word, self.stemmed), "prefix": False, "first": False, "column": column})
        return ("phrase", len(self.phrases) - 1)


def _places(tokens: Column, phrase: dict) -> Column:
    """Positions (from 1) at which a phrase starts."""
    words = phrase["words"]
    n = len(words)
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    if phrase["first"]:
        at = F.slice(at, 1, 1)

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(words):
            t = F.element_at(tokens, (i + k).cast("int"))
            ok = ok & (F.startswith(t, F.lit(w)) if phrase["prefix"] and k == n - 1 else t == w)
        return ok

    return F.filter(at, here)


def _count(tokens: Column, phrase: dict) -> Column:
    if not phrase["words"]:
        return F.lit(0)
    if len(phrase["words"]) == 1 and not phrase["prefix"] and not phrase["first"]:
        return F.size(tokens) - F.size(F.array_remove(tokens, phrase["words"][0]))
    return F.size(_places(tokens, phrase))


def _holds(tree: tuple, phrases: list[dict], counts: list[Column], tokens: Column) -> Column:
    kind = tree[0]
    if kind == "phrase":
        return counts[tree[1]] > 0 if phrases[tree[1]]["words"] else F.lit(True)
    if kind == "near":
        _, inner, gap = tree
        first = _places(tokens, phrases[inner[0][1]])

        def close(i: Column) -> Column:
            ok = F.lit(True)
            for _, number in inner[1:]:
                ok = ok & F.exists(_places(tokens, phrases[number]), _within(i, gap, len(phrases[inner[0][1]]["words"]), len(phrases[number]["words"])))
            return ok

        return F.exists(first, close)
    parts = [_holds(t, phrases, counts, tokens) for t in tree[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if kind == "and" else out | p if kind == "or" else out & ~p
    return out


def _possible(tree: tuple, phrases: list[dict], low: Column) -> Column:
    """False only where a text in lower case cannot match the tree: a word that is not stemmed stands in it as it is."""
    kind = tree[0]
    if kind == "phrase":
        parts = [F.contains(low, F.lit(w)) for w in phrases[tree[1]]["words"]]
    else:
        parts = [_possible(t, phrases, low) for t in (tree[1][:1] if kind == "not" else tree[1])]
    out = parts[0] if parts else F.lit(True)
    for p in parts[1:]:
        out = out | p if kind == "or" else out & p
    return out


def _within(i: Column, gap: int, mine: int, other: int):
    return lambda j: (j - i - mine <= gap) & (i - j - other <= gap)


def bm25(tf: list[Column], dl: Column, n: int, average: float, found: list[int]) -> Column:
    """Negated BM25, so that less is better."""
    import math

    total = F.lit(0.0)
    for t, df in zip(tf, found, strict=True):
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
        total = total + F.lit(idf) * (t * (K1 + 1)) / (t + K1 * (1 - B + B * dl / average))
    return -total


def keyword_search(pages: DataFrame, raw: str, limit: int = LIMIT, stemmed: bool = True, filters: dict | None = None, tags: DataFrame | None = None, any_term: bool = False) -> DataFrame:
    """Pages (id, title, body_text, ...) that match, best first, with score, rank, mode and snippet.

    Word counts of the few query phrases are taken from each page's words where it is read; the corpus statistics
    are one aggregate row. No postings are shuffled for a single query; `postings` builds a table for many.
    A malformed expression finds nothing, with a warning.
    """
    schema = pages.limit(0).withColumn("score", F.lit(0.0)).withColumn("snippet", F.lit("")).withColumn("rank", F.lit(1)).withColumn("mode", F.lit("strict"))
    try:
        asked = Expression(raw, stemmed)
    except (Malformed, ValueError, IndexError) as e:
        warnings.warn(f"malformed query: {e}", stacklevel=2)
        return schema
    if not any(p["words"] for p in asked.phrases):
        return schema
    split = T.stemmed_words if stemmed else T.words
    parts = pages.withColumn("_title", split(F.coalesce("title", F.lit("")))).withColumn("_body", split(F.coalesce("body_text", F.lit(""))))
    both = F.concat("_title", "_body")
    where = {None: both, "title": F.col("_title"), "body_text": F.col("_body")}
    counted = parts.select("*", F.size(both).alias("_dl"), *[_count(where[p["column"]], p).alias(f"_tf{i}") for i, p in enumerate(asked.phrases)])
    tf = [F.col(f"_tf{i}") for i in range(len(asked.phrases))]
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("average"), *[F.count_if(t > 0).alias(f"d{i}") for i, t in enumerate(tf)]).first()
    if not stats["n"] or not stats["average"]:
        return schema
    holds = tf[0] > 0
    if any_term:
        for t in tf[1:]:
            holds = holds | (t > 0)
    else:
        holds = _holds(asked.tree, asked.phrases, tf, both)
    if not stemmed:  # few pages are read as words a second time
        low = F.lower(F.concat_ws("\n", "title", "body_text"))
        counted = counted.where(_possible(("or", [("phrase", i) for i in range(len(tf))]) if any_term else asked.tree, asked.phrases, low))
    hits = apply_filters(counted, filters or {}, tags).where(holds)
    hits = hits.withColumn("score", bm25(tf, F.col("_dl"), stats["n"], stats["average"], [stats[f"d{i}"] for i in range(len(tf))]))
    wanted = sorted({w for p in asked.phrases for w in p["words"]})
    top = ranked(hits, F.round("score", 9).asc(), F.asc("id"), limit=limit, mode="strict")
    return top.withColumn("snippet", snippet(wanted, stemmed)(F.coalesce("body_text", F.lit("")))).select(schema.columns)


def snippet(wanted: list[str], stemmed: bool = True, size: int = 18):
    """The window of `size` words with the most different wanted words, each marked; runs on the few rows of a result."""
    want = set(wanted)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            spans = [(m.start(), m.end(), (T.tokens(m[0], stemmed) or [""])[0]) for m in re.finditer(r"[^\W_]+", t)]
            hits = [i for i, s in enumerate(spans) if s[2] in want]
            if not spans:
                return ""
            start = max(hits or [0], key=lambda i: (len({s[2] for s in spans[i : i + size]} & want), -i))
            start = max(0, min(start, len(spans) - size))
            some = spans[start : start + size]
            out, at = ["…" if start else ""], some[0][0]
            for a, b, w in some:
                out += [t[at:a], f"<mark>{t[a:b]}</mark>" if w in want else t[a:b]]
                at = b
            return "".join([*out, "…" if start + size < len(spans) else ""])

        return texts.map(one)

    return cut


def postings(pages: DataFrame, stemmed: bool = True) -> DataFrame:
    """term, id, tf, dl: the inverted index of many pages, with partial counts before the shuffle."""
    split = T.stemmed_words if stemmed else T.words
    both = split(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body_text", F.lit(""))))
    rows = pages.select("id", both.alias("w")).select("id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def search_postings(index: DataFrame, terms: list[str], n: int, average: float, every: bool = True) -> DataFrame:
    """id, score of BM25 from a postings table; every: ids that have all terms, else any."""
    rows = index.where(F.col("term").isin(*terms))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    scored = rows.join(df, "term").groupBy("id").agg((-F.sum(part)).alias("score"), F.count(F.lit(1)).alias("terms"))
    return scored.where(F.col("terms") == len(set(terms))) if every else scored


# ---------------------------------------------------------------- fuzzy search

TITLE_WEIGHT, BODY_WEIGHT, WORD_BONUS, LEAST_SCORE, BODY_CHARS = 2.0, 0.6, 0.8, 0.08, 4000


def fuzzy_search(pages: DataFrame, raw: str, limit: int = LIMIT, filters: dict | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Trigram similarity of title and body, and a bonus if a query word of four letters is within two edits of a title word."""
    rows = apply_filters(pages, filters or {}, tags)
    body = F.coalesce("body_text", F.lit(""))
    words = raw.lower().split()
    score = _fuzzy_score(raw, [w for w in words if len(w) >= 4])(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.substring(body, 1, BODY_CHARS)))
    # the limit comes before the filter, which would be pushed below the score and count all again
    found = rows.withColumn("score", score).orderBy((F.col("score") > LEAST_SCORE).desc(), F.round("score", 9).desc(), F.asc("id")).limit(limit)
    scored = found.where(F.col("score") > LEAST_SCORE)
    at = F.instr(F.lower(body), words[0] if words else "")
    start = F.greatest(at - 41, F.lit(0))
    window = F.concat(F.lit("…"), F.trim(F.substring(body, start + 1, at + 119 - start)), F.lit("…"))
    cut = F.when(at > 0, window).otherwise(F.substring(body, 1, 140))
    return ranked(scored, F.round("score", 9).desc(), F.asc("id"), limit=limit, mode="fuzzy").withColumn("snippet", cut)


def _fuzzy_score(raw: str, words: list[str], edits: int = 2):
    """Score of titles and bodies in lower case, on Arrow batches: built-in functions would make a string of each trigram and word."""
    spaces, most = re.compile(T.SPACES, re.A), 100_000

    @F.pandas_udf("double")
    def score(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        similar, known = T.Similarity(raw), {}

        def near(w: str) -> bool:
            if w not in known:
                if len(known) >= most:
                    known.clear()
                known[w] = any(T.edits(q, w, edits) <= edits for q in words)
            return known[w]

        def one(title: str, body: str) -> float:
            bonus = WORD_BONUS if any(map(near, spaces.split(title))) else 0.0
            return similar(title) * TITLE_WEIGHT + similar(body) * BODY_WEIGHT + bonus

        return pd.Series([one(t, b) for t, b in zip(titles, bodies, strict=True)], dtype=float)

    return score


def filter_search(pages: DataFrame, filters: dict, tags: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """All pages that pass the filters, the most recently updated first."""
    rows = apply_filters(pages, filters, tags).withColumn("snippet", F.substring("body_text", 1, 160)).withColumn("score", F.lit(0.0))
    return ranked(rows, F.desc("updated_at"), F.asc("title"), limit=limit, mode="filter")


def fuse(lists: list[DataFrame], key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank, mode, ...): rrf and modes; earlier lists' fields win, later ones fill gaps."""
    rows = None
    for i, one in enumerate(lists):
        one = one.withColumn("_list", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    other = [c for c in rows.columns if c not in (key, "rank", "mode", "_list")]
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_list"))).alias(c) for c in other]
    modes = F.transform(F.array_sort(F.collect_list(F.struct("_list", "mode"))), lambda m: m["mode"])
    places = F.min(F.struct("_list", "rank"))
    return rows.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), modes.alias("modes"), places.alias("_place"), *firsts)


def hybrid_search(pages: DataFrame, raw: str, limit: int = LIMIT, stemmed: bool = True, filters: dict | None = None, tags: DataFrame | None = None) -> DataFrame:
    both = fuse([keyword_search(pages, raw, limit, stemmed, filters, tags), fuzzy_search(pages, raw, limit, filters, tags)])
    return ranked(both, F.desc("rrf"), F.asc("_place"), limit=limit, mode="hybrid").drop("_place")


def search(pages: DataFrame, raw: str, mode: str = "hybrid", limit: int = LIMIT, tags: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    asked = parse_query(raw)
    if not asked.text:
        return filter_search(pages if asked.filters else pages.limit(0), asked.filters, tags, limit)
    if mode == "strict":
        return keyword_search(pages, asked.text, limit, stemmed, asked.filters, tags)
    if mode == "fuzzy":
        return fuzzy_search(pages, asked.text, limit, asked.filters, tags)
    return hybrid_search(pages, asked.text, limit, stemmed, asked.filters, tags)
