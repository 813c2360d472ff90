"""Scalar text functions. Column functions stay in the JVM unless they say otherwise."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .porter import stem

#: White space of ECMAScript, which the JVM's \s lacks most of.
SPACES = r"[\s   -     　﻿]+"
#: Characters a token for each kind of block (fixed values).
CHARS_PER_TOKEN = {"table": 2.3, "code": 2.3, "list": 2.8}
PROSE_CHARS = 3.0
WORD = r"[\p{L}\p{N}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: str | Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACES, " "))


def utf16_length(c: str | Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(col(c), "UTF-16LE")) / 2).cast("long")


def token_estimate(c: str | Column, kind: str | Column = "paragraph") -> Column:
    """Estimated tokens of a block's text, rounded up; kind is a column, or the name of a kind."""
    if isinstance(kind, str):
        per = F.lit(CHARS_PER_TOKEN.get(kind, PROSE_CHARS))
    else:
        per = F.lit(PROSE_CHARS)
        for name, n in CHARS_PER_TOKEN.items():
            per = F.when(kind == name, F.lit(n)).otherwise(per)
    return F.ceil(utf16_length(c) / per).cast("long")


def estimate(text: str, kind: str = "paragraph") -> int:
    """token_estimate for one string."""
    units = len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2
    return -int(-units // CHARS_PER_TOKEN.get(kind, PROSE_CHARS))


def round3(c: str | Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(col(c) * 1000 + 0.5) / 1000


def words(c: str | Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(x for x in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(x))


def tokens(text: str, stemmed: bool = True) -> list[str]:
    """Folded words, stemmed: what the keyword index holds."""
    found = re.findall(r"[^\W_]+", fold(text))
    return [stem(w) for w in found] if stemmed else found


@F.pandas_udf(ArrayType(StringType()))
def stemmed_words(texts: pd.Series) -> pd.Series:
    """tokens() of a column: folding and stemming have no built-in, so this one runs on Arrow batches in Python."""
    return texts.map(lambda t: tokens(t) if t is not None else None)


def trigram_set(text: str) -> set[str]:
    t = f" {re.sub('[^a-z0-9]+', ' ', text.lower()).strip()} "
    return {t[i : i + 3] for i in range(len(t) - 2)}


def trigrams(c: str | Column) -> Column:
    """Different three-character strings of the text in lower case, padded by a space; all but [a-z0-9] is space."""
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " ")), F.lit(" "))
    # each offset's strings in one pass over the text: a substring by its place would count characters from the start
    parts = [F.regexp_extract_all(F.substr(t, F.lit(i)), F.lit("..."), F.lit(0)) for i in (1, 2, 3)]
    return F.array_distinct(F.concat(*parts))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of different values; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_NUMBERS = np.zeros(256, np.int64)
_NUMBERS[[ord(x) for x in _LETTERS]] = range(1, len(_LETTERS) + 1)


def gram_numbers(low: str) -> np.ndarray:
    """A number below 37^3 for each three-character string, repeats included, of a text in lower case."""
    n = _NUMBERS[np.frombuffer(f" {low} ".encode(), np.uint8)]
    n = n[np.concatenate(([True], (n[1:] != 0) | (n[:-1] != 0)))]
    return (n[:-2] * 37 + n[1:-1]) * 37 + n[2:]


class Similarity:
    """Jaccard similarity of the trigrams of texts in lower case and of a query. The place where each trigram was last seen tells which are different."""

    def __init__(self, query: str):
        self.wanted = np.unique(gram_numbers(query.lower()))
        self.last, self.read = np.full(37**3, -1), 0

    def __call__(self, low: str) -> float:
        found = gram_numbers(low)
        places = np.arange(self.read, self.read + len(found))
        self.last[found] = places
        own = int((self.last[found] == places).sum())
        both = int((self.last[self.wanted] >= self.read).sum())
        self.read += len(found)
        return both / (own + len(self.wanted) - both) if own and len(self.wanted) else 0.0


def trigram_similarity(c: str | Column, query: str) -> Column:
    """Jaccard similarity of a column's trigrams and a query's; 0 for a null or a text without [a-z0-9]. In Python, where no string is made of a trigram."""

    @F.pandas_udf("double")
    def similar(texts: pd.Series) -> pd.Series:
        return texts.map(Similarity(query)).astype(float)

    return similar(F.lower(F.coalesce(col(c), F.lit(""))))


def edits(a: str, b: str, most: int) -> int:
    """Edits between two strings, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def html_to_text(c: str | Column) -> Column:
    """Text of markup: lines end at block ends and breaks, tags go, six references are decoded, space is squashed."""
    t = F.regexp_replace(col(c), r"(?i)<(?:br\s*/?|/(?:p|div|h[1-6]|li|tr|table|ul|ol|blockquote|pre|section))\s*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ref), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def title_from_filename(c: str | Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(col(c), r"^.*[/\\]", ""), r"\.[^.]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"[_+-]+", " "), r"\s+", " "))


def escape_html(c: str | Column) -> Column:
    out = col(c)
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def floor_percentile(values: Column, q: float) -> Column:
    """Element floor(q * n) of the sorted array, the last one at most."""
    return F.element_at(F.array_sort(values), F.least(F.floor(F.size(values) * q) + 1, F.size(values)).cast("int"))
