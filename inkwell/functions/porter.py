"""The Porter stemmer, from the algorithm's published description (1980)."""

from __future__ import annotations

from functools import lru_cache

_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous",
    ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


def _replace(w: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            return base + table[end] if _measure(base) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w
