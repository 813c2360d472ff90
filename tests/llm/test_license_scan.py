import os
import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import license_scan as L
from inkwell.llm._common import text_bytes


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(1, 12)).astype(np.uint64), r.integers(0, 5, r.integers(1, 14)).astype(np.uint64)
        n, first, end = L.align(a, b, 0, 30)
        assert n == lcs(a.tolist(), b.tolist())
        if n:
            assert 0 <= first < end <= len(b) and lcs(a.tolist(), b[first:end].tolist()) == n


def broken(r, words, breaks):
    """Words of a notice with so many of them missing, or with some put in between."""
    words = list(words)
    for _ in range(breaks):
        at = r.randrange(1, len(words) - 1)
        words[at : at + 1] = r.choice([[], ["zzz"], [words[at], "zzz"]])
    return words


def test_every_template_is_found_with_breaks():
    r = random.Random(3)
    index = L.Index(L.TEMPLATES)
    for name, text in L.TEMPLATES.items():
        plain = [text.encode()[a:b].decode() for _, begin, end, _, _ in [L.words_of(*text_bytes(pa.array([text])))] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        for turn in range(30):
            breaks = turn % (len(plain) // 5 + 1)
            words = broken(r, plain, breaks)
            if lcs([w.lower() for w in plain], [w.lower() for w in words]) < 0.8 * len(plain) or len(words) - len(plain) > L.BAND:
                continue
            t = "Ünd w " * 5 + " ".join(words) + " end of it " * 3
            found = [x for x in L.scan(*text_bytes(pa.array([t])), index) if x[1] == name]
            assert len(found) == 1, (name, t)
            if not breaks:
                assert found[0][3] == 1 and t.encode()[found[0][4] : found[0][5]].decode() == " ".join(plain)


def test_short_notices_near_misses_and_repeats():
    index = L.Index(L.TEMPLATES)

    def names(text):
        return [x[1] for x in L.scan(*text_bytes(pa.array([text])), index)]

    assert "Apache-2.0-notice" in names("Licensed under the Apache Licence Version 2.0")
    assert "MIT-licensed" in names("Licensed under the very MIT License") and "MIT-licensed" in names("Licensed under MIT License")
    assert "MIT-notice" in names("Released under the MIT Licence")
    assert names("Licensed under the old law") == [] and names("the MIT building is under the hill") == []
    assert names("Released under the MIT License.\nReleased under the MIT License.\n" * 3).count("MIT-notice") == 6
    assert names("x" * 200_000) == [] and names("License " * 20_000) == []


def dense(words, h, coverage):
    """Whether some stretch of the text has enough of the words in order: every word of the text is tried as a first one."""
    need = coverage * len(words)
    there = np.isin(h, words)
    return any(np.isin(words, part).sum() >= need and lcs(words.tolist(), part.tolist()) >= need for i in np.flatnonzero(there).tolist() if len(part := h[i : i + len(words) + L.BAND]) >= need and there[i : i + len(words) + L.BAND].sum() >= need)


def test_query_equals_dense_alignment(spark):
    """Every template against every place of every text, without fingerprints."""
    from inkwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    index = L.Index(L.TEMPLATES)
    got = {r.doc_id: r for r in QUERIES["op6_license_scan"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        h = L.words_of(*text_bytes(pa.array([d.text or ""])))[4]
        want = {n for n, w in zip(index.names, index.words, strict=True) if dense(w, h, L.COVERAGE)}
        assert {x.split(":")[0] for x in got[d.doc_id].spans.split(",") if x} == want, d.doc_id
        assert got[d.doc_id].n_matches >= len(want) and (got[d.doc_id].coverage >= L.COVERAGE) == bool(want)


def test_tables(spark):
    mit = L.TEMPLATES["MIT-notice"]
    rows = [(1, f"é {mit}. x", "m"), (1, f"é {mit}. x", "m"), (2, "Released under an old license", "m"), (None, None, None), (3, "", "m"), (4, "w " * 50_000 + mit, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    got = sorted((str(r.doc_id), [(m.license, m.matched, m.start, m.end) for m in r.matches if m.license == "MIT-notice"]) for r in L.license_matches(df).collect())
    assert got == [("1", [("MIT-notice", 5, 2, 2 + len(mit))])] * 2 + [("2", []), ("3", []), ("4", [("MIT-notice", 5, 100_000, 100_000 + len(mit))]), ("None", [])]
    assert L.license_matches(df.limit(0)).count() == 0
