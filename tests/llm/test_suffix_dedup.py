import random

import pytest

from inkwell.llm import suffix_dedup as S


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(30):
        t = " ".join(word() for _ in range(r.randint(0, 60)))
        if i % 3 == 0:
            t += passage[r.randint(0, 30) : len(passage) - r.randint(0, 60)] + word()
        out.append(t)
    out += [out[3], out[3], "", None, "x" * 900, "xy" * 300, out[0][:250], out[6] + out[9]]
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_equals_brute_force(spark, most):
    rows = [(i, t, "n") for i, t in enumerate(texts(1))] + [(None, "q" * 400, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: bytes(r.kept) for r in S.suffix_dedup(df, window=100, most=most).collect()}
    want = S.brute_force([(t or "").encode() for _, t, _ in rows], 100)
    assert len(got) == len(rows)
    for (i, _, _), w in zip(rows, want, strict=True):
        assert got[i] == w, i


@pytest.mark.parametrize("most", [20_000, 2])
def test_keep_first(spark, most):
    rows = [(i, t) for i, t in enumerate(texts(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in S.suffix_dedup(df, window=100, keep_first=True, most=most).collect()}
    seen: set = set()
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(w)
        assert got[i] == bytes(c for c, g in zip(b, gone, strict=True) if not g), i


def test_empty_table(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
