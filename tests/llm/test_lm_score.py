import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import lm_score as L
from inkwell.llm._common import text_bytes


def tokens(text, words, pairs):
    _, word, pair, before = L.cells(*text_bytes(pa.array([text], pa.string())), words, pairs)
    return list(zip(word.tolist(), pair.tolist(), before.tolist(), strict=True))


def brute(rows, words, pairs):
    one, two = ([Counter(), Counter()] for _ in range(2))
    for _, t, side in rows:
        for w, p, _ in tokens(t, words, pairs):
            one[bool(side)][w] += 1
            if p >= 0:
                two[bool(side)][p] += 1
    size = [sum(c.values()) for c in one]
    scale = [size[1] / size[0] if all(size) else 1, 1]
    out = []
    for i, t, own in rows:
        mine = tokens(t, words, pairs)
        a, b = Counter(w for w, _, _ in mine), Counter(p for _, p, _ in mine)
        loss = [0.0, 0.0]
        for s in (0, 1):
            less = scale[s] * (bool(own) == s)
            for w, p, v in mine:
                q = (one[s][w] * scale[s] - less * a[w] + 1) / (size[s] * scale[s] - less * len(mine) + 2**words)
                if p >= 0:
                    given = max(one[s][v] * scale[s] - less * a[v], 0)
                    both = min(max(two[s][p] * scale[s] - less * b[p], 0), given)
                    q = (both + L.PRIOR * q) / (given + L.PRIOR)
                loss[s] -= np.log2(q) / len(mine)
        out.append((str(i), len(mine), loss[1], loss[0]))
    return sorted(out)


def test_cells_grow_with_the_corpus():
    sizes = [L.bits_for(n) for n in (0, 1 << 27, 1 << 29, 1 << 31, 1 << 41)]
    assert sizes == [(16, 20), (16, 20), (17, 21), (18, 22), (23, 27)]


def test_query_equals_brute_force(spark):
    from inkwell.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    rows = [(r.doc_id, r.text, r.doc_id in good) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(x.doc_id), x.n_tokens, x.target_loss, x.background_loss, x.score) for x in QUERIES["op3_cross_entropy"](spark, sf).collect())
    want = brute(rows, 16, 20)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:4] for g in got], [w[2:] for w in want], rtol=1e-4, atol=1e-4) and np.allclose([g[4] for g in got], [w[2] - w[3] for w in want], atol=1e-3)


def test_one_huge_word_and_chunks(spark, monkeypatch):
    rows = [(1, "x" * 300_000, True), (2, "a b " * 20_000, False), (3, "b a", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    monkeypatch.setattr(L, "CHUNK", 1)
    got = sorted((str(x.doc_id), x.n_tokens, x.target_loss, x.background_loss) for x in L.cross_entropy_difference(df, 6, 8).collect())
    assert np.allclose([g[1:] for g in got], [w[1:] for w in brute(rows, 6, 8)], rtol=1e-4, atol=1e-4)


def test_equals_brute_force(spark):
    r = random.Random(6)
    mode = [["the", "cat", "sat", "É1"], ["buy", "now", "the", "x9"]]
    rows = [(i, " ".join(r.choice(mode[i % 2]) for _ in range(r.randint(0, 30))), i % 2 == 0 if i % 7 else None) for i in range(120)]
    rows += [(None, None, True), (500, "", False), (501, "...", True), (3, rows[3][1], rows[3][2]), (502, "cat sat " * 5000, True)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, target boolean, score double")
    for words, pairs in ((16, 20), (6, 8)):
        got = sorted((str(x.doc_id), x.n_tokens, x.target_loss, x.background_loss) for x in L.cross_entropy_difference(df, words, pairs).collect())
        want = brute(rows, words, pairs)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-4, atol=1e-4)
    scores = {x.doc_id: x.score for x in L.cross_entropy_difference(df).collect() if x.n_tokens > 5}
    assert np.mean([s for i, s in scores.items() if i % 2 == 0 and i < 500]) < np.mean([s for i, s in scores.items() if i % 2])
    assert L.cross_entropy_difference(df.limit(0)).count() == 0
