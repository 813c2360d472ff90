import random
from itertools import combinations

import corpus_pipeline as C
import numpy as np
from inkwell.llm import near_copies as N


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b], links = a, links + 1
    return {i: find(i) for i in sets}, links


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words))
        words[at : at + 1] = r.choice([[], ["edit"], [words[at], "more"]])
    return " ".join(words)


def corpus():
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    rows, line = [], text(12)
    for _ in range(60):
        base = text(r.choice([4, 20, 60, 200, 500]))
        rows += [edited(r, base, len(base) * k // 200) for k in range(6)]
    base = text(120)
    rows += [edited(r, base, k % 4) for k in range(150)]  # a group over FEW
    rows += [" ".join(line + text(r.randint(1, 60))) for _ in range(150)] + [" ".join(line)] * 3 + [None, "", " \n"]
    return list(enumerate(rows))


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    want, links = brute(rows)
    assert links > 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in N.near_copy_groups(df).collect()} == want
    for name, value in (("FREQUENT", 1 << 40), ("CHUNK", 32), ("PIVOTS", 1), ("FEW", 8), ("BROADCAST", 0)):  # any order and any division is right
        monkeypatch.setattr(N, name, value)
    assert {x.doc_id: x.component_id for x in N.near_copy_groups(df).collect()} == want


def test_stage_keeps_one_of_edited_copies(spark):
    rows = corpus()
    want, _ = brute(rows)
    df = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string")
    assert {x.doc_id for x in C.near_duplicates(spark, df, "").collect()} == {*want.values(), None}


def test_texts_of_one_id_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "q r s t u v", "y"), (1, "a b c d e f", "z"), (2, "A B c d e f", "x"), (3, "q r s t u v", "x"), (0, "g h i j k", "x")]
    kept = N.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == [(0, "g h i j k"), (1, "a b c d e f"), (1, "q r s t u v")]


def test_rows_without_an_id_are_copies_too(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " more"), (7, text), (None, "q r s t u v"), (None, "q r s t u v"), (None, "g h i j k"), (8, None), (None, "")]
    kept = N.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=str) == [(7, text), (8, None), (None, "g h i j k"), (None, "q r s t u v")]
    rows = [("k", None), (None, "k")]  # a missing id is not a missing text
    assert N.keep_one_copy(spark.createDataFrame(rows, "doc_id string, text string")).count() == 2


def test_empty(spark):
    assert N.near_copy_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_travel_for_pairs_that_can_be_similar(spark, monkeypatch):
    """Texts that share a passage are candidates of each other; only those that bitmaps leave are verified on texts."""
    r = random.Random(6)
    line = [f"line{k}" for k in range(12)]
    rows = [" ".join([*line, *(f"w{r.randrange(10**6)}" for _ in range(n))]) for n in (60, 90, 700) for _ in range(25)]
    rows = list(enumerate([*rows, rows[0] + " more", rows[-1] + " more"]))
    seen = []
    keep = N.written
    monkeypatch.setattr(N, "written", lambda df, name: (out := keep(df, name), seen.append((name, out.count())))[0])
    monkeypatch.setattr(N, "FREQUENT", 1 << 40)
    want, links = brute(rows)
    assert links == 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in N.near_copy_groups(df).collect()} == want
    assert sum(n for name, n in seen if name == "candidates") == 2
    assert sum(n for name, n in seen if name == "candidate_texts") == 4


def test_bitmaps_rule_out_no_similar_pair():
    r = np.random.default_rng(3)
    for n in (0, 1, 9, 400, 512, 513, 3000, 20000):
        pool = np.unique(r.integers(0, 1 << 63, 2 * n + 2).astype(np.uint64))
        pool = r.permutation(pool)
        for same in {0, n // 2, n * 8 // 9, n * 9 // 10, n}:
            for more in {0, (n - same) // 2, n - same}:
                a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:same], pool[n : n + more])))
                x, y = (np.frombuffer(N.bitmap(s), np.uint8)[None] for s in (a, b))
                size = min(x.shape[1], y.shape[1])
                for w in {size, N.SHORT}:
                    differing = int(np.bitwise_count(N.folded(x, w) ^ N.folded(y, w)).sum())
                    assert differing <= len(np.setxor1d(a, b))
                    assert N._within(differing, len(a) + len(b)) or not N.similar(a, b)
                assert 8 * x.shape[1] >= n
