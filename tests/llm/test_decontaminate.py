import random
import re

from pyspark.sql import functions as F

from inkwell.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window):
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for name, text in items:
            b = words(text)
            for q in {tuple(b[k : k + window]) for k in range(max(1, len(b) - window + 1))} if b else ():
                for s in range(len(w) - len(q) + 1):
                    if tuple(w[s : s + len(q)]) == q:
                        hit.update(range(s, s + len(q)))
                        found.add(name)
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def cases():
    r = random.Random(4)
    vocab = ["Ab", "é9", "x", "ÉA", "of", "THE", "q1", "日本"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "-", ", ", "_", "\n"]) for _ in range(n))
    items = [(str(i), text(r.randint(4, 20))) for i in range(15)] + [("", "of the"), ("e", "..."), ("n", None), ("3", text(9))]
    docs = [(i, text(r.randint(0, 40)) + (r.choice(items)[1] or "") + text(r.randint(0, 9))) for i in range(60)]
    return [*docs, (None, "of the"), (7, None), (8, ""), (9, "!!"), (9, "!!"), (10, "of the " * 3000)], items


def test_equals_brute_force(spark):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(int(n) if n.isdigit() else None, t) for n, t in items if n.isdigit() or n == ""], "item_id long, text string")
    items = [(n, t) for n, t in items if n.isdigit() or n == ""]
    for block in (1 << 20, 100):
        out = D.benchmark_matches(df, bench, window=5, block=block)
        got = out.select("doc_id", "n_words", D.covered_words().alias("h"), D.matched_items().alias("i"))
        assert sorted((str(x.doc_id), x.n_words, x.h, x.i) for x in got.collect()) == brute(docs, items, 5)
    assert D.benchmark_matches(df.limit(0), bench).count() == 0
    none = D.benchmark_matches(df, bench.limit(0)).agg(F.sum(F.size("matches"))).first()[0]
    assert none == 0


def test_stored_index_is_searched_again(spark):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    index = D.build_index(df)
    assert {"terms", "counts", "positions"} <= set(index.columns) and sum(len(x.doc_ids) for x in index.collect()) == len(docs)
    for window in (3, 5):
        bench = spark.createDataFrame([(n, t) for n, t in items], "item_id string, text string")
        out = D.phrase_matches(index, bench, window).select("doc_id", "n_words", D.covered_words().alias("h"), D.matched_items().alias("i"))
        assert sorted((str(x.doc_id), x.n_words, x.h, x.i) for x in out.collect()) == brute(docs, items, window)


def shortest(w, terms, slop):
    found = [(b - a, a) for a in range(len(w)) for b in range(a + 1, min(len(w), a + slop) + 1) if terms <= set(w[a:b])]
    return min(found, default=None)


def test_proximity_equals_brute_force(spark, monkeypatch):
    docs, items = cases()
    queries = [(f"q{i}", t) for i, t in enumerate(("q1 x", "of é9 THE", "日本 ab q1 x", "x", "absent x", "...", "of of"))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(D, "SHARD", 200)
    index = D.build_index(df)
    for slop in (2, 4, 9):
        want = []
        for i, t in docs:
            for name, q in queries:
                terms = set(words(q))
                if terms and (best := shortest(words(t), terms, slop)):
                    want.append((str(i), name, best[1], best[0]))
        for block in (1 << 20, 10):
            got = D.proximity_matches(index, spark.createDataFrame(queries, "item_id string, text string"), slop, block).collect()
            assert sorted((str(x.doc_id), x.item_id, x.start, x.length) for x in got) == sorted(want)


def test_leaks_are_cut_alike_however_the_benchmark_is_divided(spark):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = [sorted((str(x.doc_id), str(x.text), x.n_chars) for x in D.remove_leaks(df, bench, 5, 3, block).collect()) for block in (1 << 20, 100)]
    found = {i: n for i, _, _, n in brute([(k, t) for k, (_, t) in enumerate(docs)], items, 5)}
    assert got[0] == got[1] and len(got[0]) == sum(len(n) < 3 for n in found.values()) < len(docs)
