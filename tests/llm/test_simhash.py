import random

import numpy as np
import xxhash

from inkwell.llm import simhash as S


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(ids, prints, radius=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    best: dict = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            best[root(i)] = min(best.get(root(i), ids[i]), ids[i])
    return [best.get(root(i)) for i in range(len(ids))]


def test_groups_equal_brute_force(spark):
    r = random.Random(3)
    vocab = ["É" + str(i) if i % 5 == 0 else "w" + str(i) for i in range(400)]
    texts = ["", None, " \n\t ", "one", "ONE", "one two", "a b c", "A B c"]
    base = [r.choice(vocab) for _ in range(300)]
    for _ in range(60):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(vocab)
        texts.append(" ".join(t))
    texts += [" ".join(r.choice(vocab) for _ in range(r.randint(1, 900))) for _ in range(40)]
    rows = [(i + 5, t, "x") for i, t in enumerate(texts)] + [(None, "one", "x"), (None, "alone here now", "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    want = [brute_print(t) for _, t, _ in rows]
    groups = brute_groups([x[0] for x in rows], want)
    got = S.simhash_groups(df).collect()
    assert sorted((str(g.doc_id), g.fp % (1 << 64), str(g.component_id)) for g in got) == sorted((str(x[0]), p, str(c)) for x, p, c in zip(rows, want, groups, strict=True))
    assert S.simhash_groups(df.limit(0)).count() == 0


def test_large_shards_are_cut(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(5)]
    values = {0}
    while len(values) < 400:
        v = r.choice(seeds)
        for _ in range(r.randint(0, 7)):
            v ^= 1 << r.randrange(40)
        values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for chunk in (4096, 16):
        roots = {x.node % (1 << 64): x.root % (1 << 64) for x in S.components(S.near_links(df, chunk=chunk)).collect()}
        groups = brute_groups(list(range(len(values))), values)
        named: dict = {}
        for v, g in zip(values, groups, strict=True):
            named.setdefault(g, set()).add(roots.get(v, v))
        assert all(len(x) == 1 for x in named.values())
        assert len({next(iter(x)) for x in named.values()}) == len(named)


def test_tables_cover_every_pair_within_the_radius():
    for count in (10, 10**7, 10**10):
        masks = S.tables(count, 3)
        r = random.Random(count)
        for _ in range(300):
            flip = sum(1 << b for b in r.sample(range(64), 3))
            assert any(not flip & m for m in masks)


def test_forest_search_is_exact():
    r = np.random.default_rng(1)
    values = np.unique(r.integers(0, 1 << 12, 500).astype(np.uint64))
    forest = S.Forest(values, np.zeros(len(values), np.int64))
    q, t = forest.search(values, np.zeros(len(values), np.int64), 3)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert set(zip(q.tolist(), t.tolist(), strict=True)) == want and len(q) == len(want)
