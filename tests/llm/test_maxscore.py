import numpy as np

from inkwell.llm import maxscore as M


def brute(rows, queries, k):
    out = []
    for qi, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), i) for i, x in rows if i != qi)[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_equals_brute_force(spark):
    r = np.random.default_rng(3)
    vecs = r.normal(size=(700, 12)) * (r.random((700, 12)) < 0.6)
    vecs[100:120] = vecs[5]
    vecs[200:210] = 0
    rows = [(i, [float(v) for v in x], "n") for i, x in enumerate(vecs)] + [(900, None, "n"), (950, [1.0, None], "n"), (951, [float("nan")] * 12, "n"), (1000, [float("inf")] * 12, "n"), (None, [1.0] * 12, "n"), (1050, [0.5], "n"), (1051, [], "n"), (7, [0.25] * 12, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    q = M.quantised(df)
    ints = [(x.vec_id, list(x.x)) for x in q.collect()]
    assert len(ints) == 700 + 3
    want = brute(ints, [x for x in ints if x[0] % 50 == 0], 5)
    for block, size in ((4096, 4096), (3, 100)):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in M.top_k(q, q.where("vec_id % 50 = 0"), block=block, size=size).collect())
        assert got == want
    assert M.top_k(q.limit(0), q.limit(0)).count() == 0
    assert M.top_k(q.where("vec_id in (0, 1, 2)"), q.where("vec_id = 0")).count() == 2


def test_pruning_keeps_ties():
    x = np.array([[3, 0], [3, 1], [3, 0], [0, 9], [-1, 9]] * 40)
    shard = M.Shard(np.arange(200)[::-1].copy(), x)
    best = shard.search(-1, np.array([5, 1]), 3, [])
    assert best == sorted((-int(s), int(i)) for s, i in zip(x @ np.array([5, 1]), shard.ids, strict=True))[:3]
