import random


def test_recall(spark):
    from inkwell.operators.ann import LshIndex, recall

    r = random.Random(1)

    def unit(base=None):
        v = [r.gauss(b, 0.15) for b in base] if base else [r.gauss(0, 1) for _ in range(16)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    centers = [unit() for _ in range(12)]
    rows = [(str(i), unit(centers[i % 12]), "s" if i % 2 else "t") for i in range(360)]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>, space string").cache()
    index = LshIndex(df)
    assert recall(index, df, [rows[i][1] for i in (0, 5, 9)], 10) >= 0.9
    assert {x.chunk_id for x in index.search(rows[1][1], 5, {"space": "s"}).collect()} <= {i for i, _, s in rows if s == "s"}
