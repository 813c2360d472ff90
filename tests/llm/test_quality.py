import random
import zlib

import numpy as np
import pyarrow as pa

from inkwell.llm import quality as Q
from inkwell.llm._common import text_bytes


def stat(texts):
    return Q.statistics(*text_bytes(pa.array(texts, pa.string())))


def test_statistics():
    x = stat(["Ab cd\nab cd.", "", None, "éé  É1", "a a a b"])
    get = lambda name: x[:, Q.FEATURES.index(name)].round(4).tolist()
    assert x.shape == (5, len(Q.FEATURES)) and np.isfinite(x).all()
    assert get("distinct_words") == [1.0, 0.0, 0.0, 1.0, 0.5]
    assert get("top_word") == [0.25, 0.0, 0.0, 0.5, 0.75]
    assert get("distinct_lines") == [1.0, 0.0, 0.0, 1.0, 1.0]
    assert get("word_upper_start") == [0.25, 0.0, 0.0, 0.0, 0.0]
    alone = np.concatenate([stat([t]) for t in ["Ab cd\nab cd.", "", "éé  É1"]])
    assert np.array_equal(alone, x[[0, 1, 3]])


def test_trees_walk_as_they_were_fitted():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    m = Q.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        raw = m.base
        for k in m.roots:
            while m.left[k] != k:
                k = m.left[k] if row[m.feature[k]] <= m.threshold[k] else m.right[k]
            raw += m.value[k]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([walk(row) for row in x[:50]], m.score(x[:50]))
    assert np.allclose(Q.fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert (Q.fit(x[:5], np.ones(5)).score(x[:3]) > 0.8).all()


def test_held_out_accuracy_and_tables(spark):
    r = random.Random(1)
    text = lambda good: " ".join(r.choice(["tree", "house", "of", "the", "Walk."]) if good else r.choice(["BUY!!", "$$$", "BUY!!"]) for _ in range(r.randint(5, 60)))
    rows = [(i, text(i % 4 > 0), "x", 0.5) for i in range(600)] + [(None, None, None, None), (601, "", None, None), (602, "w " * 99999, None, None), (3, "tree", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    out = Q.score_documents(docs, model, True).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    held = [x for x in out if x.row.doc_id is not None and x.row.doc_id < 600 and x.text != "tree" and zlib.crc32(str(x.row.doc_id).encode()) % 5 == 0]
    assert np.mean([(x.score >= 0.3) == (x.row.doc_id % 4 > 0) for x in held]) > 0.97
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() < len(rows)
    assert Q.score_documents(docs.limit(0), model).count() == 0
    assert np.allclose([x.score for x in Q.score_documents(docs.limit(3), Q.train(docs, labels.limit(0))).collect()], 0.5)
