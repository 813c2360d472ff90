import random

import corpus_pipeline as C
import pytest

from inkwell.llm import decontaminate as D
from inkwell.llm.simhash import simhash_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = [f"w{i}e" for i in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(20)) for i in range(6)]
    docs = [(i, text(r.randint(80, 200)), "en", "s", 0) for i in range(200)]
    docs += [(300 + i, docs[i][1], "en", "s", 0) for i in range(20)]
    docs += [(400, docs[50][1] + " " + docs[51][1] + " " + items[0][1], "en", "s", 0), (401, items[1][1] + " " + text(90) + " " + items[2][1], "en", "s", 0)]
    docs += [(402, text(90) + " mail me: joe@mail.example.com", "en", "s", 0), (403, None, None, None, None), (None, text(60), "en", "s", 0)]
    docs += [(500 + i, "BUY!! NOW!! $$$ " * r.randint(20, 60), "en", "s", 0) for i in range(60)]
    labels = [(i, 1, 0) for i in range(200)] + [(500 + i, 0, 0) for i in range(60)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        before = {x.doc_id: x.text for x in docs.collect()}
        docs = C.written(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = {x.doc_id: x.text for x in docs.collect()}
        if name == "quality":
            gone = set(before) - set(after)
            assert {i for i in gone if i and i >= 500} == set(range(500, 560)) and not any(i is not None and i < 403 for i in gone)
        elif name == "near_duplicates":
            groups = {x.doc_id: x.component_id for x in simhash_groups(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()}
            assert set(after) == {i for i, c in groups.items() if i is None or i == c}
        elif name == "decontaminate":
            assert set(before) - set(after) == {401}
            assert 400 in after and before[400].startswith(after[400]) and len(before[400]) - len(after[400]) > 60
            found = D.benchmark_matches(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("size(matches) > 0")
            assert found.count() == 0
            assert {i: t for i, t in before.items() if i not in (400, 401)} == {i: t for i, t in after.items() if i != 400}
        elif name == "private":
            assert after[402].endswith("mail me: [EMAIL]") and {i: t for i, t in before.items() if i != 402} == {i: t for i, t in after.items() if i != 402}
    ids = {x.doc_id for x in docs.collect()}
    packed = C.STAGES[-1][1](spark, docs, folder).collect()
    assert {x.doc_id for x in packed} == ids


def test_run(spark, folder):
    assert C.run(spark, folder).count() > 100
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontaminate", "private", "pack"]
