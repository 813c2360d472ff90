import pytest

from inkwell.operators import answer, embed, evaluate, guard, retrieve, wiki
from inkwell.operators.ingest import EmptyRegistry, after_change, ingest, protect, remask
from inkwell.operators.store import TABLES, Store
from inkwell.streaming.ingest import mask_answers, watch

KEY = b"k" * 32
CALLS: list[int] = []


class Counting(embed.HashedWords):
    def embed(self, texts):
        CALLS.append(len(texts))
        return super().embed(texts)


@pytest.fixture()
def registry():
    r = guard.Registry()
    r.add("Contoso SE", aliases=("contoso.com",))
    return r


def source(spark, **texts):
    return spark.createDataFrame([(f"f/{n}.md", f"{n}.md", bytearray(t.encode())) for n, t in texts.items()], "source_key string, filename string, content binary")


def outcomes(df):
    return {r.filename: r.outcome for r in df.collect()}


def test_life_of_a_corpus(spark, tmp_path, registry):
    store = Store(spark, f"file://{tmp_path}/store")
    texts = {"a": "# Plan\n\nContoso starts the cutover at nine.", "b": "# Other\n\nThe rollback is decided at noon by jane@contoso.com."}
    with pytest.raises(EmptyRegistry):
        ingest(store, source(spark, **texts), guard.Registry(), KEY, embed.HashedWords)
    assert outcomes(ingest(store, source(spark, **texts), registry, KEY, embed.HashedWords)) == {"a.md": "ingested", "b.md": "ingested"}
    state = store.status()
    assert (state["documents"], state["chunks"], state["embedded"]) == (2, 2, {"hashed-words": 2})
    everything = " ".join(r.embed_text for r in store.read("chunks").collect())
    assert "CLIENT_A starts" in everything and "[PERSON_EMAIL]" in everything and "ontoso" not in everything
    # nothing to do, a copy under another name, and an edit
    version = store.status()["version"]
    again = outcomes(ingest(store, source(spark, **texts, copy=texts["a"]), registry, KEY, embed.HashedWords))
    assert again == {"a.md": "unchanged", "b.md": "unchanged", "copy.md": "duplicate"}
    vectors = {r.chunk_id: list(r.vector) for r in store.read("vectors").collect()}
    texts["b"] += "\n\n# New\n\nMore."
    assert outcomes(ingest(store, source(spark, **texts), registry, KEY, embed.HashedWords))["b.md"] == "ingested"
    assert store.status()["chunks"] == 3 and store.status()["version"] > version
    kept = {r.chunk_id: list(r.vector) for r in store.read("vectors").collect()}
    assert len(set(kept) & set(vectors)) == 2 and all(kept[c] == vectors[c] for c in set(kept) & set(vectors))
    # a failed file is a row
    assert outcomes(ingest(store, spark.createDataFrame([("x.pdf", "x.pdf", bytearray(b"no"))], "source_key string, filename string, content binary"), registry, KEY, embed.HashedWords)) == {"x.pdf": "failed"}
    # a registry change makes documents stale
    registry.add("rollback", "other")
    assert store.stale(registry).count() == 3
    assert remask(store, registry, KEY, embed.HashedWords) == 3 and store.stale(registry).count() == 0
    assert any("REF_01 is decided" in r.text for r in store.read("chunks").collect())
    # a second model beside the first
    other = lambda: embed.HashedWords(32, "small:latest")
    with pytest.raises(ValueError):
        store.activate("small")
    store.embed_missing(other, "small")
    store.activate("small")
    assert store.status()["embedded"] == {"hashed-words": 3, "small": 3}
    store.prune()
    assert store.status()["embedded"] == {"small": 3}
    assert store.reindex(lambda df: df).count() == 3
    # backup, wipe, restore
    before = {n: store.read(n).count() for n in TABLES}
    store.backup(f"file://{tmp_path}/backup")
    store.wipe()
    assert store.status()["chunks"] == 0
    store.restore(f"file://{tmp_path}/backup")
    assert {n: store.read(n).count() for n in TABLES} == before
    with pytest.raises(ValueError):
        store.restore(f"file://{tmp_path}/backup")
    store.delete([store.read("documents").where("filename = 'a.md'").first().doc_id])
    assert store.read("documents").count() == 2


def test_a_commit_writes_what_changed(spark, tmp_path, registry):
    store = Store(spark, f"file://{tmp_path}/store")
    texts = {f"d{i}": f"# Topic {i}\n\nWords about area {i}." for i in range(5)}
    ingest(store, source(spark, **texts), registry, KEY, embed.HashedWords)
    before = store.state()["tables"]
    ingest(store, source(spark, **texts | {"d3": "# Topic 3\n\nOther words."}), registry, KEY, embed.HashedWords)
    after = store.state()["tables"]
    for name in ("documents", "chunks", "vectors", "sources", "jobs"):
        assert after[name][:-1] == before[name]
        assert spark.read.parquet(f"file://{tmp_path}/store/{name}/{after[name][-1]['rows']}").count() == 1
        assert store.read(name).count() == 5
    assert "Other words." in {r.text.split("\n")[-1] for r in store.read("chunks").collect()}
    # nothing to do writes no part
    ingest(store, source(spark, **texts), registry, KEY, embed.HashedWords)
    state = store.state()
    ingest(store, source(spark, **texts), registry, KEY, embed.HashedWords)
    assert store.state() == state
    assert not (tmp_path / "store/staging").exists() or not any((tmp_path / "store/staging").iterdir())
    assert store.vacuum() == 0
    rows = sorted(r.text for r in store.read("chunks").collect())
    assert store.vacuum(hours=-1) > 0 and sorted(r.text for r in store.read("chunks").collect()) == rows


def test_parts_are_merged_by_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("inkwell.operators.store.FAN", 3)
    store = Store(spark, f"file://{tmp_path}/store")
    want: dict = {}
    job = "doc_id string, stage string"
    for i in range(14):
        new = {f"k{i % 5}": f"s{i}", f"k{(i * 3) % 7}": f"t{i}"}
        gone = [*new, "k6"] if i % 4 == 3 else list(new)
        store.commit(add={"jobs": spark.createDataFrame(list(new.items()), job)}, gone=spark.createDataFrame([(k,) for k in gone], "doc_id string"))
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert {r.doc_id: r.stage for r in store.read("jobs").collect()} == want
    assert [p["level"] for p in store.state()["tables"]["jobs"]] == [2, 1, 0, 0]


def test_embedding_resumes(spark, tmp_path, registry):
    store = Store(spark, f"file://{tmp_path}/store")
    texts = {f"d{i}": f"# Topic {i}\n\nWords about area {i}." for i in range(12)}
    done = tmp_path / "done"
    done.mkdir()

    class Dying(embed.HashedWords):
        """Records each text; dies with an error that is not tried again once seven have been made."""

        def __init__(self, most=7):
            super().__init__()
            self.most = most

        def embed(self, given):
            import uuid

            for _ in given:
                if len(list(done.iterdir())) >= self.most:
                    raise embed.Fatal("down")
                (done / uuid.uuid4().hex).touch()
            return super().embed(given)

    with pytest.raises(Exception, match="down"):
        ingest(store, source(spark, **texts), registry, KEY, Dying, size=3)
    kept = store.read("pending").count()
    assert 0 < kept <= 7 and store.read("documents").count() == 0
    already = len(list(done.iterdir()))
    ingest(store, source(spark, **texts), registry, KEY, lambda: Dying(10**6), size=3)
    assert len(list(done.iterdir())) - already == 12 - kept
    assert (store.read("vectors").count(), store.read("documents").count(), store.read("pending").count()) == (12, 12, 0)


def test_review_protects_a_name(spark, tmp_path, registry):
    store = Store(spark, f"file://{tmp_path}/store")
    assert after_change(store, registry, KEY, embed.HashedWords) is None
    ingest(store, source(spark, a="# A\n\nFabrikam Ltd sells.", b="# B\n\nNothing here."), registry, KEY, embed.HashedWords)
    assert [r.surface for r in store.read("occurrences").where("status = 'candidate'").collect()] == ["Fabrikam Ltd"]
    assert protect(store, registry, "Fabrikam Ltd", KEY, embed.HashedWords) == 2
    assert any("CLIENT_B sells" in r.text for r in store.read("chunks").collect()) and store.read("occurrences").where("status = 'candidate'").count() == 0

    def broken():
        raise RuntimeError("no model")

    registry.add("Nothing", "other")
    with pytest.warns(UserWarning, match="no model"):
        assert after_change(store, registry, KEY, broken) is None
    assert store.stale(registry).count() == 2


def test_retrieve_and_ask(spark, tmp_path, registry):
    store = Store(spark, f"file://{tmp_path}/store")
    texts = {f"d{i}": f"# Topic {i}\n\nFiller words about area {i}." for i in range(6)} | {"cut": "# Cutover\n\nContoso starts the cutover window at nine on Sunday."}
    ingest(store, source(spark, **texts), registry, KEY, embed.HashedWords)
    m, e = registry.matcher(), embed.HashedWords()
    args = (store.read("chunks"), store.read("vectors"), store.read("documents"))
    one = retrieve.retrieve(*args, "When does Contoso start the cutover window?", e, m, k=3).collect()
    two = retrieve.retrieve(*args, "When does CLIENT_A start the cutover window?", e, m, k=3).collect()
    assert [r.chunk_id for r in one] == [r.chunk_id for r in two] and one[0].doc_title == "Cutover" and one[0]["rank"] == 1

    def broken(*_):
        raise RuntimeError("down")

    with pytest.warns(UserWarning):
        same = retrieve.retrieve(*args, "cutover window", e, m, k=3, mode="dense", ann=broken).collect()
    assert [r.chunk_id for r in same] == [r.chunk_id for r in retrieve.retrieve(*args, "cutover window", e, m, k=3, mode="exact").collect()]
    assert retrieve.retrieve(*args, "cutover", e, m, conditions={"space": "none"}).count() == 0
    got = answer.ask(retrieve.retrieve(*args, "When does Contoso start the cutover window?", e, m), "When does Contoso start the cutover window?", answer.Extractive(), m)
    assert not got.refused and "nine on Sunday" in got.answer and got.citations[0]["cited"] and "CLIENT_A" in got.question
    empty = answer.ask(retrieve.retrieve(*args, "x", e, m, conditions={"space": "none"}), "x", answer.Extractive(), m)
    assert empty.refused and empty.answer == answer.NOT_FOUND


def test_embedder_retries():
    class Flaky(embed.HashedWords):
        left = 2

        def embed(self, texts):
            if self.left:
                self.left -= 1
                raise OSError
            return super().embed(texts)

    waits: list[float] = []
    assert len(embed.embed_all(Flaky(), ["a"] * 20, waits.append)) == 20 and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        embed.embed_all(type("Down", (Flaky,), {"left": 99})(), ["a"], waits.append)


def test_citations(spark):
    rows = ["see [1] and [3, 5–6]", "[2-1] [9] none", "[1][1] [0]", "plain"]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    assert [list(r[0]) for r in df.select(answer.citations("a", 5)).collect()] == [answer.cited_numbers(r, 5) for r in rows] == [[1, 3, 5], [], [1], []]
    assert answer.is_refusal(f'"{answer.NOT_FOUND}"') and not answer.is_refusal("It is found.")


def test_masking_stream(registry):
    m = registry.matcher()
    text = "The plan of Contoso SE is to write jane@contoso.com about contoso.com and more words after it, " * 3
    for n in (1, 2, 7, 1000):
        stream = answer.MaskingStream(m)
        parts = [stream.push(text[i : i + n]) for i in range(0, len(text), n)] + [stream.close()]
        assert "".join(parts) == m.mask(text) and stream.replaced
        seen = ""
        for p in parts:
            seen += p
            assert "ontoso" not in seen


def test_streams(spark, tmp_path, registry):
    store = Store(spark, f"file://{tmp_path}/store")
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.md").write_text("# A\n\nContoso text.")
    for _ in range(2):
        watch(spark, str(drop), store, lambda: registry, KEY, embed.HashedWords, str(tmp_path / "ck"), once=True).awaitTermination()
    assert store.status()["documents"] == 1
    deltas = tmp_path / "deltas"
    schema = "answer_id string, n long, delta string, last boolean"
    spark.createDataFrame([("x", 0, "We asked Con", False), ("y", 0, "Nothing here.", True)], schema).coalesce(1).write.parquet(str(deltas))
    out = mask_answers(spark.readStream.schema(schema).parquet(str(deltas)), registry.matcher())
    q = out.writeStream.format("memory").queryName("masked").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    spark.createDataFrame([("x", 1, "toso SE today.", True)], schema).coalesce(1).write.mode("append").parquet(str(deltas))
    q.processAllAvailable()
    q.stop()
    got: dict = {}
    for r in spark.table("masked").collect():
        got[r.answer_id] = got.get(r.answer_id, "") + r.text
    assert got == {"x": "We asked CLIENT_A today.", "y": "Nothing here."}


def test_metrics(spark, tmp_path):
    path = tmp_path / "golden.jsonl"
    path.write_text('// note\n{"id": "q1", "question": "x", "expect": [{"doc": "plan", "section": "scope", "page": 2}]}\n\n{"id": "q2", "question": "y", "type": "refuse"}\n')
    items = evaluate.load_golden(spark, str(path))
    assert {r.id: r.type for r in items.collect()} == {"q1": "answer", "q2": "refuse"}
    path.write_text("{bad\n")
    with pytest.raises(ValueError):
        evaluate.load_golden(spark, str(path))
    hit = spark.createDataFrame([([("plan", "scope", 2)], "The Plan.docx", "T", ["A", "Scope"], "text", 1, 3)], "e array<struct<doc: string, section: string, page: int>>, f string, t string, h array<string>, x string, a int, b int")
    from pyspark.sql import functions as F

    assert hit.select(evaluate.relevant(*[F.col(c) for c in "efthxab"])).first()[0]
    assert evaluate.groundedness("The cutover starts at nine [1]. Cats like purple boxes [2].", {1: "cutover starts nine sunday", 2: "dogs"}) == (2, 1)
    rows = [("answer", False, False, 2, 1, 1, 2, 2, 1, 10), ("answer", True, True, 0, 0, 0, 0, 0, 0, 30), ("refuse", True, False, 0, 0, 0, 0, 0, 0, 20)]
    got = evaluate.answer_metrics(spark.createDataFrame(rows, "type string, refused boolean, uncited boolean, cited int, cited_relevant int, must_found int, must_total int, checked int, grounded int, total_ms int")).first()
    assert (got.refusal_accuracy, got.false_refusal_rate, got.must_contain_all, got.must_contain_share, got.citation_accuracy, got.groundedness, got.uncited_rate, got.total_ms_p50, got.total_ms_p95) == (1.0, 0.5, 0.0, 0.5, 0.5, 0.5, 0.0, 20, 30)
    assert "config\tn" in evaluate.as_tsv(evaluate.run_matrix({"a": {"x": 1}}, lambda x: spark.createDataFrame([(x,)], "n int")))


def test_wiki(spark):
    pages = spark.createDataFrame([], wiki.PAGE)
    new = spark.createDataFrame([("release", "B", "<p>to [[a]]</p>"), ("release", "A", "<p>x</p>")], "space string, title string, body_html string")
    pages = wiki.create(pages, new, "2026-01-01 00:00:00").cache()
    assert [(r.id, r.title, r.body_text, r.status) for r in wiki.tree(pages, "deployment").collect()] == [(1, "A", "x", "draft"), (2, "B", "to [[a]]", "draft")]
    links = wiki.links(pages)
    tags = wiki.add_tags(spark.createDataFrame([(1, "t")], "page_id long, name string"), spark.createDataFrame([(1, "t"), (1, "u")], "page_id long, name string"))
    got = wiki.get(pages, tags, links, spark.createDataFrame([], "page_id long, surface string"), 1)
    assert got["tags"] == ["t", "u"] and got["backlinks"] == [{"src_page_id": 2, "title": "B"}] and wiki.get(pages, tags, links, links.withColumnRenamed("src_page_id", "page_id"), 9) is None
    patch = spark.createDataFrame([(1, "A2", None)], "id long, title string, owner string")
    after, revisions = wiki.update(pages, spark.createDataFrame([], wiki.REVISION), patch, "2026-01-02 00:00:00")
    assert {r.id: (r.title, r.updated_at[:10]) for r in after.collect()} == {1: ("A2", "2026-01-02"), 2: ("B", "2026-01-01")}
    assert [(r.page_id, r.title) for r in wiki.revisions_of(revisions, 1).collect()] == [(1, "A")]
    from pyspark.sql import functions as F

    nested = pages.withColumn("parent_id", F.when(F.col("id") == 2, F.lit(1)))
    moved = {r.id: (r.space, r.parent_id) for r in wiki.move(nested, 1, "ops").collect()}
    assert moved == {1: ("ops", None), 2: ("ops", 1)}
    gone = wiki.remove({"pages": nested, "tags": tags, "links": links}, 1)
    assert [(r.id, r.parent_id) for r in gone["pages"].collect()] == [(2, None)] and gone["tags"].count() == 0 and gone["links"].first().dst_page_id is None
    merged, more = wiki.merge_space(moved_pages := wiki.move(pages, 2, "ops"), tags, "ops", "release")
    assert {r.id: (r.space, r.position) for r in merged.collect()} == {1: ("release", 0), 2: ("release", 1)} and more.where("name = 'ops'").count() == 1 and moved_pages.count() == 2
    seeded = wiki.seed(pages, spark.createDataFrame([("release", "Runbook", "<p>r</p>", "Internal")], "space string, title string, body_html string, sensitivity string"), "2026-01-03 00:00:00")
    assert seeded.count() == 3 and wiki.seed(seeded, seeded.where("title = 'Runbook'").select("space", "title", "body_html", "sensitivity"), "x").count() == 3
    assert wiki.migrate({"n": 0}, [1], {1: lambda t: {"n": 9}, 2: lambda t: {"n": t["n"] + 1}}) == ({"n": 1}, [1, 2])
    assert {r.key: r.value for r in wiki.set_setting(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), "a", "3").collect()} == {"a": "3", "b": "2"}


def test_sinks_and_runs(spark, tmp_path, registry):
    from inkwell.operators import sinks

    m = registry.matcher()
    pages = sinks.import_pages(spark.createDataFrame([], wiki.PAGE), source(spark, a="# Contoso plan\n\nText by Contoso.").select("filename", "content"), "release", "2026-01-01 00:00:00").cache()
    row = pages.first()
    assert row.title == "Contoso plan" and row.body_text.split() == "Contoso plan Text by Contoso.".split() and row.type == "source-capture"
    sinks.export_html(pages, m, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).first()[0]
    assert "<title>CLIENT_A plan</title>" in text and "ontoso" not in text
    from pyspark.sql import functions as F

    with pytest.raises(sinks.Closed):
        sinks.masked_html(pages.withColumn("sensitivity", F.lit("Restricted")), m)
    events = sinks.audit(spark.createDataFrame([("1", "a", "x")], "ts string, action string, detail string"), "page.export", "CLIENT_A plan", "2")
    assert [r.action for r in sinks.tail(events, 1).collect()] == ["page.export"]
    store = Store(spark, f"file://{tmp_path}/store")
    ingest(store, source(spark, cut="# Cutover\n\nThe cutover window starts at nine on Sunday."), registry, KEY, embed.HashedWords)
    (tmp_path / "g.jsonl").write_text('{"id": "q1", "question": "When does the cutover window start?", "expect": [{"doc": "cutover"}], "must_contain": ["nine"]}\n{"id": "q2", "question": "Who is the king of France?", "type": "refuse"}\n')
    find = lambda q, k: retrieve.retrieve(store.read("chunks"), store.read("vectors"), store.read("documents"), q, embed.HashedWords(), m, k)
    results, found, said = evaluate.run(evaluate.load_golden(spark, str(tmp_path / "g.jsonl")), find, lambda hits, q: answer.ask(hits, q, answer.Extractive(), m))
    assert found.first().recall_at_5 == 1.0 and found.first().mrr_at_10 == 1.0
    assert (said.first().refusal_accuracy, said.first().false_refusal_rate, said.first().must_contain_all, said.first().citation_accuracy) == (1.0, 0.0, 1.0, 1.0)
    sinks.write_results(said, results, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/results")).count() == 2
