import sqlite3

import pytest

from inkwell.functions import text as T
from inkwell.operators import search as S

ROWS = [
    (1, "Cutover Plan", "The cutover plan lists every release step and the rollback.", "release", "note", "Internal", "ann", "draft", "2026-01-02 10:00:00", ["go"]),
    (2, "Smoke Test Checklist", "Checks after a deployment. Releases are tested, then approved.", "release", "template", "Public", "bob", "approved", "2026-01-01 09:00:00", []),
    (3, "Vendor list", "Names of vendors in München and their plans for the cutover window", "ops", "note", "Internal", None, "draft", "2026-01-03 10:00:00", ["go", "x"]),
]
SCHEMA = "id long, title string, body_text string, space string, type string, sensitivity string, owner string, status string, updated_at string, tags array<string>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, body_text, tokenize='porter unicode61')")
    for r in ROWS:
        con.execute("insert into f(rowid, title, body_text) values (?, ?, ?)", r[:3])
    return con


def test_grammar():
    q = S.parse_query('cutover space:release Tag:"go live" x:y "two words" owner:ann owner:bob')
    assert q.text == 'cutover x:y "two words"' and q.filters == {"space": "release", "tag": "go live", "owner": "bob"}


@pytest.mark.parametrize("raw", ["plan", "release", "cutover plan", "plans OR checks", "cutover NOT vendor", '"release step"', "depl*", "title:plan", "(cutover OR smoke) AND plan", "NEAR(cutover rollback, 8)", "NEAR(cutover rollback, 2)", "munchen", "^cutover", "nothing"])
def test_keyword_search_equals_sqlite(pages, fts, raw):
    expr = raw if S.re.search(r'\b(?:AND|OR|NOT|NEAR)\b|["*^]|:', raw) else " AND ".join(f'"{w}"' for w in raw.split())
    want = fts.execute("select rowid, bm25(f) from f where f match ? order by 2, 1", (expr,)).fetchall()
    got = [(r.id, r.score) for r in S.keyword_search(pages, raw).collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, _ in want)
    if "^" not in raw and "NEAR" not in raw and "title:" not in raw and "NOT" not in raw:
        assert dict(got) == pytest.approx(dict(want))


def test_malformed(pages):
    with pytest.warns(UserWarning):
        assert S.keyword_search(pages, 'cutover AND "').count() == 0


def test_filters(pages, spark):
    assert [r.id for r in S.search(pages, "tag:go").collect()] == [3, 1]
    tags = spark.createDataFrame([(2, "z"), (2, "z")], "page_id long, name string")
    assert [r.id for r in S.search(pages, "tag:z", tags=tags).collect()] == [2]
    assert [r.id for r in S.search(pages, "after:2026-01-02 before:2026-01-03").collect()] == [1]
    assert [r.id for r in S.search(pages, "plan space:deployment", "strict").collect()] == [1]
    assert S.search(pages, "").count() == 0


def test_fuzzy_and_hybrid(pages):
    top = S.fuzzy_search(pages, "cutver plna").first()
    assert top.id == 1 and top.score > 0.8 and top["rank"] == 1
    both = S.search(pages, "cutover plan").collect()
    assert both[0].id == 1 and both[0].rrf == pytest.approx(2 / 61) and both[0].modes == ["strict", "fuzzy"]
    assert "<mark>cutover</mark>" in both[0].snippet


def test_postings(pages):
    index = S.postings(pages)
    n, dl = 3, index.select("id", "dl").distinct().agg({"dl": "avg"}).first()[0]
    got = {r.id: r.score for r in S.search_postings(index, ["cutov", "plan"], n, dl).collect()}
    want = {r.id: r.score for r in S.keyword_search(pages, "cutover plan").collect()}
    assert got == pytest.approx(want)


def test_fuzzy_score_is_made_once_a_row(spark):
    pages = spark.range(3).selectExpr("id", "concat('plan ', id) title", "'the cutover plan' body_text")
    plan = S.fuzzy_search(pages, "cutover plna", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Filter") < plan.index("ArrowEvalPython")


def test_fuzzy_score_is_that_of_sets_and_edits():
    rows = [("", ""), ("Cutover  plan", "the CUTOVER plna é9"), ("a", "---"), ("cutovr　x", "zz " * 50 + "plna"), ("élan", "ab ab ab")]
    query = "cutover plna"
    want = T.trigram_set(query)
    for title, body in rows:
        for t in (title, body):
            own = T.trigram_set(t)
            assert T.Similarity(query)(t.lower()) == (len(own & want) / len(own | want) if own else 0.0)
    some = T.Similarity(query)
    assert [some(b.lower()) for _, b in rows] == [T.Similarity(query)(b.lower()) for _, b in rows]
    assert [T.edits(a, b, 2) for a, b in (("plan", "plna"), ("plan", "plan"), ("plan", "pl"), ("plan", ""), ("abcd", "wxyz"), ("plan", "plants"))] == [2, 0, 2, 3, 3, 2]


def test_words_that_are_not_there_keep_pages_from_being_read_twice(spark):
    texts = ["Alpha beta", "alphabet soup", "beta gamma alpha", "gamma", None, "ALPHA-beta"]
    pages = spark.createDataFrame([(i, None if i == 3 else "t", t) for i, t in enumerate(texts)], "id long, title string, body_text string")
    found = lambda q, **more: {r.id for r in S.keyword_search(pages, q, stemmed=False, **more).collect()}
    assert found("alpha beta") == {0, 2, 5} and found("alpha OR gamma") == {0, 2, 3, 5} and found("alph*") == {0, 1, 2, 5}
    assert found("alpha NOT gamma") == {0, 5} and found('"alpha beta"') == {0, 5} and found("NEAR(beta alpha, 1)") == {0, 2, 5} and found("soup beta", any_term=True) == {0, 1, 2, 5}
    plan = S.keyword_search(pages, "alpha beta", stemmed=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(" in plan
