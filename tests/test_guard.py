import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.operators import guard as G
from inkwell.operators import vault


@pytest.fixture(scope="module")
def registry():
    r = G.Registry()
    r.add("Contoso SE", aliases=("contoso.com",))
    r.add("Northwind Traders")
    return r


def test_registry(registry):
    assert [e.pseudonym for e in registry.active()] == ["CLIENT_A", "CLIENT_B"]
    assert registry.add("CONTOSO se").pseudonym == "CLIENT_A" and len(registry.entities) == 2
    assert [G.letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert {"E.ON", "EON", "E ON", "E-ON"} <= set(G.variants("E.ON"))
    r = G.Registry()
    e = r.add("Old Name", "person")
    assert e.pseudonym == "PERSON_01"
    r.retire(e.id)
    assert r.active() == [] and r.add("old name").active and r.version == 3
    with pytest.raises(ValueError):
        r.add("Яндекс")
    with pytest.raises(ValueError):
        r.purge(e.id)
    r.purge(e.id, confirm=True)
    assert r.entities == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("Contoso, CONTOSO, Contoso SE and Northwind Traders met at contoso.com", "CLIENT_A, CLIENT_A, CLIENT_A and CLIENT_B met at CLIENT_A"),
        ("Ask jane.doe@contoso.com about Contoso", "Ask [PERSON_EMAIL] about CLIENT_A"),
        ("ssh build01.corp at 10.20.30.40", "ssh [HOST_INTERNAL_HOST] at [HOST_IPV4]"),
        ("Contosoville is a town", "Contosoville is a town"),
        ("bob@build.corp", "[PERSON_EMAIL]"),
        ("UTF-8 and ABC-123, id 0011N00001abcDE, accomplishments", "UTF-8 and ABC-123, id [REF_SALESFORCE_ID], accomplishments"),
        ("line\nContoso", "line\nCLIENT_A"),
        ("IBAN DE89370400440532013000, VAT: DE123456789", "IBAN [REF_IBAN], [REF_VAT]"),
    ],
)
def test_mask(registry, text, want):
    assert registry.matcher().mask(text) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Contoso", "contoso.com", "NORTHWIND TRADERS", " ", "\n", "x", "a@b.cc", ".", "-", "1.2.3.4"]), max_size=12).map("".join))
def test_nothing_leaks(text):
    r = G.Registry()
    r.add("Contoso SE", aliases=("contoso.com",))
    r.add("Northwind Traders")
    m = r.matcher()
    assert m.leaks(m.mask(text)) == []


def test_scan(registry):
    found = registry.matcher().scan("Contoso mailed x@y.zz about ABC-12 and Fabrikam Holding GmbH")
    assert [(f["layer"], f["rule"], f["confidence"], f["status"]) for f in found] == [
        ("gazetteer", None, 1.0, "confirmed"), ("pattern", "email", 0.95, "confirmed"), ("pattern", "jira-key", 0.6, "candidate"), ("pattern", "legal-entity", 0.6, "candidate")]


def test_columns(spark, registry):
    m = registry.matcher()
    df = spark.createDataFrame([(1, "at Contoso", ["x@y.zz", None], {"k": "Contoso"}, ("Northwind Traders", 3)), (2, None, None, None, None)], "id long, t string, a array<string>, m map<string,string>, s struct<u: string, n: int>")
    out = {r.id: r for r in G.mask_deep(df, m).collect()}
    assert out[1].t == "at CLIENT_A" and out[1].a == ["[PERSON_EMAIL]", None] and out[1].m == {"k": "CLIENT_A"} and tuple(out[1].s) == ("CLIENT_B", 3)
    assert out[2].t is None and out[2].a is None and out[2].s is None
    assert [r.id for r in G.leaking(df, m, "t", "a").collect()] == [1]
    with pytest.raises(G.Leak):
        G.assert_clean(df, m, "t")
    assert G.assert_clean(G.mask_deep(df, m), m, "t", "a").count() == 2
    found = G.occurrences(df.withColumnRenamed("id", "doc_id"), m, text="t")
    assert [(r.doc_id, r.surface, r.start) for r in found.collect()] == [(1, "Contoso", 3)]
    back = G.Registry.of_table(registry.table(spark))
    assert back.matcher().mask("Contoso") == "CLIENT_A"


def test_unmask_and_vault(spark, registry):
    key = vault.new_key()
    stored = vault.store(registry.table(spark), key).cache()
    names = vault.reveal(stored, key, [1, 2])
    assert G.unmask("CLIENT_A is not CLIENT_AA, nor CLIENT_B", registry, lambda e: names.get(e.id)) == "Contoso SE is not CLIENT_AA, nor Northwind Traders"
    row = stored.first()
    assert len(row.iv) == 24 and len(row.tag) == 32
    assert len(vault.passphrase_key("p", b"s" * 16)) == 32


def test_small_rows_are_scanned_by_all_cores(spark):
    from inkwell.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    plan = catalog.QUERIES["rule_hits"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [c_custkey#" in plan and plan.index("MapInArrow") < plan.index("RepartitionByExpression") and "Generate inline" not in plan


def test_occurrences_keep_their_keys(spark):
    m = G.Registry()
    m.add("Idiot SE")
    texts = ["an idiot at a@b.com", None, "", "nothing", "10.1.2.3 and idiot"]
    rows = [(None if i == 4 else i, t) for i, t in enumerate(texts)]
    got = G.occurrences(spark.createDataFrame(rows, "id long, t string"), m.matcher(), "id", "t")
    assert sorted((str(r.id), r.layer, r.entity_id, r.rule, r.surface, r.start, r.confidence, r.status) for r in got.collect()) == sorted(
        (str(i), h["layer"], h["entity_id"], h["rule"], h["surface"], h["start"], h["confidence"], h["status"]) for i, t in rows for h in m.matcher().scan(t)
    )
    assert got.schema == spark.createDataFrame([], f"id long, hits {G.OCCURRENCES}").selectExpr("id", "inline(hits)").schema
