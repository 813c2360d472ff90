import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and P.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def base(text):
    return [s for s in P.find_spans(text) if s[0] in P.BASE]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789 .-+@()a_%Zé\n", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "+1 (988) 555-2485", "x.y@b.co", "token = "]), max_size=40).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


def test_added_kinds():
    t = 'token = "1beb58b8af68854f" password=b7db7aa4 IBAN: GB82 WEST 1234 5698 7654 32, ftp://joe:pw@host.example/x https://plain.example token: none'
    assert [(k, t[a:b]) for k, a, b in P.find_spans(t) if k not in P.BASE] == [
        ("secret", "1beb58b8af68854f"), ("secret", "b7db7aa4"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("url", "ftp://joe:pw@host.example/x")]
    assert P.masked("a x@y.zz b 1.2.3.4", P.find_spans("a x@y.zz b 1.2.3.4")) == "a [EMAIL] b [IP]"


def test_tables(spark):
    rows = [(1, "mail a@b.cc", 11, "s"), (1, "mail a@b.cc", 11, "s"), (None, None, None, None), (3, "", 0, "s"), (4, "é " * 40000 + "+1 (988) 555-2485", 80017, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = P.find_pii(df).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in got) == [("1", [("email", 5, 11)])] * 2 + [("3", []), ("4", [("phone", 80000, 80017)]), ("None", [])]
    out = P.mask_pii(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text and r.text[-7:], r.n_chars) for r in out.collect()) == [("1", "[EMAIL]", 12)] * 2 + [("3", "", 0), ("4", "[PHONE]", 80007), ("None", None, None)]
    assert P.find_pii(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    import hashlib

    rows = [(1, "mail a@b.cc and 1.2.3.4, +1 (988) 555-2485 4111111111111111"), (2, None), (3, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in P.op9_pii(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = brute(t or "")
        assert [got[i][f"n_{k}"] for k in P.BASE] == [sum(s[0] == k for s in want) for k in P.BASE]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
