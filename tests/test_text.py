import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkwell.functions import ids
from inkwell.functions import text as T
from inkwell.functions.porter import stem


@pytest.mark.parametrize(
    "word,want",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_stems_equal_sqlite(spark):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, instance)")
    texts = ["Über relational nationalisations crème hopping 42nd ponies", "Deployments were rehearsed; E-ON's cutovers failing"]
    for i, t in enumerate(texts):
        con.execute("insert into t(rowid, x) values (?, ?)", (i, t))
    for i, t in enumerate(texts):
        assert [r[0] for r in con.execute("select term from v where doc = ? order by offset", (i,))] == T.tokens(t)


def test_columns(spark):
    df = spark.createDataFrame([(" a  b\n", "😀é", "x/release_notes-v2.docx", "<p>A &amp; B</p><div>C<br/>D</div>")], "a string, b string, f string, h string")
    row = df.select(T.squash("a").alias("a"), T.utf16_length("b").alias("n"), T.title_from_filename("f").alias("t"), T.html_to_text("h").alias("h"), T.escape_html(F.lit('<"&>')).alias("e"), T.round3(F.lit(0.0005)).alias("r")).first()
    assert tuple(row) == ("a b", 3, "release notes v2", "A & B\nC\nD", "&lt;&quot;&amp;&gt;", 0.001)
    est = df.select(T.token_estimate(F.lit("x" * 9), "table").alias("a"), T.token_estimate(F.lit("x" * 9)).alias("b")).first()
    assert tuple(est) == (T.estimate("x" * 9, "table"), T.estimate("x" * 9)) == (4, 3)


def test_trigrams_native_and_arrow_agree(spark):
    df = spark.createDataFrame([("München plan",), ("",), ("Cutover Plan",), ("ab",)], "t string")
    q = F.array(*[F.lit(x) for x in sorted(T.trigram_set("cutover plna"))])
    rows = df.select(T.jaccard(T.trigrams("t"), q).alias("a"), T.trigram_similarity("t", "cutover plna").alias("b")).collect()
    assert [round(r.a, 9) for r in rows] == [round(r.b, 9) for r in rows]


def test_ids(spark):
    import hashlib
    import hmac
    import uuid

    names = ["a", "doc:é:1", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    space = uuid.UUID(ids.NAMESPACE)
    assert [r[0] for r in df.select(ids.uuid5("n")).collect()] == [str(uuid.uuid5(space, n)) for n in names]
    assert [r[0] for r in df.select(ids.hmac_sha256(b"k" * 32, "n")).collect()] == [hmac.new(b"k" * 32, n.encode(), hashlib.sha256).hexdigest() for n in names]
    assert ids.chunker_config("1.0.0", 450, 0.15, 0) == "1.0.0/t450/o15/m0"
    assert ids.model_key("Org/Model.v2:latest") == "org_model_v2"
    one, two = (spark.range(1).select(ids.document_id(b"k", F.lit("s"), F.lit(x))).first()[0] for x in ("A\\b.TXT", "a/B.txt"))
    assert one == two


def test_percentile(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [[float(x) for x in range(10)]]}))
    assert tuple(df.select(T.floor_percentile(F.col("v"), 0.5), T.floor_percentile(F.col("v"), 0.95)).first()) == (5.0, 9.0)
