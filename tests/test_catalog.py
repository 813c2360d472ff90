"""Every query of the catalog gives the rows of its SQL, as DuckDB runs it."""

import os

import pytest

from inkwell.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(columns)
    value = lambda v: round(v, 5) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v
    return sorted((tuple(value(r[c]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        columns = [d[0] for d in got.description]
        want = [dict(zip(columns, r, strict=True)) for r in got.fetchall()]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(want, columns)
    else:
        assert rows


def test_text_files_of_odd_rows(spark, duck, tmp_path):
    texts = ["", None, "\n \n\n", "one\r\rtwo", "\ufeffown mark", "x\f\fy\n\n\u2003"]
    rows = [(i, t, lang) for i in (7, -7, None) for t in texts for lang in ("en", "de", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = ORACLE_SQL["text_files"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = duck.execute(sql)
    columns = [d[0] for d in got.description]
    want = [dict(zip(columns, r, strict=True)) for r in got.fetchall()]
    assert plain(QUERIES["text_files"](spark, str(tmp_path)).collect(), columns) == plain(want, columns)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
