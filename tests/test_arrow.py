import pyarrow as pa

from inkwell.functions import arrow
from inkwell.operators import chunker


def test_slices_are_short_and_lose_nothing():
    short = pa.RecordBatch.from_pydict({"x": [str(i) for i in range(10_000)]})
    parts = list(arrow.slices([short, short.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= arrow.ROWS
    assert [x for p in parts for x in p.column(0).to_pylist()] == short.column(0).to_pylist()
    long = pa.RecordBatch.from_pydict({"x": ["a" * 3_000_000, None, "b"]})
    assert [p.num_rows for p in arrow.slices([long])] == [2, 1]


def test_rows_of_a_large_batch_reach_python_in_slices(spark):
    docs = spark.range(0, 2000, 1, 1).selectExpr("if(id = 5, null, id) doc_id", "'T' title", "concat('text ', id) text")
    seen = arrow.map_rows(docs, ["text"], lambda rows: [{"n": len(rows), "same": r["text"]} for r in rows], "n int, same string", ["doc_id"]).collect()
    assert max(r.n for r in seen) <= arrow.ROWS
    assert [(r.doc_id, r.same) for r in seen] == [(None if i == 5 else i, f"text {i}") for i in range(2000)]
    rows = chunker.chunk_documents(docs.select("doc_id", "title", chunker.text_blocks("text").alias("blocks"))).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(None if i == 5 else i, f"text {i}") for i in range(2000)]
