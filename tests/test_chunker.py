from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.functions.text import estimate
from inkwell.operators import chunker as C


def b(kind, text, path=(), page=None):
    return {"type": kind, "text": text, "level": None, "heading_path": list(path), "page": page}


def test_prose():
    text = " ".join(f"Sentence number {i} says something about the release." for i in range(120))
    out = C.chunk_blocks([b("paragraph", text, ["A"], 3)], "Doc")
    assert len(out) > 3 and all(c["token_estimate"] <= 450 for c in out)
    for i in range(120):
        assert any(f"number {i} says" in c["text"] for c in out)
    assert all(0 < c["overlap_tokens"] <= 67 for c in out[1:])
    assert out[0]["embed_text"].startswith("Doc › A\n\n") and out[0]["page_start"] == out[0]["page_end"] == 3


def test_tables_repeat_their_head():
    table = "\n".join(["Step | Owner"] + [f"Do thing {i} | Team {i}" for i in range(150)])
    out = C.chunk_blocks([b("table", table)])
    assert len(out) > 1 and all(c["text"].startswith("Step | Owner\n") and c["overlap_tokens"] == 0 for c in out)
    assert sorted(r for c in out for r in c["text"].split("\n")[1:]) == sorted(table.split("\n")[1:])


def test_lists_and_long_words():
    lines = [f"- item {i} of the list" for i in range(200)]
    out = C.chunk_blocks([b("list", "\n".join(lines))])
    assert all(any(line in c["text"].split("\n") for c in out) for line in lines)
    word = "x" * 5000
    assert "".join(c["text"] for c in C.chunk_blocks([b("paragraph", word)])) == word
    run_on = " ".join(f"word{i}" for i in range(3000))
    assert " ".join(c["text"] for c in C.chunk_blocks([b("paragraph", run_on)])).split() == run_on.split()


def test_sections_and_crumbs():
    blocks = [b("heading", "T", ["T"]), b("paragraph", "One.", ["T"]), b("heading", "S", ["T", "S"]), b("paragraph", "Two.", ["T", "S"]), b("paragraph", "Three.", ["T", "S"])]
    out = C.chunk_blocks(blocks, "T")
    assert [(c["heading_path"], c["text"]) for c in out] == [(["T"], "One."), (["T", "S"], "Two.\n\nThree.")]
    assert [c["embed_text"].split("\n")[0] for c in out] == ["T", "T › S"]


def test_merge():
    blocks = [b("paragraph", f"Short text {i}.", ["Top", f"Step {i}"]) for i in range(6)] + [b("paragraph", "Alone.", ["Other"])]
    out = C.chunk_blocks(blocks, "D", merge=120)
    assert len(out) == 2 and out[0]["heading_path"] == ["Top"] and "Step 3\nShort text 3." in out[0]["text"]
    assert len(C.chunk_blocks(blocks, "D")) == 7


def test_edits_stay_local():
    paragraphs = [" ".join(f"Part {i} has sentence {j}." for j in range(40)) for i in range(12)]
    old = C.chunk_blocks([b("paragraph", p, [f"H{i}"]) for i, p in enumerate(paragraphs)])
    paragraphs[5] += " More."
    new = C.chunk_blocks([b("paragraph", p, [f"H{i}"]) for i, p in enumerate(paragraphs)])
    changed = {c["chunk_sha256"] for c in new} - {c["chunk_sha256"] for c in old}
    assert 0 < len(changed) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab. \nÜ9", min_size=1, max_size=400), max_size=5), st.integers(20, 80))
def test_no_chunk_is_over_the_target(texts, target):
    out = C.chunk_blocks([b("paragraph", t) for t in texts], target=target)
    assert all(c["token_estimate"] <= target for c in out)
    assert "".join("".join(texts).split()) == "".join("".join(c["text"] for c in C.chunk_blocks([b("paragraph", t) for t in texts], target=target, overlap=0)).split())


def test_documents(spark):
    df = spark.createDataFrame([("d1", "T", "One para.\n\nTwo para."), ("d2", None, ""), ("d3", "T", None)], "doc_id string, title string, text string")
    out = C.chunk_documents(df.select("doc_id", "title", C.text_blocks("text").alias("blocks"))).collect()
    assert [(r.doc_id, r.chunk_index, r.text, r.chunker_config) for r in out] == [("d1", 0, "One para.\n\nTwo para.", "1.0.0/t450/o15/m0")]
    assert estimate("abc") == 1 and len(out[0].chunk_id) == 36
