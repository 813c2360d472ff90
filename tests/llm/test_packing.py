import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import packing as P
from inkwell.llm._common import text_bytes

ODD = ["it's I'M we're they'VE 'll 'd don't rock'n'roll ''s !'s 's'", "", None, "'", "a'", "x²½ 1234 a_b", "Σας ΣΑΣ", "<|endoftext|> a", "é é", "İstanbul ß ŉ ǅ", "“q” – … €5", "a b\u0085c\x1cd\x1fe", "日本語 text", "'st 'red 'vex'llama", "re", "😀 ok", "a\n\n b\t c"]


@pytest.fixture(scope="module")
def tokens():
    return P.WordTokenizer(P.tokenizer_path())


def same(tokens, texts):
    ids, off = tokens.encode(*text_bytes(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == tokens.whole.encode(t or "", add_special_tokens=False).ids, t


def test_ids_equal_the_library(tokens):
    same(tokens, ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x260), st.sampled_from("'strevmld ’́")), max_size=40), min_size=1, max_size=5))
def test_ids_of_any_text(tokens, texts):
    same(tokens, texts)


def test_hash_table_grows():
    t = P.HashTable(4)
    keys = np.random.default_rng(1).integers(1, 1 << 63, 5000).astype(np.uint64)
    for part in np.array_split(keys, 7):
        t.add(part)
    assert np.array_equal(t.find(keys), np.arange(5000)) and (t.find(keys + np.uint64(1)) == -1).all()


def test_bins_are_the_fullest():
    r = np.random.default_rng(2)
    for _ in range(50):
        lengths = sorted(set(r.integers(1, 40, 5).tolist()), reverse=True)
        avail = [[n, int(r.integers(1, 4))] for n in lengths]
        room = int(r.integers(1, 60))
        best = {0}
        for n, c in avail:
            best = {b + n * k for b in best for k in range(c + 1) if b + n * k <= room}
        got = P.fullest(avail, room)
        assert sum(n * k for n, k in got.items()) == max(best)
        assert all(k <= dict(avail)[n] for n, k in got.items())


def test_packing(spark):
    r = np.random.default_rng(1)
    texts = [" ".join(["word"] * int(n)) for n in r.integers(0, 150, 200)] + ["a " * 333] + ODD + ["same text"] * 30
    rows = [(i if i % 50 else None, t, 1) for i, t in enumerate(texts)] + [(3, "again", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, number int")
    out = P.pack_documents(df, P.tokenizer_path(), capacity=100).collect()
    tok = P._tokenizer(P.tokenizer_path())
    want = Counter()
    for i, t, _ in rows:
        ids = tok.whole.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 100)):
            want[(i, k, s, tuple(ids[s : s + 100]))] += 1
    assert Counter((x.doc_id, x.piece, x.start, tuple(np.frombuffer(x.ids, "<u4").tolist())) for x in out) == want
    bins: dict = {}
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in bins.values():
        end = 0
        for offset, n in sorted(b):
            assert offset == end
            end += n
        assert end <= 100
    total = sum(x.length for x in out)
    assert len(bins) <= -(-total // 100) + 1
    crc = P.pack_documents(df.limit(3), P.tokenizer_path(), digest=zlib.crc32)
    assert dict(crc.dtypes)["ids"] == "bigint" and crc.count() == 3
    assert P.pack_documents(df.limit(0), P.tokenizer_path()).count() == 0
