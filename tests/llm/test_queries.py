"""The registered queries on the smallest tables, against brute force or SQL."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from inkwell.llm import suffix_dedup
from inkwell.llm.packing import _tokenizer, tokenizer_path
from inkwell.llm.queries import ORACLE_SQL, QUERIES

from .test_decontaminate import words
from .test_pii import brute as brute_pii
from .test_simhash import brute_groups, brute_print

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark):
    import html
    import re

    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():  # all of these pages say where their article is
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        body = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", body, flags=re.S)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|h2|br|div|ul|li)\b[^>]*>", " ", body))).split())
    got = rows(spark, "op1_html_template")
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want) and all(len(r.text) == r.n_chars > 0 for r in got)


def test_op2(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows(spark, "op2_maxscore_topk"))
    assert got == sorted(con.execute(ORACLE_SQL["op2_maxscore_topk"]).fetchall()) and got


def test_op3(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op3_cross_entropy")}
    assert len(got) == len(docs) and all(got[i].n_tokens == len(words(t)) for i, t in docs)


def test_op4(spark, docs):
    got = rows(spark, "op4_quality")
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_op5(spark, docs):
    got: dict = {}
    for r in rows(spark, "op5_best_fit_packing"):
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    whole = _tokenizer(tokenizer_path()).whole
    for i, t in docs:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert sorted(got[i]) == [(k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]


def test_op6(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op6_license_scan")}
    notices = ("released under the mit license", "licensed under the apache license, version 2.0", "licensed under cc by-nc 4.0")
    for i, t in docs:
        if any(n in (t or "").lower() for n in notices):
            assert got[i].n_matches and got[i].coverage == 1.0


def test_op7(spark, docs):
    items = [(str(r.item_id), words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams: dict = {}
    for name, w in items:
        for k in range(max(1, len(w) - 7) if w else 0):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(name)
    got = {r.doc_id: r for r in rows(spark, "op7_decontaminate")}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if names := grams.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= names
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2)


def test_op8(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op8_suffix_dedup")}
    texts = [(t or "").encode() for _, t in docs]
    for (i, _), t, kept in zip(docs, texts, suffix_dedup.brute_force(texts, 400), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(t), len(t) - len(kept), sha(kept))
        assert (got[i].n_spans > 0) == (got[i].n_removed > 0)


def test_op9(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op9_pii")}
    for i, t in docs:
        assert got[i].base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(t or "")))


def test_op10(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op10_simhash_dedup")}
    prints = [brute_print(t) for _, t in docs]
    for (i, _), p, c in zip(docs, prints, brute_groups([i for i, _ in docs], prints), strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", c)
