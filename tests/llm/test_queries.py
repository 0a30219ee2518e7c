"""All queries over whole tables with edge rows and over empty tables, against plain versions."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from curatrix.llm import chat, pii
from curatrix.llm.queries import ORACLE_SQL, QUERIES, TRICKY

from .brute import near
from .test_bpe import LIBRARY, library
from .test_packing import check
from .test_topk import brute as top_brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}
BASE = "the old bridge stays open until the new one is done and then it will be taken down by the town"
DOCS = [
    (1, BASE, "en", "a", 1), (2, BASE + " now", "en", "a", 1), (3, BASE, None, None, None), (4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, " \n\t", None, "b", 3), (7, "12 34 !?", "en", "b", 8),
    (8, "mail me at und.34@mail7.example.com or 4111111111111111 please", "en", "c", 9), (9, "le pont reste ouvert jusque la fin et puis il sera ouvert", "fr", "c", 9), (10, "une deux trois quatre " * 3000, "fr", "c", 9),
    (11, "x", None, "c", 1), (11, "x", None, "c", 1), (12, "<|endoftext|> 's İΣ", None, "c", 1), (13, "le le le la la une des", "fr", "c", 1), (14, "the a of and to in is", "en", "c", 1),
]
TABLES = {
    "documents": DOCS,
    "embeddings": [(i, [float(i % 5), -1.0, i / 7], 0) for i in range(120)] + [(120, None, 0), (121, [None, 1.0, 2.0], 1), (122, [float("nan"), 0.0, 0.0], 1), (150, [1.0, 2.0, 3.0], None)],
    "pages": [(1, "http://www.a.com/x?utm_source=f", "<article><h1>T</h1><p>One two.</p></article>"), (1, "http://www.a.com/x?utm_source=f", "<article><h1>T</h1><p>One two.</p></article>"), (2, None, None), (3, "http://a.com/x/", ""), (5, "https://a.com/x#f", "<p>" + "long " * 20000)],
    "conversations": [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", TRICKY), (2, 0, None, None), (2, 0, "user", "x"), (3, 0, "assistant", "w " * 9000), (3, 1, "assistant", "w " * 9000)],
}


@pytest.fixture(scope="module", params=["edges", "empty"])
def tables(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    for name, rows in TABLES.items():
        more = ", id int, text_hash int, k int" if name == "documents" else ", rank int, split string"
        extra = (1, 2, 3) if name == "documents" else (1, "z")
        rows = [] if request.param == "empty" else [(*r, *extra) for r in rows]
        spark.createDataFrame(rows, SCHEMAS[name] + more).write.parquet(f"{d}/{name}.parquet")
    return request.param, str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_edges(spark, tables, name):
    kind, d = tables
    rows = QUERIES[name](spark, d).collect()
    if kind == "empty":
        assert len(rows) == (1 if name == "op2_chat" else 0)
        return
    CHECKS[name](rows)


def check_html(rows):
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows) == sorted([(1, "T\nOne two.", 10), (1, "T\nOne two.", 10), (2, "", 0), (3, "", 0), (5, ("long " * 20000).strip(), 99999)])


def check_chat(rows):
    want = {}
    for c, t, r, x in TABLES["conversations"] + [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)]:
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert {r.conv_id for r in rows} == set(want)
    for r in rows:
        turns = [(a, b) for _, a, b in sorted(want[r.conv_id])]
        loss = "".join(x for a, x in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(chat.template(*t)[0]) for t in turns)


def check_packing(rows):
    n = check([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    texts = {d[0]: d[1] for d in DOCS}
    total = sum(len(library(d[1])) + 1 for d in DOCS)
    assert sum(r.length for r in rows) == total and n == -(-total // 4096)
    for r in rows:
        part = (library(texts[r.doc_id]) + [1])[r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def check_language(rows):
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert len(rows) == len(DOCS) and und == {4, 5, 6, 7}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.lang_pred in ("und", "en", "fr")


def check_pii(rows):
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(DOCS)
    assert by[8].n_replaced == 2 and "und.34" not in by[8].text and "4111111111111111" not in by[8].text
    assert all(by[d[0]].text == d[1] for d in DOCS if d[0] != 8)


def check_top(rows):
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == top_brute([(i, v) for i, v, _ in TABLES["embeddings"]])


def check_bpe(rows):
    texts = {d[0]: d[1] for d in DOCS}
    assert len(rows) == len(DOCS)
    for r in rows:
        ids = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_near(rows):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(near([(d[0], d[1]) for d in DOCS], 2))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def check_warc(rows):
    assert len(rows) == 2 * len(TABLES["pages"])
    by = {}
    for r in rows:
        by.setdefault(r.record_id, []).append(r)
    assert {r.outcome for r in by[7] + by[8]} == {"no earlier response"}  # of a page without an address
    assert by[17][0].outcome == "validators differ" and by[17][0].payload_sha256 is None
    assert by[16][0].payload_sha256 == hashlib.sha256(TABLES["pages"][4][2].encode()).hexdigest()


def check_audio(rows):
    texts = {d[0]: d[1] for d in DOCS}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest())
    by = {}
    for r in rows:
        by.setdefault(texts[r.doc_id] or "", set()).add(r.feature)
    assert len(rows) == len(DOCS) and all(len(f) == 1 for f in by.values())


CHECKS = dict(zip(QUERIES, (check_html, check_chat, check_packing, check_language, check_pii, check_top, check_bpe, check_near, check_warc, check_audio)))


def test_pipeline(spark, tables):
    kind, d = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if n < 3:
            assert docs.columns == columns
        path = f"{d}/stage-{n}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    if kind == "empty":
        assert not any(kept)
        return
    assert {r.doc_id for r in kept[0]} == {d[0] for d in DOCS} - {4, 5, 6, 7} and all(r.lang for r in kept[0])
    want = {}
    for key, _, component in near([(r.doc_id, r.text) for r in kept[0]], 5):
        want.setdefault(component, key)
    assert sorted(r.doc_id for r in kept[1]) == sorted(want)
    texts = {r.doc_id: r.text for r in kept[1]}
    assert all((r.text != texts[r.doc_id]) == (r.doc_id == 8) and r.n_chars == len(r.text) for r in kept[2])
    check([(r.sequence_id, r.offset, r.length) for r in kept[3]], 4096)
    assert sum(r.length for r in kept[3]) == sum(len(library(r.text)) + 1 for r in kept[2])
    same = corpus_pipeline.run(spark, d)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in same.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept[3])


def test_native(spark, tables):
    plan = pii.pseudonymise(spark.read.parquet(f"{tables[1]}/documents.parquet"), key="k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in SCHEMAS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    told = c.execute(ORACLE_SQL[name])
    at = [[x[0] for x in told.description].index(k) for k in columns]
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_duplicates_of_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = QUERIES["op8_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near([(r.doc_id, r.text) for r in docs], 2))
