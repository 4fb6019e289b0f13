"""The registered queries on a small folder, each against its contract in plain Python."""

import math
import zlib
from collections import Counter

import pytest

from weftgraph.llm import common, queries
from weftgraph.llm.oracle import SQL

from . import cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    sf = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(17)
    rows = [r for r in dict.fromkeys(cases.documents())]
    for i in range(60):
        w = cases.prose(rng, 60).split()
        for k in range(6 if i % 3 == 0 else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zonkers", "zonked", "zonkish"]))
        rows.append((8000 + i, " ".join(w), "en", rng.choice("ab"), 0))
    item = cases.prose(rng, 30)
    rows.append((8100, f"{cases.prose(rng, 20)} {item} {cases.prose(rng, 20)}", "en", "a", 0))
    rows.append((8101, "pay 4111 1111 1111 1111 with token = \"9f8e2b7c4d1a6f3e8b5c2d7a9f8e2b7c4d1a6f3e\" now", "en", "a", 0))
    cases.frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    labels = [(8000 + i, 1, int(i % 3 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{sf}/labels.parquet")
    return sf, rows


def _run(spark, folder, n):
    sf, rows = folder
    name = next(k for k in queries.queries() if k.startswith(f"op{n}_"))
    return queries.queries()[name](spark, sf).collect(), rows


def _by(rows):
    return {i: t or "" for i, t, *_ in rows if i is not None}


def _tokens(t):
    return [*cases.words(cases.lower(t or "")), "\n"]


def test_op1(spark, folder):
    got, rows = _run(spark, folder, 1)
    held = lambda i: i is not None and cases.remainder(i, 7) == 2
    c = Counter(x for i, t, *_ in rows if not held(i) for x in _tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            w = _tokens(_by(rows)[r.doc_id])
            base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
            assert abs(r.base_score - base) < 1e-7 * len(w) and r.lattice_score <= 0 and r.score < 0


def test_op2_op4_op5(spark, folder):
    got, rows = _run(spark, folder, 2)
    assert [(r.doc_id, r.candidate[:5]) for r in got if r.kept] == [(8101, "token")]
    got, _ = _run(spark, folder, 4)
    assert [(r.doc_id, r.item_id, r.start, r.n_words, r.similarity) for r in got] == [(8100, 1, 20, 30, 1.0)]
    got, _ = _run(spark, folder, 5)
    by = _by(rows)
    assert len(got) == len(rows) and {r.doc_id for r in got if r.doc_id is not None and (r.text or "") != by[r.doc_id]} == {8101}
    spark.conf.set(queries.KEY_SETTING, "k")
    try:
        a, b = (sorted((str(r.doc_id), r.text or "") for r in _run(spark, folder, 5)[0]) for _ in range(2))
    finally:
        spark.conf.unset(queries.KEY_SETTING)
    assert a == b


def test_op3(spark, folder):
    got, rows = _run(spark, folder, 3)
    sets = {i: cases.shingles(t, 4) for i, t in _by(rows).items()}
    want = cases.components(sets)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_op6_op10(spark, folder):
    import numpy as np
    import sentencepiece
    from tokenizers import Tokenizer

    got, rows = _run(spark, folder, 6)
    by = _by(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
    for r in got:
        if r.doc_id is not None:
            n = len(sp.encode(by[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(by[r.doc_id].encode()), n, n > 4096)
    assert len(got) == len(rows)
    got, _ = _run(spark, folder, 10)
    t = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            ids = np.asarray([*t.encode(by[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert len(got) == len(rows)


def test_op7(spark, folder):
    got, rows = _run(spark, folder, 7)
    by = _by(rows)
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len(cases.words(t)) for _, t, *_ in rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and (r.doc_id is None or r["size"] == len(cases.words(by[r.doc_id])))
    again, _ = _run(spark, folder, 7)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_op8(spark, folder):
    got, rows = _run(spark, folder, 8)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (cases.remainder(r.doc_id, 3) == 1)
        if r.doc_id is not None and 8000 <= r.doc_id < 8060:
            assert r.predicted == int((r.doc_id - 8000) % 3 == 0)


def test_op9_equals_its_sql(spark, folder):
    import duckdb

    got, rows = _run(spark, folder, 9)
    con = duckdb.connect()
    unique = [r for r in rows if r[0] is not None]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in unique if "\x00" not in (t or "")])
    cur = con.execute(SQL["op9_quality_rules"])
    names = [d[0] for d in cur.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in cur.fetchall()}
    assert len(got) == len(rows) and len(want) > 80
    for r in got:
        if r.doc_id in want:
            assert r.asDict() == want[r.doc_id]
