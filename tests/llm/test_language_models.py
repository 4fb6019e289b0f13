"""Lattice scores, token counts, token files against plain computations."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common, lm_scores, token_counts, token_files

from . import cases

MODEL, WORDY = common.tokenizer_path("piece_bpe_32k.model"), common.tokenizer_path("word_bpe_49k.json")


def _segmentations(word, logp, cache):
    """log of the sum over all ways to cut the bytes of ``word`` into pieces."""
    best = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        terms = [best[i] + logp[word[i:j]] for i in range(j) if word[i:j] in logp and best[i] > -math.inf]
        top = max(terms)
        best[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    return best[-1]


def test_lattice_sums_all_segmentations(monkeypatch):
    pieces = lm_scores.Pieces(MODEL)
    logp = {p: float(x) for p, x in zip(pieces.pieces, pieces.logp[0])}
    assert abs(sum(math.exp(x) for x in logp.values()) - 1) < 1e-9
    some = [w.encode() for w in ("the", "a", "stone", "étrange", "东京", "является", "результата", "xqzxqz", "b" * 40, "thestone" * 20)]
    assert pieces.longest > 16 and " является".encode() in logp
    got = pieces.log_marginals(some)
    for w, x in zip(some, got[0]):
        assert abs(x - _segmentations(b" " + w, logp, {})) < 1e-6
    uses = pieces.expected(some)
    monkeypatch.setattr(lm_scores, "LONG", 10)
    assert abs(pieces.log_marginals(some) - got).max() < 1e-9 and abs(pieces.expected(some) - uses).max() < 1e-9
    assert math.isfinite(pieces.log_marginals([b"x" * 50_000])[0][0])


def test_scores_follow_the_formula(spark):
    docs = cases.frame(spark)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    model = lm_scores.learn(docs.filter(~F.coalesce(held, F.lit(False))), MODEL)
    rows = lm_scores.scores(docs, model, held).collect()
    given = cases.documents()
    assert len(rows) == len(given)
    train, counts = [], {}
    for i, t, *_ in given:
        if not (i is not None and cases.remainder(i, 7) == 2):
            train.append(cases.words(cases.lower(t or "")))
    for w in train:
        for x in [*w, "\n"]:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    pieces = lm_scores.Pieces(MODEL, model.weights)
    by = {i: t for i, t, *_ in given}
    for r in rows:
        if r.doc_id is None:
            continue
        w = [*cases.words(cases.lower(by[r.doc_id] or "")), "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert abs(r.base_score - sum(math.log10((counts.get(x, 0) + 1) / (n + 1 * (v + 1))) for x in w)) < 1e-9 * len(w)
        own, adapted = pieces.log_marginals([x.encode("utf-8", "surrogatepass") for x in w[:-1]])
        D = lm_scores.DISCOUNT
        end = math.log10((counts["\n"] - D) / n)
        for got, lattice in ((r.score, own), (r.adapted_score, adapted)):
            want = end + sum(math.log10(max(counts.get(x, 0) - D, 0) / n + D * v / n * math.exp(p)) for x, p in zip(w[:-1], lattice))
            assert abs(got - want) < 1e-6 * max(1, abs(want))
        assert abs(r.lattice_score - end - sum(own) / math.log(10)) < 1e-6 * max(1, abs(r.lattice_score))
        assert r.held_out == (cases.remainder(r.doc_id, 7) == 2)
    empty = docs.filter("false")
    model = lm_scores.learn(empty, MODEL)
    assert lm_scores.scores(empty, model, F.lit(False)).count() == 0
    one = lm_scores.scores(docs.filter("doc_id = 203"), model, F.lit(True)).first()
    assert one.train_tokens == 0 and one.score < 0


def test_frequent_words_stay_within_the_bound(spark):
    rows = [(f"w{i}".encode(), 1 + i // 3) for i in range(300)]
    df = spark.createDataFrame(rows, "word binary, c long")
    for most in (0, 1, 10, 299, 300, 10_000):
        least = lm_scores._head_count(df, most)
        assert sum(c >= least for _, c in rows) <= most
    assert sum(c >= lm_scores._head_count(df, 10_000) for _, c in rows) == 300


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(9)
    odd = ["", " ", "  a", "a  b", "\n\n", "\ta\r\n b ", "▁a ▁", "<s> </s> <unk>", "東京 大阪", "é́", "a\x00b", " x", "ß ẞ İ", "\U0001f600\U0001f600", "a" * 5000]
    odd += ["".join(rng.choice("ab \n\t▁é東.,'-<>") for _ in range(rng.randrange(60))) for _ in range(300)]
    counter = token_counts.Counter(MODEL, token_counts.vocabulary_lengths(MODEL))
    for t in odd:
        assert counter.count(t) == len(sp.encode(t)), repr(t)
    got = token_counts.token_counts(cases.frame(spark), MODEL, limit=50)
    texts = {i: t or "" for i, t, *_ in cases.documents()}
    rows = got.collect()
    assert len(rows) == len(cases.documents())
    for r in rows:
        if r.doc_id is not None:
            n = len(sp.encode(texts[r.doc_id]))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 50)
    assert token_counts.token_counts(cases.frame(spark).filter("false"), MODEL).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDY)


def _ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_the_library(tokenizer, monkeypatch):
    rng = random.Random(4)
    odd = ["", " ", "don't we'LL", "A,b. C.", "x<|endoftext|>y", "<|startoftext|>", "<|endoftext|", "ÀÉ ß İI ı", "東京", "a b c", "é", "1234 12,5", "\x00 a", "﻿b", "'s 't", "K Å"]
    odd += ["".join(rng.choice("abAB ,.'\n é東<|>1​") for _ in range(rng.randrange(50))) for _ in range(400)]
    odd += ["<|STARTOFTEXT|> x", "İ. ab!", "ﬁ, ǅ.", "x\x1cy", "ab\u00a0cd.", None]
    encoder = token_files.Encoder(WORDY)
    for _ in range(2):  # with an empty table, then a full one
        ids, ends = encoder.encode_all(odd)
        assert len(ends) == len(odd) and ends[-1] == len(ids)
        for t, i, j in zip(odd, [0, *ends], ends):
            assert ids[i:j].tolist() == _ids(tokenizer, t)[:-1], repr(t)
    monkeypatch.setattr(token_files, "CHUNKS_MOST", 3)
    assert encoder.encode("one two three four").tolist() == _ids(tokenizer, "one two three four")[:-1]
    few = token_files.Encoder(WORDY)
    for k in range(0, len(odd), 25):  # tables that overflow again and again keep what batches share
        part = [*odd[k : k + 25], "one two", "seven, eight."]
        ids, ends = few.encode_all(part)
        for t, i, j in zip(part, [0, *ends], ends):
            assert ids[i:j].tolist() == _ids(tokenizer, t)[:-1], repr(t)
    ids, ends = encoder.encode_all([])
    assert len(ids) == len(ends) == 0


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    import numpy as np

    docs = cases.frame(spark)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, WORDY, path)
    rows = token_files.read_documents(spark, path, with_ids=True).collect()
    given = cases.documents()
    assert len(rows) == len(given)
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        at += r.n_tokens
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known)
    by = {i: t for i, t, *_ in given}
    for r in rows:
        if r.doc_id is not None:
            assert list(r.ids) == _ids(tokenizer, by[r.doc_id])
    assert token_files.token_files(docs.filter("false"), WORDY).count() == 0
    flat = [x for r in rows for x in r.ids]
    some = [flat[0], flat[-1], 2, 40_000]
    assert {(r.token, r.n) for r in token_files.counts(spark, path, some).collect()} == {(t, flat.count(t)) for t in some}
    assert sorted(r.place for r in token_files.occurrences(spark, path, flat[5]).collect()) == [i for i, t in enumerate(flat) if t == flat[5]]
    places = [0, 7, len(flat) - 1, len(flat)]
    assert {(r.place, r.token) for r in token_files.tokens_at(spark, path, places).collect()} == {(p, flat[p]) for p in places[:-1]}


def test_wavelet_matrix():
    import numpy as np

    rng = np.random.RandomState(1)
    for top, n in ((2, 1), (3, 700), (50_000, 1500), (1 << 20, 1100), (1, 5)):
        ids = rng.randint(0, top, n).astype(np.uint32)
        w = token_files.Wavelet.unpacked(token_files.Wavelet.of(ids).packed())
        assert w.read(0, n).tolist() == ids.tolist()
        i, j = sorted(rng.randint(0, n + 1, 2).tolist())
        assert w.read(i, j).tolist() == ids[i:j].tolist()
        for token in {int(ids[0]), int(ids[-1]), top + 5}:
            places = np.flatnonzero(ids == token)
            assert w.count(token) == len(places) and w.count(token, i, j) == ((places >= i) & (places < j)).sum()
            for k in (0, len(places) - 1, len(places)):
                want = int(places[k]) if 0 <= k < len(places) else None
                assert w.occurrence(token, k) == want
        assert w.access(n // 2) == ids[n // 2]
