"""Near duplicates, decontamination, quality rules, mixing, pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common, decontamination, mixing, near_dups, quality

from . import cases


def _sets(rows, k):
    return {i: cases.shingles(t, k) for i, t, *_ in rows if i is not None}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rng = random.Random(k)
    rows = cases.documents()
    for g in range(12):  # families of near copies, chains included
        w = cases.prose(rng, rng.choice([4, 30, 80])).split()
        for c in range(rng.choice([1, 3, 6])):
            rows.append((1000 + 20 * g + c, " ".join(w), "en", "web", 0))
            w = list(w)
            w[rng.randrange(len(w))] = f"new{c}"
    got = near_dups.near_duplicates(cases.frame(spark, rows), shingle=k).collect()
    sets = _sets(rows, k)
    want = cases.components(sets)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_dups.near_duplicates(cases.frame(spark).filter("false")).count() == 0


def test_near_duplicates_of_repeated_ids_and_large_groups(spark):
    rng = random.Random(8)
    text = cases.prose(rng, 60)
    rows = [(i, text if i % 2 else text + f" tail{i}", "en", "web", 0) for i in range(1, 300)]
    rows += [(5, cases.prose(rng, 60), "en", "web", 0), (5, text, "en", "web", 0)]
    got = near_dups.near_duplicates(cases.frame(spark, rows, False)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}
    docs = cases.frame(spark, rows)
    kept = near_dups.keep_first(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_circulant_signature_estimates_similarity():
    signer = near_dups.Signer(5)
    rng = random.Random(2)
    a = cases.prose(rng, 4000).split()
    b = a[:3600] + cases.prose(rng, 400).split()
    x, y = (signer.shingles(" ".join(w)) for w in (a, b))
    import numpy as np

    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    (_, ka, p, q), (_, kb, r, s) = signer.sign(x), signer.sign(y)
    same = 128 - sum(bin((u ^ v) & (2**64 - 1)).count("1") for u, v in ((p, r), (q, s)))
    assert abs((2 * same / 128 - 1) - true) < 0.25 and (ka == kb).any()


# --- decontamination -----------------------------------------------------------


def _weighted(a, b):
    from collections import Counter

    x, y = Counter(a), Counter(b)
    low = sum(min(x[k], y[k]) for k in x)
    return low / (len(a) + len(b) - low)


def _grams(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def _leaks(rows, items):
    out = set()
    for i, t, *_ in rows:
        w = [x.lower() for x in cases.words(t or "")]
        known = set(w)
        for k, item in items:
            m = [x.lower() for x in cases.words(item or "")]
            if not m or not w or not known.intersection(m):
                continue
            g = _grams(m)
            if len(w) > 10_000 and not set(g).intersection(_grams(w)):
                continue  # no window of it shares anything
            best = max(_weighted(_grams(w[s : s + len(m)]), g) for s in range(max(1, len(w) - len(m) + 1)))
            if best >= 0.8:
                out.add((i, k))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(k, cases.prose(rng, rng.choice([8, 30, 55]))) for k in range(6)] + [(90, None), (91, ""), (92, "two words")]
    rows = cases.documents()
    for k, item in items[:6]:
        w = item.split()
        cut = list(w)
        cut[len(cut) // 2] = "altered"
        for n, passage in enumerate((w, cut, w[: len(w) // 2])):
            rows.append((2000 + 10 * k + n, f"{cases.prose(rng, 40)} {' '.join(passage).upper()} {cases.prose(rng, 30)}", "en", "web", 0))
    rows += [(3000, "two words", "en", "web", 0), (3001, f"{cases.prose(rng, 9)} two words {items[5][1]}", "en", "web", 0), (3001, "again", "en", "web", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("clash"))
    got = decontamination.contaminated(cases.frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == _leaks(rows, items)
    by = {i: t for i, t, *_ in rows if t != "again"}
    for r in got:
        w = [x.lower() for x in cases.words(by[r.doc_id])][r.start : r.start + r.n_words]
        m = [x.lower() for x in cases.words(dict(items)[r.item_id])]
        assert abs(_weighted(_grams(w), _grams(m)) - r.similarity) < 1e-9
    docs = cases.frame(spark, rows)
    kept = decontamination.keep_clean(docs, bench)
    gone = {i for i, _ in _leaks(rows, items)}
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, *_ in rows if i not in gone)
    assert decontamination.contaminated(docs.filter("false"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.filter("false")).count() == 0


def test_fingerprints_find_the_windows(spark, monkeypatch):
    """Every pair of similarity 0.8 or more is within the radius but for a few; with a lesser radius they are lost."""
    rng = random.Random(16)
    items, rows = [], []
    for k in range(150):
        w = cases.prose(rng, rng.choice([40, 50, 59])).split()
        items.append((k, " ".join(w)))
        x = list(w)
        x[0 if k % 3 else rng.choice([0, len(w) // 2])] = "altered"
        rows.append((k, f"{cases.prose(rng, 20)} {' '.join(x)} {cases.prose(rng, 20)}", "en", "web", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _leaks(rows, items)
    docs = cases.frame(spark, rows)
    got = decontamination.contaminated(docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(want) > 100 and found <= want and len(found) >= 0.98 * len(want)
    assert all(0 <= r.distance <= decontamination.RADIUS for r in got) and max(r.distance for r in got) > 4
    monkeypatch.setattr(decontamination, "RADIUS", 1)
    assert len(decontamination.contaminated(docs, bench).collect()) < len(found) / 2


# --- quality ---------------------------------------------------------------------


def _quality(text):
    t = text or ""
    w = cases.words(t)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if cases.words(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(12)
    rows = cases.documents()
    for k in range(30):
        lines = [cases.prose(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 15))]
        rows.append((5000 + k, "\n".join(rng.choice(lines) + rng.choice(["", " #", "\r", "\t&|"]) for _ in range(20)), "en", "web", 0))
    got = quality.quality(cases.frame(spark, rows)).collect()
    by = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _quality(by[r.doc_id]), r.doc_id
            assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and not r.broken)
    docs = cases.frame(spark, rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality(docs.filter("false")).count() == 0


def test_rules_are_one_projection(spark):
    plan = quality.quality(cases.frame(spark, extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Aggregate" not in plan


# --- mixing ------------------------------------------------------------------------


def test_targets_and_fit():
    assert mixing.targets_for([100, 100], [1, 2]) == [pytest.approx(200 / 3), pytest.approx(400 / 3)]
    assert mixing.targets_for([1, 1000], [2, 1]) == [3.0, 998.0]
    assert mixing.targets_for([], []) == [] and mixing.targets_for([0, 5], [1, 2]) == [0.0, 5.0]
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 6) for _ in range(rng.randrange(1, 7))}
        budget = rng.randrange(0, sum(s * c for s, c in counts.items()) + 1)
        take = mixing.fit(counts, budget)
        assert all(0 <= k <= counts[s] for s, k in take.items())
        got = sum(s * k for s, k in take.items())
        assert got <= budget
        reach = {0}
        for s, c in counts.items():
            reach = {r + s * k for r in reach for k in range(c + 1)}
        near = mixing.nearest(counts, budget)
        assert all(0 <= k <= counts[s] for s, k in near.items())
        assert abs(sum(s * k for s, k in near.items()) - budget) <= budget - got
        assert budget - got <= max(min(counts), budget - max(r for r in reach if r <= budget)) + max(counts)


def test_budgets_of_long_documents_are_met():
    once = lambda *sizes: dict.fromkeys(sizes, 1)
    for counts, budget, best in (
        (once(100_000, 110_000, 130_000), 100_000, 100_000),
        (once(100_000, 110_000, 130_000), 215_000, 210_000),
        (once(70_001, 80_003, 90_007, 95_011), 85_000, 80_003),
        (once(100_000, 95_000, 90_000), 99_000, 100_000),
        (once(3_000_000, 5_000_000, 7_000_001), 8_000_100, 8_000_000),
    ):
        for seed in range(5):
            take = mixing.nearest(counts, budget, seed)
            assert sum(s * k for s, k in take.items()) == best, (counts, budget, take)
    rng = random.Random(4)
    counts = {rng.randrange(50_000, 400_000): 1 for _ in range(300)}
    takes = [mixing.nearest(counts, sum(counts) // 3, seed) for seed in (1, 2)]
    assert all(abs(sum(s * k for s, k in t.items()) - sum(counts) // 3) <= 1 for t in takes) and takes[0] != takes[1]
    means = [sum(s * k for s, k in t.items()) / len(t) for t in takes]
    assert all(abs(m / (sum(counts) / 300) - 1) < 0.25 for m in means)  # not the longest ones first


@pytest.mark.parametrize("most", [0, 100_000])
def test_mix_of_a_hot_size(spark, monkeypatch, most):
    """One size and source of most rows, with a broadcast and with a salted plan."""
    monkeypatch.setattr(mixing, "PLAN_ROWS", most)
    rows = [(i, f"w{i} b c", "en", "a", 0) for i in range(3000)] + [(5000 + i, "x y", "en", "b", 0) for i in range(40)]
    got = mixing.mixed(cases.frame(spark, rows)).collect()
    by = {s: [r.taken for r in got if r["size"] == s] for s in (3, 2)}
    goals = mixing.targets_for([9000, 80], [1, 2])
    assert [abs(sum(by[s]) - g) <= s / 2 + 1 for s, g in zip((3, 2), goals)] == [True, True]
    assert max(by[3]) - min(by[3]) <= 3


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = cases.documents() + [(10_000 + i, cases.prose(rng, rng.randrange(1, 90)), "en", rng.choice("abc"), 0) for i in range(400)]
    docs = cases.frame(spark, rows)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {n: sum(len(cases.words(r[1] or "")) for r in rows if r[3] == n) for n in names}
    want = dict(zip(names, mixing.targets_for([size[n] for n in names], [1 + i % 3 for i in range(len(names))])))
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = dict.fromkeys(names, 0)
    for r in got:
        n = source[r.doc_id] if r.doc_id is not None else ("web" if r["size"] else None)
        assert r.source_size == size[n] and r.target == pytest.approx(want[n]) and 0 <= r.taken <= 3 * r["size"]
        taken[n] += r.taken
    for n in names:
        largest = max(len(cases.words(r[1] or "")) for r in rows if r[3] == n)
        assert abs(taken[n] - want[n]) <= largest / 2 + 1, n
        if largest < 1000:
            assert abs(taken[n] - want[n]) <= max(2, 0.01 * want[n]), n
    again = mixing.mixed(docs.repartition(7, "text")).collect()
    assert sorted(map(str, ((r.doc_id, r.taken) for r in got))) == sorted(map(str, ((r.doc_id, r.taken) for r in again)))
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert sum(len(cases.words(r.text or "")) for r in out.select("text").collect()) == sum(taken.values())
    assert mixing.mixed(docs.filter("false")).count() == 0 and mixing.mixture(docs.filter("false")).count() == 0


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, tmp_path):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(21)
    items = [(k, cases.prose(rng, 40)) for k in range(3)]
    rows = list(dict.fromkeys(r for r in cases.documents() if r[0] not in (None, 301))) + [(6000 + i, cases.prose(rng, 70) + (f" {items[i % 3][1]}" if i % 4 == 0 else ""), "en", rng.choice("ab"), 0) for i in range(30)]
    sf = str(tmp_path)
    cases.frame(spark, rows, False).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, found = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, sf), "test")
        found.append(docs)
    assert all(d.columns == columns for d in found[:-1])
    left = [set(r.doc_id for r in d.select("doc_id").collect()) for d in found[:4]]
    by = {r[0]: r for r in rows}
    measured = {r.doc_id: r.kept for r in quality.quality(cases.frame(spark, rows)).collect()}
    assert left[0] == {i for i, k in measured.items() if k}
    want = cases.components({i: cases.shingles(by[i][1], 5) for i in left[0]})
    assert left[1] == {i for i in left[0] if want[i] == i}
    leaks = {i for i, _ in _leaks([by[i] for i in left[1]], items)}
    assert leaks and left[2] == left[1] - leaks
    mixed = found[3].collect()
    size = {n: sum(len(cases.words(by[i][1])) for i in left[2] if by[i][3] == n) for n in {by[i][3] for i in left[2]}}
    order = sorted(size, key=lambda n: (n is None, n or ""))
    goals = dict(zip(order, mixing.targets_for([size[n] for n in order], [1 + i % 3 for i in range(len(order))])))
    longest = {n: max(len(cases.words(by[i][1])) for i in left[2] if by[i][3] == n) for n in order}
    for n in order:
        taken = sum(len(cases.words(r.text)) for r in mixed if r.source == n)
        assert abs(taken - goals[n]) <= longest[n] / 2 + 1
    t = Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*t.encode(by[i][1], add_special_tokens=False).ids, 2] for i in left[2]}
    want = sorted((r.doc_id, len(ids[r.doc_id]), zlib.crc32(np.asarray(ids[r.doc_id], "<u4").tobytes())) for r in mixed)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null ids, repeated rows, long words, clashing columns and an empty table go through every stage."""
    import corpus_pipeline

    rng = random.Random(3)
    rows = cases.documents() + [(7000, cases.prose(rng, 80), "en", "a", 0)] * 3
    sf = str(tmp_path / "some")
    docs = cases.frame(spark, rows)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, rows[2][1]), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    found, now = [], spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = common.staged(stage(spark, now, sf), "awkward")
        found.append(now)
    assert all(sorted(d.columns) == sorted(docs.columns) for d in found[:-1])
    ids = [sorted(str(r.doc_id) for r in d.select("doc_id").collect()) for d in found[:4]]
    assert ids[0].count("None") == 1 and ids[0].count("7000") == 3 and not {"300", "301"} & set(ids[0])
    assert ids[1].count("None") == 1 and ids[1].count("7000") == 3 and "100" in ids[1] and not {"101", "102", "103"} & set(ids[1])
    assert str(rows[2][0]) in ids[1] and str(rows[2][0]) not in ids[2] and set(ids[2]) == set(ids[1]) - {str(rows[2][0])}
    assert set(ids[3]) <= set(ids[2]) and found[4].count() == len(ids[3])
    none = str(tmp_path / "none")
    docs.filter("false").write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
