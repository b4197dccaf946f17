import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from gridloom.llm import ngram_lm as lm
from pyspark.sql import functions as F

TEXTS = ["the cat sat on the mat", "The cat\x0bran", None, "", "a b a b a b zzz", "ünï cödé É é", "the the the"] * 9


def brute(rows):
    parts = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows}
    learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in parts}
    c = Counter(w for i, p in parts.items() if learn[i] for w in p)
    n, v = sum(c.values()), len(c)
    return {i: (not learn[i], len(p), sum(c[w] > 0 for w in p), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in p)) for i, p in parts.items()}


@pytest.mark.parametrize("top", [3, 1 << 16])
def test_base_equals_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP", top)
    rows = list(enumerate(TEXTS))
    got = lm.score_documents(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, token int").repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], abs=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_filter_reads_back_quantised_counts():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 60_000, dtype=np.uint64))
    counts = np.maximum(1, rng.pareto(1, len(keys)).astype(np.int64))
    rows = []
    for s in range(lm.SEGMENTS):
        own = lm.segment_of(keys, lm.SEGMENTS) == s
        if own.any():
            rows.append((s, *lm.build_segment(keys[own], counts[own])))
    found = lm.Filter.join(rows, lm.SEGMENTS)
    levels, q = found.levels(keys), lm.quantise(counts)
    assert (levels >= q).all() and (levels > q).mean() < 0.06  # it only ever errs upwards
    other = rng.integers(0, 2**63, 60_000, dtype=np.uint64)
    assert (found.levels(other) > 0).mean() < 0.06


def test_segments_grow_with_the_corpus():
    keys = np.array([0, 1 << 63, 2**64 - 1], np.uint64)
    for tokens in (0, 10**6, 10**9, 10**11, 10**13):
        n = lm.segments_of(tokens)
        assert n >= lm.SEGMENTS and n * lm.SEGMENT_TOKENS >= tokens
        assert lm.segment_of(keys, n).tolist() == [0, n // 2, n - 1]


def test_large_counts_are_dealt_whole():
    keys, counts = np.array([5, 3, 2**64 - 1], np.uint64), np.array([70_000, 10**12, 2])
    rows = lm.dealt(keys, counts, lm.SEGMENTS).to_pylist()
    assert [(r["segment"], lm.from_planes(r["keys"], "<u8").tolist()) for r in rows] == [(0, [3, 5]), (lm.SEGMENTS - 1, [2**64 - 1])]
    assert lm.from_planes(rows[0]["counts"], "<u8").tolist() == [10**12, 70_000] and lm.from_planes(rows[1]["counts"], "<u2").tolist() == [2]


@pytest.mark.parametrize("rows", [7, 4096])
def test_scores_do_not_depend_on_max_bits(spark, monkeypatch, rows):
    monkeypatch.setattr(lm, "SLICE_ROWS", rows)
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(f"w{i}" for i in rng.zipf(1.5, 200) % 300) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "null id"), (1, "the cat"), (1, "the cat"), (None, None)], "doc_id long, text string").repartition(3)
    whole, split = (sorted(map(tuple, lm.score_documents(docs, max_bits=m).collect()), key=repr) for m in (1 << 29, 0))
    assert len(whole) == len(texts) + 4
    for a, b in zip(whole, split, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def exact_scores(rows):
    """Scores of the model with exact counts, put in the middle of their quantised range."""
    parts = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows}
    learn = [p for i, p in parts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for p in learn for w in p), Counter(x for p in learn for x in zip([b"\t", *p[:-1]], p, strict=True))
    n, v = sum(one.values()), len(one)
    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = (m, high) if sum(c ** (m := (low + high) / 2) for c in one.values()) < len(two) else (low, m)

    def read(c):
        alike = [k for k in range(1, 3 * c + 3) if lm.quantise(np.array([k]))[0] == lm.quantise(np.array([c]))[0]]
        return (alike[0] + alike[-1]) / 2 if c else 0.0

    def p(w, before):
        whole = (read(one[w]) + 1) / (n + v + 1)
        c = float(len(learn)) if before == b"\t" else read(one[before])
        return (min(read(two[before, w]), c) + c**low * whole) / (c + c**low) if c else whole

    return {i: sum(math.log10(p(w, b)) for b, w in zip([b"\t", *p_[:-1]], p_, strict=True)) for i, p_ in parts.items()}


@pytest.mark.parametrize("max_bits", [0, 1 << 29])
def test_score_equals_brute_force(spark, monkeypatch, max_bits):
    monkeypatch.setattr(lm, "BITS_PER_EVENT", 400.0)  # hardly any false positives
    rows = list(enumerate(TEXTS))
    want = exact_scores(rows)
    for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), max_bits=max_bits).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=2e-3)


def test_model_beats_the_base_on_held_out_text(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(50)]
    nxt = {w: rng.choice(words, 3) for w in words}
    rows = []
    for i in range(300):
        w, text = "w0", []
        for _ in range(60):
            text.append(w)
            w = str(rng.choice(nxt[w]))
        rows.append((i, " ".join(text)))
    got = [r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model, counts, _ = lm.fit(docs.withColumns({"learn": lm.in_training(), "text_key": F.lit(0)}))
    vocabulary = [bytes(r.token) for r in counts.collect()]
    scorer = lm.Scorer(model)
    total = 0.0
    for w in vocabulary:
        both, _, _ = scorer.score([b"the", w, lm.END], np.array([2, 1]))
        one, _, _ = scorer.score([b"the", lm.END], np.array([1, 1]))
        total += 10 ** (both[0] - one[0])
    assert 0.8 < total < 1.2


def test_empty_table(spark):
    for max_bits in (0, 1 << 29):
        assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), max_bits=max_bits).count() == 0


def test_slices_do_not_shuffle_texts_twice(spark):
    """Where the filter is not broadcast, texts move once and compressed, and rare words are not dealt out for each text."""

    def written():
        time.sleep(1)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    rng = np.random.default_rng(8)
    texts = [" ".join(f"word{i}" for i in rng.zipf(1.2, 300) % 100_000) for _ in range(1500)]
    docs, before = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).checkpoint(), written()
    assert lm.score_documents(docs, max_bits=0).count() == 1500
    print("shuffled", written() - before, "of", sum(map(len, texts)))
    assert written() - before < 1.6 * sum(map(len, texts))


def test_a_task_has_few_tokens_at_a_time():
    column = lm.pa.array(["one two three " * 7_000] * 60)
    runs = [(len(tokens), len(lengths)) for tokens, lengths in lm.tokens_of(lm.each_text(column))]
    assert sum(n for _, n in runs) == 60 and sum(t for t, _ in runs) == 60 * 21_001
    assert max(t for t, _ in runs) < 300_000 and lm.Words().most <= 250_000
