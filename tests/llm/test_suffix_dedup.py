import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from gridloom.llm import suffix_dedup as sd


def brute(texts):
    n = sd.LENGTH
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i + 1 : i + n + 1] = True
        kept = bytes(b for b, g in zip(r, gone[1:-1], strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(0)
    for alphabet, n in ((2, 900), (4, 3000), (1, 300), (200, 1000)):
        data = rng.integers(97, 97 + alphabet, n).astype(np.uint8) if alphabet < 100 else rng.integers(0, 256, n).astype(np.uint8)
        data = np.r_[data, data[: n // 2], data[n // 4 : n // 2]]
        raw = data.tobytes()
        order, _ = sd.suffix_array(data, 1600)
        got = [raw[i : i + 1500] for i in order]
        assert sorted(order.tolist()) == list(range(len(raw)))
        assert all(a <= b for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(("batch", "small"), [(3000, 0), (4_000_000, 2_000_000)])
def test_equals_brute_force(spark, monkeypatch, batch, small):
    monkeypatch.setattr(sd, "BATCH", batch)
    monkeypatch.setattr(sd, "SMALL", small)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(n) for n in (60, 80, 200, 45)]
    texts = [fresh(rng.randint(0, 150)) for _ in range(30)]
    for _ in range(60):
        p = rng.choice(passages)
        a = rng.randint(0, len(p) // 2)
        p = p[a:]
        if rng.random() < 0.5:
            i = rng.randrange(len(p))
            p = p[:i] + "Z" + p[i + 1 :]
        texts.append(fresh(rng.randint(0, 30)) + p + fresh(rng.randint(0, 30)))
    texts += [None, "", "x", passages[0], passages[0], "ab" * 400, "q" * 700, "q" * 199, "y" * 200, "z" * 201]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0), (None, texts[40], 0)]
    want = Counter((i, *w) for (i, _, _), w in zip(rows, brute([t for _, t, _ in rows]), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = Counter(tuple(r) for r in sd.dedup_report(docs).collect())
    assert got == want and sum(w[2] > 0 for w in want) > 40


def test_no_rows(spark):
    assert sd.dedup_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
