import random

import numpy as np
import pytest
from gridloom.llm import minhash, queries
from pyspark.sql import functions as F

from tests.llm.sql import rows_of_sql


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, by comparing all pairs."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {b" ".join(words)} if words else set())
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    out = [(d, len(s), least[r], d is not None and d == least[r]) for (d, _), s, r in zip(rows, sets, root)]
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "n", "key", "bands", "component_id")})
    return sorted(map(tuple, minhash.groups(docs.repartition(3)).collect()), key=str)


def edited(rng, words, share):
    return [rng.choice("αβγδε") + w if rng.random() < share else w for w in words]


def collection(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for size in (1, 2, 3, 5, 8, 9, 12, 30, 80, 300, 1200):
        base = rng.choices(vocabulary, k=size)
        rows += [" ".join(edited(rng, base, share)) for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1)]
        rows += [" ".join(base + rng.choices(vocabulary, k=max(1, size // 8))), "  ".join(base).upper() + "\n"]
    hub = rng.choices(vocabulary, k=100)
    rows += [" ".join(edited(rng, hub, 0.025)) for _ in range(60)]  # many near and many just too far
    rows += [None, "", " \t\n", None, "é\x0bü\x1c x y"] + ["same text in many rows"] * 40
    ids = list(range(10, 10 + len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows), (None, "same text in many rows"), (None, "a null id alone is here"), (11, rows[0]), (11, "another text of eleven"), (None, None)]


@pytest.mark.parametrize(("seed", "block"), [(5, 256), (6, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = collection(seed)
    found = got(spark, rows)
    assert found == brute(rows)
    assert sum(not r[3] for r in found) > 80


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 50_021}" for i in range(120_000))
    rows = [(1, long), (2, long + " more"), (3, "short text here")]
    assert [r[2] for r in got(spark, rows)] == [1, 1, 3]
    assert got(spark, rows[2:]) == [(3, 1, 3, True)]
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs_that_no_star_has(spark):
    """A bucket whose smallest node is near none of the others still links these, once for two components."""
    same = [list(range(32))] * 5
    classes = spark.createDataFrame([(n, 100, bytes([k]) * 256, b) for (n, k), b in zip(enumerate((1, 2, 2, 3, 2)), same)], "node long, n long, sketch binary, bands array<long>")
    sets = spark.createDataFrame([(n, np.arange(100 * k, 100 * k + 100, dtype=np.uint64).tobytes()) for n, k in enumerate((1, 2, 2, 3, 2))], "node long, shingles binary")
    members = spark.createDataFrame([(key, 0, n) for key in (0, 5) for n in (1, 2, 3, 4)], "key long, hub long, node long")

    def links(named):
        return sorted(map(tuple, minhash.across(minhash.open_members(members, spark.createDataFrame(named, "node long, component long"), classes), classes, sets).collect()))

    assert links([]) == [(1, 2), (1, 4)]
    assert links([(1, 1), (2, 1)]) == [(1, 4)]
    assert links([(n, 1) for n in (1, 2, 3, 4)]) == []


def test_signature_estimates_and_recall():
    """Equal bins estimate the similarity for small and large sets, and pairs at 0.85 share a band and enough bytes."""
    rng = np.random.default_rng(1)
    for size in (7, 20, 100, 1000):
        missed, equal = 0, []
        for _ in range(200):
            hashes = rng.integers(0, 2**64, size + 1, dtype=np.uint64)
            out = max(1, round(0.15 * size)) if size > 7 else 1
            a, b = np.sort(hashes[:size]), np.sort(hashes[out:size])
            x, y = minhash.signature(a), minhash.signature(b)
            equal.append((x == y).mean() - len(b) / len(a))
            missed += not ((minhash.bands(x) == minhash.bands(y)).any() and (x.astype(np.uint8) == y.astype(np.uint8)).sum() >= minhash.SKETCH)
        assert abs(np.mean(equal)) < 0.03 and missed <= 1


def test_query_equals_sql(spark):
    assert rows_of_sql(spark, queries, "op12_minhash")
