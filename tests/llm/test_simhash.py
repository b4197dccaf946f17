import random

import numpy as np
import xxhash
from gridloom.llm import simhash
from gridloom.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Position -> component, by comparing all pairs."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    texts += [t + "  " for t in texts[:20]] + [None, "", " \n", "One", "ONE two", "é\x0bü\x1c x y"] + ["same text for many rows"] * 50
    long = " ".join(rng.choices(words, k=3000))
    texts += [long, long + " end", long.replace("w1 ", "w2 ", 1)]
    rows = [(i + 10, t, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(3)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i, _, _ in rows] == fps
    root = brute_components(fps)
    assert [got[i].component_id for i, _, _ in rows] == [rows[r][0] for r in root]


def test_trie_join_finds_every_close_pair():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)
    bits = np.unique(np.r_[centre, centre[rng.integers(0, 5, 400)] ^ flips[:, 0] ^ flips[:, 1] ^ np.where(flips[:, 2] % np.uint64(3) == 0, flips[:, 2], np.uint64(0))])
    group = np.zeros(len(bits), np.int64)
    found = {(i, j) for a, b in simhash.close_pairs(group, bits) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if int(bits[i] ^ bits[j]).bit_count() <= 2}
    assert found == want and len(want) > 20


def test_crowded_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 5)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    named = {r.node: r.component for r in connected_components(edges).collect()}
    root = brute_components(fps)
    got = [named.get(f, f) for f in signed]
    assert [got.index(g) for g in got] == [root.index(r) for r in root]


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (2, "q r s t u v", "z"), (None, "a b c d", "n"), (2, "q r s t u v", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted(simhash.keep_one(docs).collect()) == [(1, "a b c d", "y"), (2, "q r s t u v", "z")]
    assert simhash.groups(docs.limit(0)).count() == 0
