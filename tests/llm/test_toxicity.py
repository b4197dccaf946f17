import itertools
import random

import numpy as np
import pytest
from gridloom.llm import toxicity as tx


def brute_kernel(a, b):
    def phi(w):
        marked = [-1, -2, *w, -3]
        out = {}
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if k - i < tx.STRETCH:
                u = (marked[i], marked[j], marked[k])
                out[u] = out.get(u, 0) + tx.DECAY ** (k - i + 1)
        return out

    x, y = phi(a), phi(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_equals_brute_force():
    words = ["idiot", "idxiot", "banana", "the", "aaaaaaa", "abcabcabc", "otherword"]
    got = tx.Landmarks.of(words[:4]).kernel(words)
    want = [[brute_kernel(w, m) for m in words[:4]] for w in words]
    assert np.allclose(got, want, atol=1e-5)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"], k=rng.randint(1, 4))) for _ in range(400)]
    insults = ["gromble", "snarkwit", "pifflehead", "vonkus"]
    rows, labels = [], []
    for i in range(500):
        words = rng.choices(plain, k=60)
        toxic = i % 5 == 1
        if toxic:
            for w in rng.sample(insults, 2):
                words[rng.randrange(60)] = w
        rows.append((i, " ".join(words) + ".", 0))
        labels.append((i, toxic * 1, i))
    probes = ["the gro.mble ed", "the g r o m b l e ed", "the snarxkwit ed", "the pif flehead ed", "V-O-N-K-U-S ", "on er theed", "", None, "a b", "x" * 5000]
    rows += [(10_000 + i, p, 0) for i, p in enumerate(probes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, source int")


def test_held_out_accuracy_and_obfuscated_insults(data):
    got = {r.doc_id: r for r in tx.score_documents(*data).collect()}
    assert len(got) == 510
    held = [i for i in range(500) if got[i].held_out]
    assert len(held) > 60 and sum(got[i].predicted == (i % 5 == 1) for i in held) / len(held) > 0.97
    assert [got[10_000 + i].predicted for i in range(10)] == [1] * 5 + [0] * 5
    assert all(0 <= r.score <= 1 for r in got.values())


def test_without_labels_or_rows(spark, data):
    docs, labels = data
    assert max(r.score for r in tx.score_documents(docs.limit(5), labels.limit(0)).collect()) < 1e-6
    assert tx.score_documents(docs.limit(0), labels).count() == 0


def brute_score(machine, text):
    """The score by its definition: every reading of every span, every subsequence of three letters."""

    def decision(word):
        if len(word) < 3:
            return machine.bias
        marked = tx.letters([word])[0].tolist()
        found = {}
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if k - i < tx.STRETCH:
                code = marked[i] << 12 | marked[j] << 6 | marked[k]
                found[code] = found.get(code, 0) + tx.DECAY ** (k - i + 1)
        norm = sum(v * v for v in found.values()) ** 0.5
        return machine.bias + sum(machine.weights[code] * v for code, v in found.items()) / norm

    best = max((decision(w) for s in tx.spans(text or "", machine.splits) for w in tx.readings(s)), default=machine.bias)
    return 1 / (1 + np.exp(-(machine.slope * max(best, machine.bias) + machine.offset)))


def test_scores_equal_brute_force(data):
    docs, labels = data
    machine = tx.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in tx.score_documents(docs, labels).collect()}
    for r in docs.select("doc_id", "text").filter("doc_id % 25 = 1 or doc_id >= 10000").collect():
        assert np.isclose(got[r.doc_id].score, brute_score(machine, r.text), atol=1e-6)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def rare_insults(spark, n=600, seed=9):
    """Half of the texts are toxic; besides common insults these have words that stand in 3 % and 1.5 % of them."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"], k=rng.randint(1, 4))) for _ in range(400)]
    rows, labels, rare = [], [], {}
    for i in range(2 * n):
        words = rng.choices(plain, k=40)
        toxic = i % 2
        if toxic:
            share = i // 2 / n
            insult = "zorbak" if share < 0.03 else "quivlunt" if share < 0.045 else rng.choice(["gromble", "snarkwit"])
            words[rng.randrange(40)] = insult
            rare[i] = insult
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rare


def test_rare_insults_are_learnt(spark):
    docs, labels, rare = rare_insults(spark)
    got = {r.doc_id: r.predicted for r in tx.score_documents(docs, labels).collect()}
    for insult in ("zorbak", "quivlunt", "gromble"):
        own = [got[i] for i, w in rare.items() if w == insult]
        assert len(own) > 5 and sum(own) / len(own) > 0.9, insult
    assert sum(p for i, p in got.items() if i not in rare) / len(got) < 0.01
