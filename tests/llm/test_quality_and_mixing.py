import random
from collections import Counter

import pytest
from gridloom.llm import mixing, quality


def brute_measures(text):
    text = text or ""
    words = text.encode().split()
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(tri)
    covered = {p for i, t in enumerate(tri) if n[t] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


def texts():
    rng = random.Random(2)
    out = [None, "", " \n", "a", "a b a b a b", "x\nx\n\ny \nx", "#|<> é\x0bü", "w " * 60, "\x1c\x1c a\x85b"]
    for _ in range(60):
        out.append("".join(rng.choice(["aa ", "b ", "c\n", "dd\t", "# ", "é "]) for _ in range(rng.randint(0, 150))))
    return out


def test_ledger_policies_and_ablation(spark):
    rows = [(i, t, "k") for i, t in enumerate(texts())] + [(None, "a b", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failures string")
    ledger = quality.ledger(docs)
    got = {r.doc_id: r for r in ledger.collect()}
    names = list(quality.RULES)
    for i, t, _ in rows:
        m = dict(zip(quality.MEASURES, brute_measures(t), strict=True))
        assert tuple(got[i][c] for c in quality.MEASURES) == tuple(m.values())
        fails = [eval(rule, {}, m) for rule in quality.RULES.values()]
        assert got[i].failures == sum(f << b for b, f in enumerate(fails))
    policy = quality.POLICIES["standard", 1]
    kept = quality.filter_documents(docs, policy)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.failures == 0)
    for r in quality.ablation(ledger, policy).collect():
        bit = 1 << names.index(r.rule)
        assert r.n_failed == sum(x.failures & bit > 0 for x in got.values()) and r.n_only == sum(x.failures == bit for x in got.values())
    assert quality.ledger(docs.limit(0)).count() == 0


def water(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: rest * w[s] / total for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        rest -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def mixed_rows():
    rng = random.Random(3)
    sources = ["b", "a", "é", None, "zz", ""]
    out = [(i, "w " * rng.randint(0, 40), rng.choices(sources, [50, 5, 10, 5, 3, 2])[0], 1) for i in range(600)]
    return [*out, (900, None, "a", 1), (3, out[3][1], out[3][2], 1), (3, out[3][1], out[3][2], 1), (None, "w w", "b", 1)]


def test_targets_and_takes(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix_report(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _, _ in rows)
    totals: dict = {}
    for _, t, s, _ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    want = water(totals)
    by_size = {}
    for s, n in totals.items():
        by_size.setdefault(n, set()).add(round(want[s], 6))
    assert all(round(r.target, 6) in by_size[r.source_size] for r in got)
    taken: dict = {}
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.target] = taken.get(r.target, 0) + r.taken
    assert sum(taken.values()) <= 1.5 * sum(totals.values()) + 1e-6
    assert all(abs(n - t) <= 80 for t, n in taken.items())
    again = mixing.mix_report(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sum(size(r.text) for r in out.collect()) == sum(r.taken for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 1)]])
def test_nothing_to_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    assert sum(r.taken for r in mixing.mix_report(docs).collect()) == 0 and mixing.mixed_documents(docs).count() == 0
