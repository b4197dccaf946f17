import random
import re
from collections import Counter, defaultdict
from zlib import crc32

from gridloom.llm import queries, spelling
from pyspark.sql import functions as F

from tests.llm.sql import rows_of_sql


def brute_words(rows, drop_every):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{doc_id}:{run}".encode())
            if drop_every and doc_id is not None and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = defaultdict(set)
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(((-words[u], u) for u in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def documents(seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abéñ", k=rng.randint(4, 9))) for _ in range(60)] + ["ab" * 12 + "é" * k for k in range(6)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ab" * 300, "ab" * 300 + "b", "x" + "ab" * 300]
    rows = []
    for i in range(300):
        words = rng.choices(stems[::-1], [1 / (k + 2) for k in range(len(stems))], k=20)
        words = [w[:j] + rng.choice(["", "a", "é", "ab"]) + w[j + 1 :] if rng.random() < 0.4 else w for w in words for j in [rng.randrange(len(w))]]
        rows.append((i, rng.choice([" ", "-", "\n", "4"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return [*rows, (None, "nulls nulls nulls"), (500, None), (501, ""), (502, "ÀÁÂ÷ÿþ×ýü ÀÁÂ÷ÿþ×ýü ÀÁÂ÷ÿþ×ýü Àáçdé Àáçdé ĀÀáçdé"), *rows[:5]]


def got(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "id", "way", "s")})
    return sorted(map(tuple, spelling.variants(docs.repartition(3), **options).collect()), key=str)


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GATHERED", 50)
    rows = documents()
    for drop_every in (None, 3):
        want = brute(brute_words(rows, drop_every))
        assert got(spark, rows, drop_every=drop_every) == want
        assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_ties_go_to_the_first_in_code_point_order(spark):
    rows = [(1, "hällo " * 8 + "hallo " * 8 + "hxllo " * 3 + "hxlloo " * 1000)]
    found = {r[0]: r for r in got(spark, rows)}
    assert found["hxllo"][1:4] == ("hxlloo", "hxlloo", 3) and found["hallo"][1] is None
    found = {r[0]: r for r in got(spark, [(1, "hällo " * 8 + "hallo " * 8 + "hxllo " * 4)])}
    assert found["hxllo"] == ("hxllo", "hallo", "hallo", 4, 2, 8)


def test_empty_table(spark):
    assert got(spark, [(1, None)]) == [] and got(spark, [(1, "once")]) == []


def test_boundaries_grow():
    depths = spelling.boundaries(1_000_000)
    assert depths[:6] == [2, 4, 6, 8, 10, 12] and len(depths) < 120


def test_query_equals_sql(spark):
    assert rows_of_sql(spark, queries, "op13_spelling")
