import random

import corpus_pipeline as cp
from gridloom.llm import mixing, quality, simhash
from pyspark.sql import functions as F

from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_quality_and_mixing import brute_measures
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(3000)]
    fresh = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n))
    shared = fresh(1)
    rows = [(i, fresh(rng.randint(5, 9)) + ("\n" + shared) * (i % 3 == 0), "en", rng.choice("abc"), 0) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace("\n", " and\n", 1), "en", "a", 0) for i in range(5)]  # near copies
    rows += [(200, "too short", "en", "a", 0), (201, None, "en", "b", 0), (202, "same words here " * 40, "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    texts = {i: t for i, t, *_ in rows}
    keep = []
    for i, t in texts.items():
        m = dict(zip(quality.MEASURES, brute_measures(t), strict=True))
        if not any(eval(rule, {}, m) for rule in quality.RULES.values()):
            keep.append(i)
    docs = cp.STAGES[0][1](spark, docs, "")
    assert sorted(r.doc_id for r in docs.collect()) == sorted(keep) and 202 not in keep

    want = {i: t for i, t in brute_lines([(i, texts[i]) for i in keep]).items() if t.split()}
    docs = cp.STAGES[1][1](spark, docs, "")
    assert {r.doc_id: r.text for r in docs.collect()} == want and all(r.n_chars == len(r.text) for r in docs.collect())

    names = sorted(want)
    root = brute_components([brute_fingerprint(want[i]) for i in names])
    docs = cp.STAGES[2][1](spark, docs, "")
    assert sorted(r.doc_id for r in docs.collect()) == sorted({names[r] for r in root})
    kept = docs.count()

    docs = cp.STAGES[3][1](spark, docs, "")
    assert docs.columns == cp.COLUMNS and kept <= docs.count() <= 2 * kept
    assert cp.STAGES[4][1](spark, docs, "").count() == docs.count()


CLASHING = ["__key", "__nth", "__plays", "__copies", "key", "row", "nth", "row_key", "plays", "copies", "times", "size", "word"]


def test_columns_named_like_the_helpers_keep_their_values(spark):
    rows = [(i, f"text {i % 4} of a few words " * 3, "ab"[i % 2]) for i in range(8)] + [(None, None, None), (9, "", None), (3, "text 3 of a few words " * 3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["0", "1", "2", "3", "9"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    for r in [*one.collect(), *mixed.collect()]:
        assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for c in CLASHING)


def test_edge_cases_of_the_whole_pipeline(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(2000)]
    good = ["\n".join(" ".join(rng.choices(words, k=15)) for _ in range(6)) for _ in range(4)]
    rows = [(1, good[0], "a"), (2, good[1], None), (None, good[2], "b"), (4, None, "a"), (5, "", "a"), (6, good[3], "b"), (6, good[3], "b"), (7, " \n\n\t", "c")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, __key string").repartition(3)
    docs.write.parquet(str(tmp_path / "some/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    got = cp.run(spark, str(tmp_path / "some"))
    ids = [r.doc_id for r in got.collect()]
    assert set(ids) <= {1, 2, None, 6} and ids and max(ids.count(i) for i in set(ids)) <= 2
    none = cp.run(spark, str(tmp_path / "none"))
    assert none.columns == got.columns and none.count() == 0
