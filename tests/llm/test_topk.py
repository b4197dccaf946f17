import math

import numpy as np
import pytest
from gridloom.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    use = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(use):
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(m * n for m, n in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(use) if b != a and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("cell", [60, 8192])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "QUERIES", max(2, cell // 20))
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 0.3, (6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(0, 0.05, 8)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 460)] + [(500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8)]
    rows += [(700, [1.0, 2.0]), (701, [1.0, -2.0]), (750, []), (50, rows[3][1])]
    data = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(data, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(as_float, 5)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
