"""Exact top-k search by inner product, with a pivot table.

Every row's distances to PIVOTS pivots are computed once and kept with it. For a query, the triangle inequality gives
each candidate a lower bound of its distance, the largest difference of two distances to one pivot, hence an upper bound
of its inner product: (|q|² + |v|² - bound²) / 2. Candidates are evaluated in order of that bound, in growing runs, until
the k-th best score is above the bound of the next.

Queries meet candidates in a grid of cells: candidates are dealt into blocks of about CELL rows, queries into blocks of
about QUERIES rows, and each cell takes one block of each; its best k of a query go to the final ranking. The pivots
come from a sample of at most SAMPLE rows, each the farthest from those before; they decide the speed, never the result.

Cases: vectors that are null or hold null or non-finite components take no part; vectors meet only vectors of their own
length; a repeated id is a row of its own, and rows that tie in score and id stand in any order; a query with fewer than
k candidates gets all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import map_batches, saved

PIVOTS, SAMPLE = 32, 4096
CELL, QUERIES = 8192, 1024
FIRST_RUN = 64
RESULT = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as long; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale))))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the farthest from those chosen before."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def index(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``uid, vec_id, dim, vec, dist``: the pivot table, with vectors and distances as packed numbers."""
    source = rows.select(F.col(id_column).cast("long").alias("vec_id"), whole_numbers(F.col(vector_column)).alias("v")).filter("v is not null")
    sample = source.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r.v)
    pivots = {d: choose_pivots(np.array(v, np.float64).reshape(len(v), d)) for d, v in by_dim.items()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors = batch.column(0), batch.column(1)
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        vec, dist = [b""] * len(ids), [b""] * len(ids)
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            x = flat[(ends[at] - d)[:, None] + np.arange(d)]
            p = pivots.get(int(d), np.zeros((0, d)))
            # one pivot after another: the differences of whole numbers are exact
            far = np.stack([np.sqrt(((x - q) ** 2).sum(axis=1)) for q in p], axis=1) if len(p) else np.zeros((len(at), 0))
            for i, a, b in zip(at, x.astype("<i8"), far.astype("<f8"), strict=True):
                vec[i], dist[i] = a.tobytes(), b.tobytes()
        return pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int32()), pa.array(vec, pa.binary()), pa.array(dist, pa.binary())], ["vec_id", "dim", "vec", "dist"])

    packed = map_batches(source, run, "vec_id long, dim int, vec binary, dist binary")
    return saved(packed.withColumn("uid", F.monotonically_increasing_id()))


def unpack(column: pa.ChunkedArray, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def search(q_uid, q_vec, q_dist, c_uid, c_id, c_vec, c_dist, k: int):
    """Positions and scores of the k best candidates of one query."""
    near = np.abs(c_dist - q_dist).max(axis=1, initial=0.0)
    norms = (c_vec.astype(np.float64) ** 2).sum(axis=1)
    bound = (norms + float((q_vec.astype(np.float64) ** 2).sum()) - near**2) / 2
    slack = 1e-6 * (1 + np.abs(bound).max(initial=0) + norms.max(initial=0))  # of the floating-point bounds
    order = np.argsort(-bound, kind="stable")
    order = order[c_uid[order] != q_uid]
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, run = 0, FIRST_RUN
    while at < len(order) and not (len(best) == k and scores[-1] > bound[order[at]] + slack):
        part = order[at : at + run]
        best, scores = np.r_[best, part], np.r_[scores, c_vec[part] @ q_vec]
        top = np.lexsort((c_id[best], -scores))[:k]
        best, scores = best[top], scores[top]
        at, run = at + run, 2 * run
    return best, scores


def top_k(rows: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row that the condition ``queries`` (on ``vec_id``) selects, against
    all other rows."""
    table = index(rows, id_column, vector_column)
    asked = table.filter(queries)
    n_c, n_q = -(-table.count() // CELL) or 1, -(-asked.count() // QUERIES) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    left = table.withColumn("c", block(n_c)).withColumn("q", each(n_q))
    right = asked.withColumn("q", block(n_q)).withColumn("c", each(n_c))

    def cell(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = candidates.num_rows, queries.num_rows
        out: list[tuple] = []
        if n and m:
            c_uid, c_id = candidates["uid"].to_numpy(), candidates["vec_id"].to_numpy()
            c_vec, c_dist = unpack(candidates["vec"], "<i8", n), unpack(candidates["dist"], "<f8", n)
            q_vec, q_dist = unpack(queries["vec"], "<i8", m), unpack(queries["dist"], "<f8", m)
            for i, (uid, q) in enumerate(zip(queries["uid"].to_pylist(), queries["vec_id"].to_pylist(), strict=True)):
                best, scores = search(uid, q_vec[i], q_dist[i], c_uid, c_id, c_vec, c_dist, k)
                out += [(uid, q, v, s) for v, s in zip(c_id[best].tolist(), scores.tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, RESULT, strict=True)], schema=RESULT)

    keys = ["dim", "c", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
