"""SimHash fingerprints and near-duplicate groups, linked by a self-join of binary tries.

Distinct fingerprints within two bits of each other agree on at least one of three blocks of bits. So each fingerprint
goes to three tries, rotated to begin with one of its blocks, and tries are dealt out by that block, where no bit may
differ. Below it, pairs of nodes are traversed together, level by level: a node meets itself and, with one bit more of
error, its sibling; pairs over the error budget are pruned; pairs of small nodes are compared outright. A block that
very many fingerprints share is dealt out by pairs of its nodes a few levels deeper.

A task reports the links as a spanning forest, which is all that components need; copies of a text share a fingerprint
and enter once. Components then come from rounds of DataFrame joins.

Cases: null and blank texts have fingerprint zero and are linked like others; texts of one or two words are one
shingle; repeated rows belong to one group; a null id never names a group unless all its ids are null; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.components import connected_components
from gridloom.llm.text import Batches, map_batches, saved, tasks_of, texts_of

WIDTH = 3
SEED = 42
#: (first bit from the left, length) of the blocks.
BLOCKS = [(0, 21), (21, 21), (42, 22)]
BUDGET = 2
#: A block with more fingerprints than this is dealt out by pairs of nodes this many levels deeper.
LARGE, DEEPER = 50_000, 6
DIRECT = 48


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` of each row; fp holds the 64 bits as a signed long, text_key is a hash of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in texts_of(batch.column(2))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    text = F.col(text_column)
    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")), run, "doc_id long, text_key long, fp long")


# --- the self-join of one task's tries ---------------------------------------------------------------------------


def products(a_lo, a_n, b_lo, b_n):
    """Indices of all pairs from ranges a and b, range pair by range pair."""
    sizes = a_n * b_n
    which = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a_lo[which] + nth // b_n[which], b_lo[which] + nth % b_n[which]


def close_pairs(group: np.ndarray, bits: np.ndarray, budget: int = BUDGET):
    """Pairs (i, j) of positions with one group number and at most ``budget`` differing bits, in parts. ``group`` and
    ``bits`` (uint64) are sorted together."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lo, hi = starts, np.r_[starts[1:], len(group)]
    own = hi - lo > 1
    lo, hi = lo[own], hi[own]
    cross = [np.zeros(0, np.int64) for _ in range(5)]  # a_lo, a_hi, b_lo, b_hi, error

    def near(i, j):
        ok = (np.bitwise_count(bits[i] ^ bits[j]) <= budget) & (i < j)
        return i[ok], j[ok]

    def direct(a_lo, a_n, b_lo, b_n):
        done = np.cumsum(a_n * b_n)
        for part in np.split(np.arange(len(a_lo)), np.flatnonzero(np.diff(done // 4_000_000)) + 1):
            if len(part):
                yield near(*products(a_lo[part], a_n[part], b_lo[part], b_n[part]))

    for depth in range(64):
        small = (hi - lo) ** 2 <= DIRECT
        yield from direct(lo[small], (hi - lo)[small], lo[small], (hi - lo)[small])
        lo, hi = lo[~small], hi[~small]
        c_small = (cross[1] - cross[0]) * (cross[3] - cross[2]) <= DIRECT
        a = [x[c_small] for x in cross]
        yield from direct(a[0], a[1] - a[0], a[2], a[3] - a[2])
        cross = [x[~c_small] for x in cross]
        if not len(lo) and not len(cross[0]):
            return
        below = np.r_[0, np.cumsum((bits >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        middle = lambda x, y: y - (below[y] - below[x])  # noqa: E731  where the node's second child begins
        mid = middle(lo, hi)
        am, bm = middle(cross[0], cross[1]), middle(cross[2], cross[3])
        e = cross[4]
        new = [
            (lo, mid, mid, hi, np.ones(len(lo), np.int64)),
            (cross[0], am, cross[2], bm, e),
            (am, cross[1], bm, cross[3], e),
            (cross[0], am, bm, cross[3], e + 1),
            (am, cross[1], cross[2], bm, e + 1),
        ]
        cross = [np.concatenate(x) for x in zip(*new, strict=True)]
        live = (cross[1] > cross[0]) & (cross[3] > cross[2]) & (cross[4] <= budget)
        cross = [x[live] for x in cross]
        lo, hi = np.r_[lo, mid], np.r_[mid, hi]
        own = hi - lo > 1
        lo, hi = lo[own], hi[own]
    if len(cross[0]):  # nodes of all 64 bits: equal up to the differences counted
        yield from direct(cross[0], cross[1] - cross[0], cross[2], cross[3] - cross[2])


def forest(n: int, pairs) -> np.ndarray:
    """Smallest position in the component of each of n positions."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def rotate(bits: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Left rotation."""
    by = by.astype(np.uint64)
    back = (np.uint64(64) - by) % np.uint64(64)
    return np.where(by == 0, bits, (bits << by) | (bits >> back))


def trie_links(batches: Batches) -> Batches:
    """Rows (part, first, fp) of a task -> spanning links (a, b) of its tries."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if b.num_rows]
    if not parts:
        return
    part, first, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    bits = rotate(fp.view(np.uint64), first)
    order = np.lexsort((bits, part))
    part, bits, fp = part[order], bits[order], fp[order]
    group = np.cumsum(np.r_[True, part[1:] != part[:-1]])
    root = forest(len(fp), close_pairs(group, bits))
    linked = root != np.arange(len(fp))
    if linked.any():
        yield pa.RecordBatch.from_arrays([pa.array(fp[root[linked]], pa.int64()), pa.array(fp[linked], pa.int64())], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (``fp``) at most two bits apart."""
    spark = distinct.sparkSession
    block = lambda first, n: F.shiftrightunsigned(F.col("fp"), 64 - first - n).bitwiseAND(F.lit((1 << n) - 1))
    tries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("first"), block(a, n).alias("block"), block((a + n) % 64, DEEPER).alias("below")) for k, (a, n) in enumerate(BLOCKS)])
    rows = saved(distinct.select("fp", F.explode(tries).alias("t")).select("fp", "t.*"))
    crowded = rows.groupBy("k", "block").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    # a node of the deeper level meets all nodes within the budget: each pair of them is a part of its own
    flips = [0, *[1 << i for i in range(DEEPER)], *[1 << i | 1 << j for i in range(DEEPER) for j in range(i)]]
    pair = lambda f: F.struct(F.least("below", F.col("below").bitwiseXOR(F.lit(f))), F.greatest("below", F.col("below").bitwiseXOR(F.lit(f))))
    node_pairs = F.when(F.col("n") > LARGE, F.array(*[F.xxhash64("k", "block", pair(f)) for f in flips])).otherwise(F.array(F.xxhash64("k", "block")))
    dealt = rows.join(crowded, ["k", "block"]).select(F.explode(node_pairs).alias("part"), "first", "fp")
    tasks = max(tasks_of(spark), rows.count() // 500_000)
    return dealt.repartition(tasks, "part").mapInArrow(trie_links, "a long, b long")


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_key, fp, root, component_id`` of each row: root is the smallest fingerprint of the row's group,
    component_id the smallest id."""
    rows = saved(fingerprints(docs, id_column, text_column))
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    named = connected_components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    labelled = classes.join(named, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(labelled.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id, of rows alike any one."""
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("first")
    chosen = groups(docs, id_column, text_column).groupBy("root").agg(first).select(F.xxhash64("first.doc_id", "first.text_key").alias("key"))
    # The documents' columns stay in one struct, apart from the helpers.
    keyed = docs.select(F.xxhash64(F.col(id_column).cast("long"), F.xxhash64(text_column)).alias("key"), F.struct("*").alias("row"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return keyed.join(chosen, "key", "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
