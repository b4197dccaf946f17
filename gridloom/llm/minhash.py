"""MinHash near-duplicates: one-permutation signatures with optimal densification, banded buckets, star-shaped candidates.

A document's set holds the hashes of its distinct three-word shingles. The hash's first byte names one of 256 bins, and the
signature keeps each bin's smallest hash; an empty bin takes the value of another one, which it finds by an order of its own
over all bins, so that values stay independent of each other. Thirty-two bands of eight bins give a pair at 0.85 a miss of
(1 - 0.85 ** 8) ** 32, about 4 in 100,000, and less above.

Documents with one set are one node. A bucket of nodes that share a band links all of them to its smallest node, a star, and
not with each other. Links are confirmed on the full sets: sets are sent to where their star's centre is, and stars are cut
into slices. Where a bucket's nodes are in different components after that, all its pairs that could still matter are
compared by one byte of each bin, in blocks of bounded size, and those at SKETCH equal bytes or more are confirmed as well;
nothing is capped. (A pair at 0.85 has 218 equal bytes of 256 on average with a standard deviation of about 6.)

Cases: null and blank texts have an empty set and are linked with nothing; fewer than three words are one shingle; a null id
never names a component unless all its ids are null, and is not kept; rows of one id are rows of their own; repeated rows share a
component; texts of any length are read whole; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import connected_components
from gridloom.llm.text import Batches, map_batches, small_or_shuffled, stored, texts_of

WIDTH = 3
#: Link at this many hundredths of the union in common, or more.
NEAR = 85
BINS, ROWS = 256, 8
BANDS = BINS // ROWS
#: Equal sketch bytes from which a pair is confirmed on its sets.
SKETCH = 192
#: Nodes of a bucket whose pairs are compared in one block and their shingles, parts of a star, and rows that are broadcast.
BLOCK, BLOCK_SHINGLES, SLICES, MOST_ROWS = 256, 1_000_000, 4096, 1_000_000

#: For each bin the order in which it looks for a filled one.
SEEKS = np.random.default_rng(42).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
ODD = np.random.default_rng(43).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < WIDTH:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[: len(words) - WIDTH + 1].tolist(), ends[WIDTH - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in spans), np.uint64, len(words) - WIDTH + 1))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have enough in common."""
    every = np.sort(np.concatenate((a, b)), kind="stable")  # two sorted runs to merge
    common = int((every[1:] == every[:-1]).sum())
    return 100 * common >= NEAR * (len(every) - common)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, or that of the filled bin that an empty one finds first."""
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # hashes are sorted, so a bin's first is its smallest
    found, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    found[bins[first]], filled[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        seeks = SEEKS[empty]
        found[empty] = found[seeks[np.arange(len(empty)), filled[seeks].argmax(axis=1)]]
    return found


def bands(found: np.ndarray) -> np.ndarray:
    mixed = (found.reshape(BANDS, ROWS) * ODD).sum(axis=1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * ODD[:, 0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, text_key, n, set_key, sketch, bands`` of each row."""
    schema = "doc_id long, text_key long, n long, set_key binary, sketch binary, bands array<long>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, sketches, found = [], [], [], []
        for text in texts_of(batch.column(2)):
            hashes = shingles(text)
            sizes.append(len(hashes))
            if not len(hashes):
                keys.append(None), sketches.append(None), found.append(None)
                continue
            least = signature(hashes)
            keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            sketches.append(least.astype(np.uint8).tobytes())
            found.append(bands(least))
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "set_key", "sketch", "bands"])

    text = F.col(text_column)
    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")), run, schema)


# --- candidates ----------------------------------------------------------------------------------------------------


def buckets(classes: DataFrame) -> DataFrame:
    """``key, hub, node``: the other nodes of each bucket with its smallest."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub"))
    return stored(keyed.join(small_or_shuffled(shared, MOST_ROWS), "key").filter("node != hub"))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sketches and sizes allow a link."""
    own = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    rows = pairs.join(own("b"), "b").join(own("a"), "a").filter(NEAR * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
        return batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= SKETCH))

    return map_batches(rows.select("a", "b", "s_a", "s_b"), run, "a long, b long")


def open_members(members: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, node, component, parts`` of buckets whose nodes, but for the centre of the star, are in several components;
    ``parts`` blocks hold about BLOCK nodes and BLOCK_SHINGLES shingles each."""
    labelled = members.join(named, "node", "left").join(classes.select("node", "n"), "node").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    parts = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), parts.alias("parts")).filter("lo < hi")
    return stored(labelled.join(small_or_shuffled(stored(open_keys.select("key", "parts")), MOST_ROWS), "key").select("key", "node", "component", "parts"))


def compared(batches: Batches) -> Batches:
    """Rows (part, side, key, node, component, n, sketch, bands, shingles), sorted by part -> links between components, by full
    sets. A part has one or two blocks of a bucket's nodes (sides 0 and 1); with two, only pairs across them count. A pair is
    looked at in the first bucket that it shares, and no more once its components have met in this part."""
    held: list[tuple] = []
    part = None

    def links() -> pa.RecordBatch:
        side, key, node, component, n = (np.array([r[i] for r in held], np.int64) for i in range(1, 6))
        sketch = np.frombuffer(b"".join(r[6] for r in held), np.uint8).reshape(-1, BINS)
        own_bands = np.array([r[7] for r in held], np.int64)
        sets = [np.frombuffer(r[8], np.uint64) for r in held]
        two, found = side.min() != side.max(), []
        for i in range(len(node)):
            ok = (component != component[i]) & (node > node[i]) & (NEAR * np.maximum(n, n[i]) <= 100 * np.minimum(n, n[i]))
            if two:
                ok &= side != side[i]
            j = np.flatnonzero(ok)
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= SKETCH]
            first = (own_bands[j] == own_bands[i]).argmax(axis=1)
            for k in j[own_bands[i][first] == key[i]].tolist():
                if component[k] != component[i] and near(sets[i], sets[k]):
                    found.append((node[i], node[k]))
                    component[component == component[k]] = component[i]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != part and held:
                yield links()
                held = []
            part = row[0]
            held.append(row)
    if held:
        yield links()


def across(rows: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of open buckets."""
    full = rows.join(classes.select("node", "n", "sketch", "bands"), "node").join(sets, "node")
    # blocks of a bucket, and a part for each pair of them
    rows = full.withColumn("mine", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    with_other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.xxhash64("key", F.least(F.col("mine"), o), F.greatest(F.col("mine"), o)).alias("part"), (F.col("mine") > o).cast("int").alias("side")))
    rows = rows.withColumn("p", F.explode(with_other)).select("p.part", "p.side", "key", "node", "component", "n", "sketch", "bands", "shingles")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(compared, "a long, b long").distinct()


# --- confirmation --------------------------------------------------------------------------------------------------


def full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``node, shingles`` of the nodes: texts of one row for each are read again."""
    asked = stored(classes.select("node", "row_key", "set_key").join(small_or_shuffled(stored(nodes), MOST_ROWS), "node", "left_semi"))
    keyed = docs.select(F.xxhash64(F.col(id_column).cast("long"), F.xxhash64(text_column)).alias("row_key"), F.col(text_column).alias("text"))
    rows = keyed.join(small_or_shuffled(asked, MOST_ROWS), "row_key").select("node", "set_key", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t).tobytes() for t in texts_of(batch.column(2))]
        right = [xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column(1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"]).filter(pa.array(right))

    return stored(map_batches(rows, run, "node long, shingles binary").dropDuplicates(["node"]))


def linked(batches: Batches) -> Batches:
    """Rows (a, slice, b, shingles), in each slice first the centre's (b null), then its others' -> confirmed pairs."""
    centre, mine = np.zeros(0, np.uint64), None
    for batch in batches:
        a, _, b, sets = batch.columns
        found = []
        for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
            own = np.frombuffer(sets[i].as_buffer(), np.uint64)
            if y is None:
                centre, mine = own.copy(), x
                continue
            assert mine == x
            if near(centre, own):
                found.append((x, y))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The pairs ``a, b`` that are near enough by their full sets."""
    pairs = stored(pairs.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(SLICES)).cast("int")))
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(nodes, docs, classes, id_column, text_column)
    centres = pairs.select("a", "slice").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "slice", F.lit(None).cast("long").alias("b"), "shingles")
    others = pairs.join(sets.withColumnRenamed("node", "b"), "b").select("a", "slice", "b", "shingles")
    dealt = centres.unionByName(others).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    return stored(dealt.mapInArrow(linked, "a long, b long"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row."""
    rows = stored(signed(docs, id_column, text_column))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key"))
    sets = rows.filter("n > 0").groupBy("set_key").agg(first.alias("row"), *[F.first(c).alias(c) for c in ("n", "sketch", "bands")])
    classes = stored(sets.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("row.doc_id").alias("least_id"), F.xxhash64("row.doc_id", "row.text_key").alias("row_key"), "n", "sketch", "bands"))
    members = buckets(classes)
    stars = members.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(likely(stars, classes), docs, classes, id_column, text_column)
    named = stored(connected_components(links))
    rest = open_members(members, named, classes)
    more = across(rest, classes, full_sets(rest.select("node").distinct(), docs, classes, id_column, text_column))
    ends = named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    named = connected_components(ends)
    labelled = stored(classes.select("node", "set_key", "least_id").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    label = labelled.join(least, "component").select("set_key", "component_id")
    ids = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    found = rows.select("doc_id", "n", "set_key").join(label, "set_key", "left").withColumn("component_id", ids)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
