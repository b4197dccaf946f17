"""Merkle manifest of a dataset: one digest for all rows, and for each row a proof that it is in it.

Rows of a group are ranked by id, and the digits of the rank say where a row stands in the group's tree. Within blocks of
``fan ** BLOCK_LEVELS`` rows the digit columns are grouped away one after the other, the lowest first, and each grouping
nests the structs of its children in their parent's; all groupings of a block stay in one partition. The tops of blocks are
the leaves of the next tier, and the groups' own roots those of one last tree. On the way down the part of the proof above
a block reaches it as one more row of its group, and a transform of the nested structs and an explode give each leaf the
digests beside its path.

Ranks come from one sort by ranges: positions within a partition, and sums over partitions within a group.

A node that is alone where others of its tree are not is hashed alone; a single leaf is its group's root. Equal leaves are
told apart by their ranks.

Cases: null values are ``-``; a null group is a group of its own, before others; a null id comes first; repeated rows
are leaves side by side, and so are different rows of one id, by their digests; texts of any length are hashed whole; an empty
table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import small_or_shuffled, stored

FAN = 2
#: Levels of one block, which one row holds with all its leaves.
BLOCK_LEVELS = 8
#: Rows of (partition, group) counts that are broadcast; more are joined by a shuffle.
MOST_COUNTS = 200_000
PROOF = "array<struct<pos:int,others:array<string>>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(column: Column) -> Column:
    """A value with its length in bytes before it, or ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[encoded(v) for v in values]))


@dataclass
class Tier:
    """Blocks of one tier of all groups' trees: ``key, block, n, h, kids``; n is the number of leaves of the group's tier."""

    blocks: DataFrame
    levels: int


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` within the row's ``key`` in the given order, and ``n``, the number of the key's rows. ``rows`` should be
    cheap to read twice."""
    place = stored(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()))
    in_part = F.shiftright("at", 33)
    parts = place.groupBy(in_part.alias("part"), "key").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    # a row for each partition and each key at most
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(parts.select("part", "key", (before - F.col("first")).alias("shift"), F.sum("size").over(own).alias("n")))
    keyed = place.withColumn("part", in_part)
    return keyed.join(small_or_shuffled(starts, MOST_COUNTS), ["part", "key"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def tier(leaves: DataFrame, fan: int, levels: int) -> Tier:
    """Nested blocks of the leaves ``key, rank, n, h, body``."""
    size = fan**levels
    digits = [(F.floor(F.col("rank") / F.lit(fan**j)) % fan).cast("int").alias(f"d{j}") for j in range(levels)]
    rows = leaves.select("key", F.floor(F.col("rank") / F.lit(size)).alias("block"), "n", *digits, "h", F.col("body").alias("kids")).repartition("key", "block")
    for j in range(levels):
        rest = [f"d{k}" for k in range(j + 1, levels)]
        children = F.array_sort(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), "h", "kids")), lambda a, b: a["d"] - b["d"])
        rows = rows.groupBy("key", "block", "n", *rest).agg(children.alias("kids"))
        alone = F.ceil(F.col("n") / F.lit(fan**j)) == 1  # the whole tree's only node on its level
        rows = rows.withColumn("h", F.when(alone, F.col("kids")[0]["h"]).otherwise(digest(F.array_join(F.col("kids.h"), ""))))
    return Tier(stored(rows.select("key", "block", "n", "h", "kids")), levels)


def tree(leaves: DataFrame, fan: int, levels: int) -> list[Tier]:
    """Tiers from the leaves up, until each key has one block."""
    tiers = [tier(leaves, fan, levels)]
    while not tiers[-1].blocks.filter("block > 0").isEmpty():
        tops = tiers[-1].blocks
        up = tops.select("key", F.col("block").alias("rank"), F.ceil(F.col("n") / F.lit(fan**levels)).alias("n"), "h", F.struct("block").alias("body"))
        tiers.append(tier(up, fan, levels))
    return tiers


def unfolded(one: Tier, above: DataFrame, fan: int) -> DataFrame:
    """``key, leaf, body, path, above`` of each leaf of a tier: path is its proof from the leaf to the root of all, above the
    struct that ``above`` (``key, block, path, above``) has for the leaf's block."""
    tops = above.select("key", "block", F.struct("path", "above").alias("over"))
    blocks = one.blocks.select("key", "block", F.struct("kids", "n").alias("tree"))
    both = blocks.unionByName(tops, allowMissingColumns=True).groupBy("key", "block")
    rows = both.agg(F.first("tree", ignorenulls=True).alias("tree"), F.first("over", ignorenulls=True).alias("over")).filter("tree is not null")
    found = F.array(F.struct(F.col("tree.kids").alias("kids"), F.col("over.path").alias("path")))
    for j in reversed(range(one.levels)):
        found = F.flatten(F.transform(found, opener(j, fan)))
    return rows.withColumn("leaf", F.explode(found)).select("key", F.col("leaf.h").alias("leaf"), F.col("leaf.kids").alias("body"), "leaf.path", "over.above")


def opener(j: int, fan: int) -> Callable[[Column], Column]:
    """Gives the children of a node on level j + 1 with their proofs: one step more than the node's, unless they are alone."""
    alone = F.ceil(F.col("tree.n") / F.lit(fan**j)) == 1

    def children(parent: Column) -> Column:
        digests = F.transform(parent["kids"], lambda k: k["h"])

        def child(kid: Column, i: Column) -> Column:
            others = F.concat(F.slice(digests, 1, i), F.slice(digests, i + 2, F.size(digests)))
            step = F.when(alone, F.array().cast(PROOF)).otherwise(F.array(F.struct(i.cast("int").alias("pos"), others.alias("others"))))
            return F.struct(kid["h"].alias("h"), kid["kids"].alias("kids"), F.concat(step, parent["path"]).alias("path"))

        return F.transform(parent["kids"], child)

    return children


def manifest(rows: DataFrame, fan: int = FAN, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``group, leaf, body, proof, subroot, root`` of each row. ``rows`` has ``group`` (string), ``id``, ``leaf`` (a digest) and a
    struct ``body``, which is only carried along."""
    key = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # bytewise, null first
    leaves = stored(rows.select(key.alias("key"), "id", F.col("leaf").alias("h"), F.struct("group", "body").alias("body")))
    tiers = tree(ranked(leaves, "id", "h"), fan, levels)
    subroots = tiers[-1].blocks.select(F.lit("").alias("key"), F.col("key").alias("name"), "h", F.struct(F.col("key").alias("name")).alias("body"))
    tops = tree(ranked(subroots, "name"), fan, levels)
    root = tops[-1].blocks.select("key", "block", F.array().cast(PROOF).alias("path"), F.struct(F.col("h").alias("root")).alias("above"))
    paths = root
    for k, one in reversed(list(enumerate(tops))):
        down = unfolded(one, paths, fan)
        if k:
            paths = down.select("key", F.col("body.block").alias("block"), "path", "above")
        else:
            paths = down.select(F.col("body.name").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.struct("above.root", F.col("leaf").alias("subroot")).alias("above"))
    for k, one in reversed(list(enumerate(tiers))):
        down = unfolded(one, paths, fan)
        if k:
            paths = down.select("key", F.col("body.block").alias("block"), "path", "above")
        else:
            return down.select("body.group", "leaf", "body.body", F.col("path").alias("proof"), "above.subroot", "above.root")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(node: Column, e: Column) -> Column:
        left, right = F.slice(e["others"], 1, e["pos"]), F.slice(e["others"], e["pos"] + 1, F.size(e["others"]))
        return digest(F.concat(F.array_join(left, ""), node, F.array_join(right, "")))

    return F.aggregate(proof, start, step)


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.flatten(F.transform(proof, lambda e: e["others"])), ""))


def documents_manifest(docs: DataFrame, fan: int = FAN, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, tampered`` of every document, grouped by language: tampered is its leaf with one
    more in ``n_chars``, for the ids that a check draws (7 divides the crc32 of the id), else null."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}
    drawn = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(drawn, leaf(*[more.get(c, F.col(c)) for c in fields]))
    rows = docs.select(F.col("lang").cast("string").alias("group"), F.col("doc_id").alias("id"), leaf(*[F.col(c) for c in fields]).alias("leaf"), F.struct("doc_id", changed.alias("tampered")).alias("body"))
    return manifest(rows, fan, levels).select("body.doc_id", "leaf", "subroot", "root", "proof", "body.tampered")
