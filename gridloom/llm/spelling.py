"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie held in a table.

The trie's edges are rows ``(node, label) -> child``. A node is a prefix (its hash), and its depth is one of a fixed list of
boundaries, so an edge has a label of a few characters, longer further down; a word ends in an edge of its own with the
rest of its characters. A state ``(word, position, node, edits)`` says how much of a word has been read on the way to a node.
Level after level, states without an edit meet all edges of their node and stay, with one edit, where the label differs from
what the word goes on with by one edit; states with an edit meet only the edge that equals what the word goes on with. Those
that end with a word are its neighbours.

Two words one edit apart share their first or their last half. So there is a trie of the words and one of the words read
backwards, and a word enters each at the node of its first half, where few edges leave. A level's states are written to
the checkpoint folder. Nodes are told apart by 64-bit hashes; the neighbours that come out are compared as words, so a
collision costs time only.

Cases: null and blank texts have no words; a null id leaves its words whole; repeated rows count again; words of any length
have a number of levels that grows with its logarithm; columns beyond id and text are not looked at; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.text import Batches, stored

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least this many times as frequent as its variant.
RATIO = 2
#: Rows of counts that a task gathers before it sends them on.
GATHERED = 300_000


def dropped(word: bytes, h: int) -> bytes:
    """The UTF-8 word without the code point that ``h`` names."""
    text = word.decode()
    i = h % len(text)
    return (text[:i] + text[i + 1 :]).encode()


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_every: int | None = None) -> DataFrame:
    """``word, n``: runs of letters, lower-cased in A-Z, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences. With
    ``drop_every`` a run loses one code point where that number divides the crc32 of ``id:run``."""
    least = LEAST_LENGTH
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)

    def gather(batches: Batches) -> Batches:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = [w for w in total if len(w.decode()) >= least]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            for own, text in zip(ids, texts, strict=True):
                found = Counter(runs.findall((text.as_py() or b"").lower()))
                key = own.as_py()
                if drop_every is None or key is None:
                    for w, k in found.items():
                        total[w] = total.get(w, 0) + k
                else:
                    start = crc32(b"%d:" % key)
                    for w, k in found.items():
                        if (h := crc32(w, start)) % drop_every == 0:
                            w = dropped(w, h)
                        total[w] = total.get(w, 0) + k
                if len(total) > GATHERED:
                    yield flush()
        if total:
            yield flush()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(gather, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- the trie ------------------------------------------------------------------------------------------------------


def boundaries(longest: int) -> list[int]:
    """Depths of nodes, with one beyond the longest word: two characters apart, and further from each other further down."""
    found = [LEAST_LENGTH // 2]
    while found[-1] <= longest:
        found.append(found[-1] + (2 << (found[-1] // 12).bit_length()))
    return found


def part(text: Column, start, length) -> Column:
    """``length`` characters from the 0-based position ``start``."""
    return F.substring(text, start + 1, length)


def node(way: Column, text: Column, depth: int) -> Column:
    return F.xxhash64(way, F.substring(text, 1, depth))


def both_ways(words: DataFrame) -> DataFrame:
    """``way, s, n``: each word as it is and read backwards."""
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("s")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("s")))
    return words.select(F.explode(ways).alias("w"), "n").select("w.way", "w.s", "n")


def edge_table(oriented: DataFrame, depths: list[int], level: int) -> DataFrame:
    """Edges of the level's nodes: ``way, node, label, child`` and, where a word ends, ``s, n``."""
    at, after = depths[level], depths[level + 1]
    own = oriented.filter(F.length("s") > at)
    rows = own.select("way", node(F.col("way"), F.col("s"), at).alias("node"), part(F.col("s"), at, after - at).alias("label"), "s", "n")
    ends = F.length("s") <= after
    last = rows.filter(ends).select("way", "node", "label", F.lit(None).cast("long").alias("child"), F.col("s").alias("end"), F.col("n").alias("end_n"))
    inner = rows.filter(~ends).select("way", "node", "label", node(F.col("way"), F.col("s"), after).alias("child")).distinct()
    return last.unionByName(inner, allowMissingColumns=True)


STATE = ["way", "s", "n"]


def untouched(oriented: DataFrame, depths: list[int], level: int) -> DataFrame:
    """Words that have been read up to the level's node without an edit, from the last node within their first half on."""
    at, after = depths[level], depths[level + 1]
    own = oriented.filter((F.length("s") >= at) & (F.floor(F.length("s") / 2) < after))
    return own.select(*STATE, node(F.col("way"), F.col("s"), at).alias("node"))


def edited(states: DataFrame, edges: DataFrame, at: int, width: int) -> DataFrame:
    """All edges of the states' nodes whose label is one edit away from what the word goes on with."""
    one = lambda label, text: F.levenshtein(label, text, 1) == 1
    rest, label = F.substring(F.col("s"), at + 1, F.length("s")), F.col("label")
    left = F.length("s") - at
    stays = [(left >= width + d) & one(label, part(F.col("s"), at, width + d)) for d in (-1, 0, 1)]
    ends = F.col("child").isNull()
    near = (ends & one(label, rest)) | (~ends & reduce(Column.__or__, stays))
    places = F.array_compact(F.array(F.when(ends, F.lit(-1)), *[F.when(~ends & ok, F.lit(at + width + d)) for d, ok in zip((-1, 0, 1), stays, strict=True)]))
    return states.join(edges, ["way", "node"]).filter(near).select(*STATE, F.explode(places).alias("pos"), F.col("child").alias("node"), "end", "end_n")


def followed(states: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """The edge that equals what the word goes on with."""
    left = F.length("s") - F.col("pos")
    asked = states.filter(left > 0).select(*STATE, "pos", "node", F.substring(F.col("s"), F.col("pos") + 1, F.lit(width)).alias("label"), (left <= width).alias("ends"))
    keyed = edges.withColumn("ends", F.col("child").isNull())
    met = asked.join(keyed.withColumnRenamed("node", "from").withColumnRenamed("way", "edge_way"), (F.col("way") == F.col("edge_way")) & (F.col("node") == F.col("from")) & (asked["label"] == keyed["label"]) & (asked["ends"] == keyed["ends"]))
    return met.select(*STATE, F.when(F.col("child").isNull(), F.lit(-1)).otherwise(F.col("pos") + width).alias("pos"), F.col("child").alias("node"), "end", "end_n")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of the words ``word, n`` that one inserted, deleted or replaced code point
    makes equal, both ways round."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    depths = boundaries(max(longest, LEAST_LENGTH))
    oriented = stored(both_ways(words))
    frontier, found = None, []
    for level in range(len(depths) - 1):
        at, width = depths[level], depths[level + 1] - depths[level]
        edges = stored(edge_table(oriented, depths, level))
        states = edited(untouched(oriented, depths, level), edges, at, width)
        if frontier is not None:
            states = states.unionByName(followed(frontier, edges, width))
        states = stored(states)
        found.append(states.filter("node is null"))
        frontier = states.filter("node is not null")
    turned = lambda c: F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = reduce(DataFrame.unionByName, found).select(turned("s").alias("word"), "n", turned("end").alias("near"), F.col("end_n").alias("near_n"))
    return pairs.filter(F.levenshtein("word", "near", 1) == 1).repartition("word").dropDuplicates(["word", "near"])


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the most frequent neighbour if it is frequent enough, and the end of the
    chain of forms. Counts double along a chain, so chains are short; each round doubles the part that has been followed."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= RATIO * F.col("n")
    known = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    up = known.filter("form is not null").select("word", F.col("form").alias("up"), F.lit(True).alias("moved"))
    while True:
        onward = up.select(F.col("word").alias("up"), F.col("up").alias("next"))
        up = stored(up.join(onward, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            break
    return known.join(up, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_every: int | None = None) -> DataFrame:
    """Words of the documents with their frequent form and root; see ``word_counts`` and ``forms``."""
    words = stored(word_counts(docs, id_column, text_column, drop_every))
    return forms(words, neighbours(words))
