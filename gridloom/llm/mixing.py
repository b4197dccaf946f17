"""Mixing sources to target weights by weighted fair queueing.

Each source plays its documents in a shuffled order, pass after pass. A play's virtual finish time is the number
of its source's tokens played so far, divided by the source's target: a source reaches its target at time 1. All
plays are ordered by finish time and the mix ends where its tokens reach the budget, the sum of the targets.

The running sums are taken in two levels, so no source's rows meet in one task: plays are dealt by source, pass and
a slice of the shuffle order, sums of slices are accumulated (a few rows per source), and the sum within a slice is
added. The cut is found alike: finish times fall into ranges, ranges are summed, the range in which the budget ends is
divided again in this way, and only the small range in which it ends then is ordered row by row.

Cases: null text has size 0 and takes nothing; a null source is a source of its own, ordered last; repeated rows are
rows of their own, ordered among themselves by row number; an empty table gives an empty mix. The order is
drawn from md5 of seed, pass and id, so runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.text import WORD, saved

#: Slices of a pass: the first three hexadecimal digits of the shuffle order. Ranges of finish time for each unit.
SLICE_DIGITS = 3
RANGES = 2048
LAST_RANGE = 4 * RANGES


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources. ``sizes`` has one row per source: ``source, source_size``.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A target
    stops at ``most`` times its source's size and the excess is shared anew by weight until none is above. In closed
    form: a source is at its limit if and only if limit / weight is at most the final level, and the level is found in
    order of limit / weight. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank + 1).cast("int")).cast("double")
    rows = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("rest_w"))
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("w"))
    )
    # the level of the first source that isn't full holds for all that aren't
    open_sources = F.when(~F.col("full"), F.struct((F.col("limit") / F.col("w")).alias("order"), F.col("level").alias("level")))
    final = F.min(open_sources).over(everything)["level"]
    return rows.withColumn("final", final).select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("final") * F.col("w")).alias("target"))


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``uid, row_key, id, source, size`` of each document; uid numbers rows, as ids may repeat, and row_key is a hash of
    the row."""
    row_key = F.xxhash64(id_column, source_column, text_column).alias("row_key")
    return docs.select(F.monotonically_increasing_id().alias("uid"), row_key, F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"))


def plays(sizes: DataFrame, aims: DataFrame, passes: int = 2, seed: str = "mix") -> DataFrame:
    """Every play of every document, with its finish time: uid, row_key, id, source, size, pass, pick, vft.

    ``passes`` is the most times that a document can be taken; the targets' limit must not exceed it.
    """
    number = F.col("pass").cast("string")
    name = F.col("id").cast("string")
    pick = F.md5(F.concat_ws("|", F.lit(seed), number, F.coalesce(name, F.lit(""))))
    by_source = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null")]
    rows = (
        sizes.filter("size > 0")
        .withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
        .withColumn("pick", pick)
        .select("*", *by_source, F.substring("pick", 1, SLICE_DIGITS).alias("slice"))
    )
    where = ["s", "s_null", "pass", "slice"]
    earlier = Window.partitionBy("s", "s_null").orderBy("pass", "slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(*where).agg(F.sum("size").alias("in_slice"))
    slices = slices.withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)))
    slices = slices.join(F.broadcast(aims.select(*by_source, "target")), ["s", "s_null"]).drop("in_slice")
    within = Window.partitionBy(*where).orderBy("pick", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("run", F.sum("size").over(within))
        .join(slices, where)
        .select("uid", "row_key", "id", "source", "size", "pass", "pick", ((F.col("before") + F.col("run")) / F.col("target")).alias("vft"))
    )


def ends_in(rows: DataFrame, label: str, start: Column, limit: str) -> DataFrame:
    """Adds ``before`` and ``upto``, the running totals at both ends of each row's range ``label``, which follow ``start``; ranges that
    begin beyond ``limit`` are left out. There are a few thousand ranges at most."""
    totals = rows.groupBy(label).agg(F.sum("size").alias("in_range"), F.max(start).alias("start"), F.max(limit).alias("most"))
    upto = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.col("start") + F.sum("in_range").over(upto)).withColumn("before", F.col("upto") - F.col("in_range"))
    totals = totals.filter(F.col("before") <= F.col("most")).select(label, "before", "upto")
    return rows.drop("before", "upto").join(F.broadcast(totals), label)


def cut(stream: DataFrame, budget: DataFrame) -> DataFrame:
    """The plays, in order of finish time, whose running total is within ``budget`` (one row, one column). The range in which
    the budget ends is cut into ranges again, and only the one of these in which it ends is ordered row by row."""
    at = F.col("vft") * RANGES
    number = F.least(F.floor(at), F.lit(LAST_RANGE)).cast("long")
    fine = F.least(F.floor((at - F.col("range")) * RANGES), F.lit(RANGES - 1)).cast("long")
    ranged = stream.withColumn("range", number).withColumn("fine", fine).crossJoin(F.broadcast(budget.toDF("budget")))  # one row
    rows = ends_in(ranged, "range", F.lit(0), "budget")
    parts = ends_in(rows.filter("upto > budget"), "fine", F.col("before"), "budget")
    by_time = Window.orderBy("vft", "pick", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    last = parts.filter("upto > budget").withColumn("run", F.sum("size").over(by_time)).filter("before + run <= budget")
    whole = rows.filter("upto <= budget").select(*stream.columns).unionByName(parts.filter("upto <= budget").select(*stream.columns))
    return whole.unionByName(last.select(*stream.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sizes, aims, taken)``: sizes of documents, targets of sources, and the plays in the mix."""
    sizes = saved(sized(docs, id_column, text_column, source_column))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = saved(targets(totals, weights, share, most))
    budget = sizes.agg((F.coalesce(F.sum("size"), F.lit(0)) * F.lit(share)).alias("budget"))
    return sizes, aims, cut(saved(plays(sizes, aims, int(most), seed)), budget)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted)."""
    sizes, aims, taken = mix(docs, **options)
    times = taken.groupBy("uid").agg(F.sum("size").alias("taken"))
    rows = sizes.join(times, "uid", "left")
    named = F.broadcast(aims.withColumnRenamed("source", "name"))
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("name")), "left")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents of the mix with all their columns; one that is taken twice stands twice.

    Texts are shuffled once, by a hash of the row. Rows that are alike share the plays of that hash evenly.
    """
    sizes, _, taken = mix(docs, weights, share, most, seed, id_column, text_column, source_column)
    times = taken.groupBy("row_key").agg(F.count("*").alias("plays"))
    copies = sizes.groupBy("row_key").agg(F.count("*").alias("copies"))
    # The documents' columns stay in one struct, apart from the helpers.
    keyed = docs.select(F.xxhash64(id_column, source_column, text_column).alias("row_key"), F.struct("*").alias("row"))
    rows = keyed.join(times.join(copies, "row_key"), "row_key")
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    share_of = F.floor(F.col("plays") / F.col("copies")).cast("int") + F.when(nth <= F.col("plays") % F.col("copies"), 1).otherwise(0)
    rows = rows.withColumn("times", share_of).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")
