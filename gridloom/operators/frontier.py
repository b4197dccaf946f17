"""Ray marching in rounds: only lines that are not opaque yet are sampled on.

The samples of a line are numbered through all cells it crosses, and cut into chunks that double in length, so a line has a
number of rounds that grows with the logarithm of its samples. A round looks up one chunk's samples of the lines that are
still alive, folds colours and transmittance in, and writes the lines' state; a line whose state is opaque has no samples in
later rounds. Stretches of lines are stored by chunk, so that a round reads its own only. A sample without a voxel around it is
none and has no number: in cells that lack voxels, each sample is a stretch of its own if there are voxels around it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import adaptive_step, even_steps
from gridloom.operators.cells import incomplete_cells
from gridloom.operators.lines import AXES, OPAQUE, live_stretches, sampled, transmittance
from gridloom.operators.sampling import corner_table, steps, trilinear_by_corners
from gridloom.sources.tables import forget, stored

#: Samples of the first chunk.
FIRST = 16


def chunk_of(i: Column, first: int = FIRST) -> Column:
    """Number of the chunk that holds sample i: chunk c begins at first * (2 ** c - 1)."""
    return F.length(F.bin(F.floor(i / F.lit(first)) + 1)) - 1


def with_voxels(rows: DataFrame, voxels: DataFrame, corners: DataFrame, dims: tuple) -> DataFrame:
    """The stretches with the number ``i0`` of their first sample. Those in cells that lack voxels are cut into their samples that
    have voxels around them."""
    lacking = stored(incomplete_cells(voxels, *dims).withColumn("lacks", F.lit(True)), "lacking")
    if lacking.isEmpty():
        forget(lacking)
        return rows.withColumn("i0", F.lit(0).cast("long"))
    flagged = stored(rows.join(lacking, [*steps(rows), "cx", "cy", "cz"], "left"), "flagged")
    each = flagged.filter("lacks").withColumn("i0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("n", F.lit(1).cast("long")).drop("lacks")
    t = F.col("c0") + (F.col("i0") + 0.5) * F.col("dist")
    ids = each.select(*steps(each), F.struct(*[c for c in each.columns if c != "t"]).alias("point_id"), *[(F.col(f"o{a}") + t * F.col(f"d{a}")).alias(f"p{a}") for a in AXES])
    there = trilinear_by_corners(ids, corners, dims).select(*steps(each), "point_id.*")
    return flagged.filter("lacks is null").drop("lacks").withColumn("i0", F.lit(0).cast("long")).unionByName(there)


def stretches(rays: DataFrame, voxels: DataFrame, corners: DataFrame, cells: DataFrame, dims: tuple, step: float, adaptive: bool, first: int) -> DataFrame:
    """Stretches of the lines with the number ``before`` of samples ahead of them, their own number ``n`` and that of the whole line,
    ``samples``, once for every chunk that they have samples in."""
    rows = live_stretches(rays, cells, dims)
    n, ds = even_steps(F.col("c0"), F.col("c1"), adaptive_step(step, F.col("max_opacity")) if adaptive else F.lit(step))
    rows = with_voxels(rows.withColumn("n", n.cast("long")).withColumn("dist", ds), voxels, corners, dims)
    line = Window.partitionBy(*steps(rows), "ray_id")
    ahead = line.orderBy("step", "i0").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("samples", F.sum("n").over(line))
    chunks = F.sequence(chunk_of(F.col("before"), first), chunk_of(F.col("before") + F.col("n") - 1, first))
    return rows.select(*steps(rows), "ray_id", *[f"{k}{a}" for k in "od" for a in AXES], "c0", "dist", "n", "i0", "before", "samples", F.explode(chunks).alias("chunk"))


def samples_of_chunk(rows: DataFrame, chunk: int, first: int, jitter: float = 0.5) -> DataFrame:
    begin, end = first * ((1 << chunk) - 1), first * ((1 << (chunk + 1)) - 1)
    numbers = F.sequence(F.greatest(F.col("before"), F.lit(begin)), F.least(F.col("before") + F.col("n"), F.lit(end)) - 1)
    each = rows.withColumn("k", F.explode(numbers))
    t = F.col("c0") + (F.col("k") - F.col("before") + F.col("i0") + jitter) * F.col("dist")
    return each.select(*steps(rows), "ray_id", "k", *[(F.col(f"o{a}") + t * F.col(f"d{a}")).alias(f"p{a}") for a in AXES], "dist")


def frontier_march(
    rays: DataFrame,
    voxels: DataFrame,
    cells: DataFrame,
    dims: tuple,
    transfer: Callable[[Column], Column],
    colours: Mapping[str, Callable[[Column], Column]],
    step: float = 1.0,
    rate: float = 1.0,
    adaptive: bool = True,
    first: int = FIRST,
) -> DataFrame:
    """``ray_id``, the colours' front-to-back sums, ``alpha``, ``clear`` (what is left of the light), ``looked`` (samples that were
    looked up), ``rounds`` and ``samples`` (all that the ray has), for each ray that crosses a cell that is not transparent; with ``t`` in a series. The colours
    are functions of a sample's value."""
    corners = stored(corner_table(voxels), "corners")
    all_stretches = stored(stretches(rays, voxels, corners, cells, dims, step, adaptive, first), "stretches", by="chunk")
    line = [*steps(all_stretches), "ray_id"]
    last = all_stretches.agg(F.max("chunk")).first()[0]
    zero = [F.lit(0.0).alias(c) for c in (*colours, "alpha")]
    state = stored(all_stretches.filter("chunk = 0").select(*line, "samples").distinct().select(*line, "samples", *zero, F.lit(1.0).alias("clear"), F.lit(0).cast("long").alias("looked"), F.lit(0).alias("rounds")), "state")
    for chunk in range(-1 if last is None else last + 1):
        alive = state.filter(1 - F.col("clear") < OPAQUE).select(*line, F.col("clear").alias("clear0"))
        if alive.isEmpty():
            break
        own = all_stretches.filter(F.col("chunk") == chunk).join(alive, line, "left_semi")
        values = sampled(samples_of_chunk(own, chunk, first), corners, dims, transfer, rate)
        folded = transmittance(values, line, "k").join(alive, line).withColumn("clear", F.col("clear") * F.col("clear0"))
        seen = 1 - F.col("clear") < OPAQUE
        part = lambda c: F.coalesce(F.sum(F.when(seen, F.col("clear") * F.col("a") * c)), F.lit(0.0))
        sums = [part(f(F.col("v"))).alias(f"add_{c}") for c, f in colours.items()]
        left = F.min(F.when(seen, F.col("clear") * (1 - F.col("a")))).alias("left")
        added = folded.groupBy(*line).agg(*sums, part(F.lit(1.0)).alias("add_alpha"), left, F.count("*").alias("n"))
        joined = state.join(added, line, "left")
        grown = [(F.col(c) + F.coalesce(f"add_{c}", F.lit(0.0))).alias(c) for c in (*colours, "alpha")]
        after = joined.select(*line, "samples", *grown, F.coalesce("left", "clear").alias("clear"), (F.col("looked") + F.coalesce("n", F.lit(0))).alias("looked"), (F.col("rounds") + F.col("n").isNotNull().cast("int")).alias("rounds"))
        after = stored(after, "state")
        forget(state)
        state = after
    forget(all_stretches)
    forget(corners)
    return state
