"""Multi-resolution hash-grid summaries: fit, reconstruct and measure. (``models`` keeps them.)

Level after level, positions are hashed to slots and each slot keeps the mean of what the levels before left over. A
level has at most ``slots`` rows, whatever the volume's size. With ``blend`` a voxel adds to the slots of the eight grid
points around it, by trilinear weights, and is read back from them by the same weights.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import centre
from gridloom.operators.sampling import steps
from gridloom.sources.tables import forget, stored

AXES = ("x", "y", "z")
#: The published hash's primes for y and z (x has 1).
PRIMES = (1, 2654435761, 805459861)
MASK = 4294967295
#: A level's rows (a number and a mean each) are broadcast if it has at most this many slots.
MOST_BROADCAST = 1 << 20


@dataclass(frozen=True)
class Config:
    levels: int = 8
    base: int = 16
    scale: float = 2.0
    log2_slots: int = 19
    blend: bool = False

    @property
    def slots(self) -> int:
        return 1 << self.log2_slots

    def cells(self, level: int) -> float:
        return self.base * self.scale**level - 1

    def resolution(self, level: int) -> int:
        return math.ceil(self.cells(level)) + 1


def numbered(config: Config, level: int, at: list[Column]) -> Column:
    """Slot of a grid point of a level: a dense number if the level's grid fits, else the xor of multiplied coordinates."""
    r = config.resolution(level)
    if r**3 <= config.slots:
        return at[0] + at[1] * r + at[2] * r * r
    mixed = [(c * p).bitwiseAND(F.lit(MASK)) for c, p in zip(at, PRIMES, strict=True)]
    return mixed[0].bitwiseXOR(mixed[1]).bitwiseXOR(mixed[2]) % config.slots


def nearest_slot(config: Config, level: int, dims: tuple) -> Column:
    """The slot of the level's cell that a voxel's centre lies in."""
    r = config.resolution(level)
    centres = [centre(F.col(a), n) for a, n in zip(AXES, dims, strict=True)]
    return numbered(config, level, [F.least(F.floor(c * r), F.lit(r - 1)).cast("long") for c in centres])


def slots_of(config: Config, level: int, dims: tuple) -> Column:
    """``array<struct<slot, w>>``: the slots of a voxel on a level with their weights."""
    if not config.blend:
        return F.array(F.struct(nearest_slot(config, level, dims).alias("slot"), F.lit(1.0).alias("w")))
    r = config.resolution(level)
    centres = [centre(F.col(a), n) for a, n in zip(AXES, dims, strict=True)]
    places = [c * config.cells(level) + 0.5 for c in centres]
    low = [F.floor(p).cast("long") for p in places]
    corners = []
    for corner in itertools.product((0, 1), repeat=3):
        at = [F.least(i + d, F.lit(r - 1)) for i, d in zip(low, corner, strict=True)]
        w = [p - i if d else 1 - (p - i) for p, i, d in zip(places, low, corner, strict=True)]
        corners.append(F.struct(numbered(config, level, at).alias("slot"), (w[0] * w[1] * w[2]).alias("w")))
    return F.filter(F.array(*corners), lambda c: c["w"] > 0)


def voxel_slots(rows: DataFrame, config: Config, level: int, dims: tuple) -> DataFrame:
    """Adds ``slot, w``: once for each slot that a voxel adds to. Unblended grids have one slot a voxel and explode nothing."""
    if not config.blend:
        return rows.withColumn("slot", nearest_slot(config, level, dims)).withColumn("w", F.lit(1.0))
    return rows.withColumn("s", F.explode(slots_of(config, level, dims))).select(*rows.columns, "s.slot", "s.w")


def slot_sums(rows: DataFrame, config: Config, level: int, dims: tuple) -> DataFrame:
    """``slot, wr, w, n`` of voxels with what is left of their values (``r``): sums that add up over parts of a volume."""
    keys = steps(rows)
    return voxel_slots(rows, config, level, dims).groupBy(*keys, "slot").agg(F.sum(F.col("w") * F.col("r")).alias("wr"), F.sum("w").alias("w"), F.count("*").alias("n"))


def means_of(sums: DataFrame) -> DataFrame:
    """``slot, mean, n`` of sums of parts, added up."""
    keys = steps(sums)
    return sums.groupBy(*keys, "slot").agg((F.sum("wr") / F.sum("w")).alias("mean"), F.sum("n").alias("n"))


def left_over(rows: DataFrame, means: DataFrame, config: Config, level: int, dims: tuple) -> DataFrame:
    """The voxels ``x, y, z, r`` with a level's share taken off ``r``. ``means`` has at most ``slots`` rows for each step."""
    keys = [*steps(rows), *AXES]
    found = means.select(*steps(means), "slot", "mean")
    if "t" not in means.columns and config.slots <= MOST_BROADCAST:
        found = F.broadcast(found)
    read = voxel_slots(rows, config, level, dims).join(found, [*(k for k in steps(rows) if k in means.columns), "slot"])
    read = read.select(*keys, "r", (F.col("w") * F.col("mean")).alias("part"))
    if config.blend:
        read = read.groupBy(*keys).agg(F.first("r").alias("r"), F.sum("part").alias("part"))
    return read.select(*keys, (F.col("r") - F.col("part")).alias("r"))


def fit(voxels: DataFrame, dims: tuple, config: Config) -> DataFrame:
    """``level, slot, mean, n``, for each step (``t``) of a series. A level needs one aggregation and one join with its at most
    ``slots`` rows (and one more aggregation if blended); means and what is left over are written to the shared folder, so
    that no level is computed again. ``n`` counts the voxels that add to a slot."""
    model, left = None, voxels.select(*steps(voxels), *AXES, F.col("v").cast("double").alias("r"))
    written = None
    for level in range(config.levels):
        means = stored(means_of(slot_sums(left, config, level, dims)), "means")
        found = means.select(*steps(means), F.lit(level).alias("level"), "slot", "mean", "n")
        model = found if model is None else model.unionByName(found)
        if level + 1 < config.levels:
            left = stored(left_over(left, means, config, level, dims), "left")
        if written is not None:
            forget(written)
        written = left if level + 1 < config.levels else None
    return model


def reconstruct(points: DataFrame, model: DataFrame, dims: tuple, config: Config) -> DataFrame:
    """``x, y, z, v``: the sum of the levels' means at each voxel, in each step (``t``) of a series' model or in the points' own.
    A level's rows are broadcast where its slots are few enough, so that unblended values come without a shuffle; otherwise
    all levels are met in one join."""
    own = steps(model)
    if not config.blend and not own and config.slots <= MOST_BROADCAST:
        rows = points.select(*steps(points), *AXES).withColumn("v", F.lit(0.0))
        for level in range(config.levels):
            found = model.filter(F.col("level") == level).select("slot", "mean")
            rows = rows.withColumn("slot", nearest_slot(config, level, dims)).join(F.broadcast(found), "slot")
            rows = rows.select(*steps(points), *AXES, (F.col("v") + F.col("mean")).alias("v"))
        return rows

    def of_level(level: int) -> Column:
        return F.transform(slots_of(config, level, dims), lambda c: F.struct(F.lit(level).alias("level"), c["slot"].alias("slot"), c["w"].alias("w")))

    each = F.concat(*map(of_level, range(config.levels)))
    rows = points.select(*steps(points), *AXES, F.explode(each).alias("s")).select(*steps(points), *AXES, "s.level", "s.slot", "s.w")
    met = rows.join(model.select(*own, "level", "slot", "mean"), [*(k for k in own if k in rows.columns), "level", "slot"])
    return met.groupBy(*dict.fromkeys([*own, *steps(points)]), *AXES).agg(F.sum(F.col("w") * F.col("mean")).alias("v"))


def size_report(model: DataFrame, dims: tuple, voxel_bytes: int = 4, value_bytes: int = 4) -> DataFrame:
    """``level, slots, bytes`` and the ratio of the volume's bytes to all levels' up to this one."""
    from pyspark.sql import Window

    levels = model.groupBy("level").agg(F.count("*").alias("slots")).withColumn("bytes", F.col("slots") * value_bytes)
    upto = F.sum("bytes").over(Window.orderBy("level"))  # a handful of rows
    return levels.select("level", "slots", "bytes", (F.lit(float(dims[0] * dims[1] * dims[2] * voxel_bytes)) / upto).alias("ratio"))
