"""Sampling of voxel tables at points of the unit cube."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.functions.scalars import clamp, coordinates, unit_hash

AXES = ("x", "y", "z")


def steps(df: DataFrame) -> list[str]:
    """The key of a series' time steps, if the table has one."""
    return ["t"] if "t" in df.columns else []


def random_points(spark: SparkSession, n: int, seed: int = 1337, lower=(0.0, 0.0, 0.0), upper=(1.0, 1.0, 1.0)) -> DataFrame:
    """``point_id, px, py, pz``: uniform in a box; a point depends on its number and the seed alone."""
    unit = lambda k: unit_hash(F.col("id"), F.lit(seed), F.lit(k))
    return spark.range(n).select(F.col("id").alias("point_id"), *[(lo + unit(k) * (hi - lo)).alias(f"p{a}") for k, (a, lo, hi) in enumerate(zip(AXES, lower, upper, strict=True))])


def grid_points(spark: SparkSession, nx: int, ny: int, nz: int, nodes: bool = False) -> DataFrame:
    """Points of a regular grid: centres of its cells, or with ``nodes`` its nodes from 0 to 1."""
    if nodes and min(nx, ny, nz) < 2:
        raise ValueError("a grid of nodes has at least 2 on each axis")
    xyz = coordinates(F.col("id"), nx, ny)
    place = [(i / (n - 1) if nodes else (i + 0.5) / n).alias(f"p{a}") for a, i, n in zip(AXES, xyz, (nx, ny, nz), strict=True)]
    return spark.range(nx * ny * nz).select(F.col("id").alias("point_id"), *[i.alias(a) for a, i in zip(AXES, xyz, strict=True)], *place)


def corner_weights(p: Column, n: int, unit: bool = True) -> Column:
    """The two grid points around a position on one axis, in [0, 1] or in voxel units, with their weights; past the outer centres
    both are one."""
    q = clamp(p * n if unit else p, 0.5, n - 0.5) - 0.5
    i = F.floor(q).cast("int")
    f = q - i
    return F.array(F.struct(i.alias("i"), (1 - f).alias("w")), F.struct(F.least(i + 1, F.lit(n - 1)).alias("i"), f.alias("w")))


def trilinear(points: DataFrame, voxels: DataFrame, nx: int, ny: int, nz: int, id_column: str = "point_id", unit: bool = True) -> DataFrame:
    """``id, v``: eight corners per point, one join on the voxel, one sum. Corners of weight zero are not looked up. In a
    series (``t``), points with a time step are looked up in it and others in every step, and ``t`` is part of the result.
    On a sparse grid a missing voxel adds nothing. Points are in the unit cube, or in voxel units if not ``unit``."""
    own = [k for k in steps(voxels) if k in points.columns]
    rows = points
    for a, n in zip(AXES, (nx, ny, nz), strict=True):
        rows = rows.withColumn(f"c{a}", F.explode(corner_weights(F.col(f"p{a}"), n, unit))).filter(f"c{a}.w > 0")
    corners = rows.select(id_column, *own, F.col("cx.i").alias("x"), F.col("cy.i").alias("y"), F.col("cz.i").alias("z"), (F.col("cx.w") * F.col("cy.w") * F.col("cz.w")).alias("w"))
    return corners.join(voxels, [*own, *AXES]).groupBy(*steps(voxels), id_column).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def corner_table(voxels: DataFrame) -> DataFrame:
    """``x, y, z, f0 … f7`` (with ``t`` in a series): what lies at the eight grid points from each place on; bits of f's number tell
    the step along x, y and z. Its size is known once it has been shuffled, so that it is not broadcast by a guess."""
    keys = [*steps(voxels), *AXES]
    bits = [[k >> a & 1 for a in range(3)] for k in range(8)]
    shifts = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, b, strict=True)]) for k, b in enumerate(bits)])
    rows = voxels.select(*keys, "v", F.explode(shifts).alias("s"))
    rows = rows.select(*steps(voxels), *[(F.col(a) - F.col(f"s.d{a}")).alias(a) for a in AXES], F.col("s.k").alias("k"), "v")
    rows = rows.filter(" and ".join(f"{a} >= 0" for a in AXES))
    return rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("k") == k, F.col("v"))).alias(f"f{k}") for k in range(8)])


def trilinear_by_corners(points: DataFrame, table: DataFrame, dims: tuple) -> DataFrame:
    """The points (in voxel units, without their places) with their values ``v`` from a corner table: as ``trilinear``, but a point
    is sent once and not summed up again."""
    own = [k for k in steps(table) if k in points.columns]
    carried = [c for c in points.columns if c not in ("t", "px", "py", "pz")]
    q = {f"q{a}": clamp(F.col(f"p{a}"), 0.5, n - 0.5) - 0.5 for a, n in zip(AXES, dims, strict=True)}
    rows = points.select(*own, *carried, *[c.alias(name) for name, c in q.items()])
    rows = rows.select(*own, *carried, *[F.floor(f"q{a}").cast("int").alias(a) for a in AXES], *[(F.col(f"q{a}") - F.floor(f"q{a}")).alias(f"q{a}") for a in AXES])
    rows = rows.join(table.hint("merge"), [*own, *AXES])  # both are large; neither may be broadcast by a guess
    values, there = F.lit(0.0), F.lit(False)
    for k in range(8):
        near = [F.col(f"q{a}") if k >> i & 1 else 1 - F.col(f"q{a}") for i, a in enumerate(AXES)]
        there = there | (F.col(f"f{k}").isNotNull() & (near[0] > 0) & (near[1] > 0) & (near[2] > 0))
        values = values + F.coalesce(near[0] * near[1] * near[2] * F.col(f"f{k}"), F.lit(0.0))
    return rows.filter(there).select(*steps(table), *carried, values.alias("v"))


def nearest(points: DataFrame, voxels: DataFrame, nx: int, ny: int, nz: int, unit: bool = True) -> DataFrame:
    """The points with the value of the voxel that they lie in, in each time step of a series (or in the points' own). Points
    are in the unit cube, or in voxel units if not ``unit``: scaling these down and up again could move one to a neighbour."""
    own = [k for k in steps(voxels) if k in points.columns]
    rows = points.drop(*AXES)
    for a, n in zip(AXES, (nx, ny, nz), strict=True):
        place = F.col(f"p{a}") * n if unit else F.col(f"p{a}")
        rows = rows.withColumn(a, F.floor(clamp(place, 0.5, n - 0.5)).cast("int"))
    return rows.join(voxels, [*own, *AXES])


def gradient(voxels: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """Adds gx, gy, gz: forward differences over one grid step (1/n), backward where there is no voxel ahead, zero where
    there is none on either side."""
    out = voxels
    for a, n in zip(AXES, (nx, ny, nz), strict=True):
        line = Window.partitionBy(*steps(voxels), *[b for b in AXES if b != a]).orderBy(a)
        ahead = F.when(F.lead(a).over(line) == F.col(a) + 1, F.lead("v").over(line) - F.col("v"))
        behind = F.when(F.lag(a).over(line) == F.col(a) - 1, F.col("v") - F.lag("v").over(line))
        out = out.withColumn(f"g{a}", F.coalesce(ahead, behind, F.lit(0.0)) * n)
    return out


def resample(spark: SparkSession, voxels: DataFrame, dims: tuple, new_dims: tuple) -> DataFrame:
    """The volume on a grid of new_dims nodes, by trilinear lookup."""
    nodes = grid_points(spark, *new_dims, nodes=True)
    values = trilinear(nodes, voxels, *dims)
    return nodes.select("point_id", *AXES).join(values, "point_id").select(*steps(voxels), *AXES, "v")


def sample_field(points: DataFrame, field: Callable) -> DataFrame:
    """Values of a user's field: ``field(px, py, pz)`` gets and gives numpy arrays, batch by batch."""
    def run(batches):
        for batch in batches:
            table = pa.table(batch)
            values = field(*(table[f"p{a}"].to_numpy() for a in AXES))
            yield from table.append_column("v", pa.array(values, pa.float64())).to_batches()

    return points.mapInArrow(run, StructType([*points.schema.fields, StructField("v", DoubleType())]))
