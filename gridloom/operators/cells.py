"""Value ranges, normalisation and macrocells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import CELL, cell_count, cell_of, clamp, normalize

AXES = ("x", "y", "z")


def value_range(voxels: DataFrame, *keys: str) -> DataFrame:
    """``lo, hi`` of all voxels, or for each value of the key columns."""
    return voxels.groupBy(*keys).agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))


def normalized(voxels: DataFrame, scope: str = "all") -> DataFrame:
    """Values mapped to [0, 1]: by the whole table's range, or with scope ``step`` by that of their time step."""
    if scope == "step":
        ranged = voxels.join(value_range(voxels, "t"), "t")
    else:
        ranged = voxels.join(F.broadcast(value_range(voxels)))  # one row
    return ranged.withColumn("v", normalize(F.col("v").cast("double"), F.col("lo"), F.col("hi"))).drop("lo", "hi").select(*voxels.columns)


def union_ranges(ranges: list[DataFrame], *keys: str) -> DataFrame:
    """The smallest ranges that hold all of the given ones."""
    return reduce(DataFrame.unionByName, ranges).groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def stack_steps(steps: list[DataFrame], dims: list[tuple] | None = None) -> DataFrame:
    """Voxel tables of one shape as a series with time step ``t``. Their columns and types must be the same, and their dims too, if
    these are given."""
    shapes = {tuple(sorted(s.dtypes)) for s in steps}
    if len(shapes) != 1:
        raise ValueError(f"time steps differ in columns or types: {sorted(shapes)}")
    if dims is not None and (len(dims) != len(steps) or len(set(map(tuple, dims))) != 1):
        raise ValueError(f"time steps differ in dims: {dims}")
    return reduce(DataFrame.unionByName, [s.withColumn("t", F.lit(i)) for i, s in enumerate(steps)])


def touched(i: Column) -> Column:
    """Cells along one axis that a voxel updates: its own and, from a cell's first or last voxel, the neighbour's."""
    own = cell_of(i)
    near = F.when(i % CELL == 0, own - 1).when(i % CELL == CELL - 1, own + 1)
    return F.when(near.isNull(), F.array(own)).otherwise(F.array(own, near))


def macrocells(voxels: DataFrame, nx: int, ny: int, nz: int, *keys: str) -> DataFrame:
    """``cx, cy, cz, vmin, vmax`` of the blocks of 16 voxels, each with the layer of voxels around it."""
    rows = voxels
    for axis, n in zip(AXES, (nx, ny, nz), strict=True):
        # only the axis' own column and the values are carried from here on
        rows = rows.withColumn(f"c{axis}", F.explode(touched(F.col(axis)))).filter(F.col(f"c{axis}").between(0, cell_count(n) - 1)).drop(axis)
    return rows.groupBy(*keys, "cx", "cy", "cz").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))


def incomplete_cells(voxels: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """``cx, cy, cz`` of the blocks of 16 voxels, with the layer of voxels around them, that have some voxels but not all; with ``t``
    in a series."""
    keys = ["t"] if "t" in voxels.columns else []
    rows, whole = voxels.select(*keys, *AXES), F.lit(1)
    for axis, n in zip(AXES, (nx, ny, nz), strict=True):
        rows = rows.withColumn(f"c{axis}", F.explode(touched(F.col(axis)))).filter(F.col(f"c{axis}").between(0, cell_count(n) - 1)).drop(axis)
        first = F.col(f"c{axis}") * CELL
        whole = whole * (F.least(first + CELL + 1, F.lit(n)) - F.greatest(first - 1, F.lit(0)))
    return rows.groupBy(*keys, "cx", "cy", "cz").agg(F.count("*").alias("n")).filter(F.col("n") < whole).select(*keys, "cx", "cy", "cz")


def point_voxels(points: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """Sample points ``px, py, pz, v`` in [0, 1) as voxels."""
    index = [clamp(F.floor(F.col(f"p{a}") * n), 0, n - 1).cast("int").alias(a) for a, n in zip(AXES, (nx, ny, nz), strict=True)]
    rest = [c for c in points.columns if c not in ("px", "py", "pz")]
    return points.select(*index, *rest)


def macrocells_of_points(points: DataFrame, nx: int, ny: int, nz: int, *keys: str) -> DataFrame:
    return macrocells(point_voxels(points, nx, ny, nz), nx, ny, nz, *keys)


def max_opacity(cells: DataFrame, alphas: Column, n: Column | int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Adds the highest opacity that a transfer function of n knots takes on a cell's range; 0 for untouched cells."""
    last = n - 1
    at = lambda v: F.floor((clamp(F.col(v), lo, hi) - lo) / (hi - lo) * last + 0.5).cast("int")
    first, end = F.greatest(at("vmin") - 1, F.lit(0)), F.least(at("vmax") + 1, F.lit(last) if isinstance(last, int) else last)
    return cells.withColumn("max_opacity", F.coalesce(F.array_max(F.slice(alphas, first + 1, end - first + 1)), F.lit(0.0)))


def with_cells(rows: DataFrame, cells: DataFrame, *keys: str) -> DataFrame:
    """Voxels or samples with the attributes of their cell; cells number 1/4096 of the voxels, so Spark decides how to join."""
    keyed = rows
    for a in AXES:
        keyed = keyed.withColumn(f"c{a}", cell_of(F.col(a)))
    return keyed.join(cells, [*keys, "cx", "cy", "cz"])


def skip_empty(rows: DataFrame, cells: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Rows of cells that are not transparent, in their own time step if both have one."""
    keys = [*(["t"] if "t" in rows.columns and "t" in cells.columns else []), "cx", "cy", "cz"]
    live = cells.filter(F.col("max_opacity") > epsilon).select(*keys)
    keyed = rows
    for a in AXES:
        keyed = keyed.withColumn(f"c{a}", cell_of(F.col(a)))
    return keyed.join(live, keys, "left_semi").select(*rows.columns)


def clip(rows: DataFrame, lower: tuple, upper: tuple) -> DataFrame:
    """Voxels in a box, upper bounds excluded."""
    inside = [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in zip(AXES, lower, upper, strict=True)]
    return rows.filter(inside[0] & inside[1] & inside[2])


def slabs(voxels: DataFrame, thickness: int = 16) -> DataFrame:
    """Voxels with the slab of z-slices that they are paged in."""
    return voxels.withColumn("slab", F.floor(F.col("z") / thickness).cast("int"))
