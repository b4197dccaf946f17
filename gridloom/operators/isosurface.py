"""Isosurfaces by marching cubes: each voxel is sent to its brick, and to those whose upper layer it is, one shuffle in all; dual cells are put together there."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import linear_id, triangle_normal
from gridloom.operators.brick_sampling import BRICK, brick_voxels
from gridloom.operators.sampling import steps
from gridloom.operators.scan import BLOCK, running_sums
from gridloom.sources.tables import scratch

#: Corner order of a cell and the corners of its edges, as in the usual numbering.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
EDGES = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]
#: Corners of the faces in order around them, seen from outside.
FACES = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (2, 3, 7, 6), (0, 4, 7, 3), (1, 2, 6, 5)]
EDGE_OF = {frozenset(e): i for i, e in enumerate(EDGES)}


def case_edges(case: int) -> list[int]:
    """Edges of a case's triangles, three for each, from a rule: on each face the surface leaves where a corner at or
    below the isovalue follows one above it, and each such corner run of a face is cut off from the others; the pieces
    join to loops, and loops are cut into fans. Loops are walked against the order of the faces, so normals point to the
    side of lower values."""
    below = [bool(case >> k & 1) for k in range(8)]
    follow: dict[int, int] = {}
    for face in FACES:
        ring = list(pairwise([*face, face[0]]))
        enters = [i for i, (a, b) in enumerate(ring) if not below[a] and below[b]]
        for i in enters:
            j = next(k % 4 for k in range(i + 1, i + 5) if below[ring[k % 4][0]] and not below[ring[k % 4][1]])
            follow[EDGE_OF[frozenset(ring[i])]] = EDGE_OF[frozenset(ring[j])]
    out, left = [], set(follow)
    while left:
        first = edge = min(left)
        loop = []
        while not loop or edge != first:
            loop.append(edge)
            left.discard(edge)
            edge = follow[edge]
        for a, b in pairwise(loop[1:]):
            out += [first, b, a]
    return out


def cases_array() -> Column:
    """The edges of all 256 cases as one literal."""
    return F.array(*[F.array(*[F.lit(e) for e in case_edges(c)]) if case_edges(c) else F.array().cast("array<int>") for c in range(256)])


def corners(voxels: DataFrame, nx: int, ny: int, nz: int, size: int = BRICK) -> DataFrame:
    """Dual cells ``x, y, z, cell_id`` (with ``t`` in a series) with their corner values ``f0`` to ``f7``. Cells of a sparse
    grid that lack a corner are left out."""
    time = steps(voxels)
    rows = brick_voxels(voxels, size).filter(F.col("v").isNotNull())
    kinds = ", ".join([*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in time], "x int, y int, z int", *[f"f{k} double" for k in range(8)]])
    cells = rows.groupBy("bx", "by", "bz", *time).applyInArrow(lambda key, found: brick_corners(key, found, size, time), kinds)
    cells = cells.filter(F.col("x").between(0, nx - 2) & F.col("y").between(0, ny - 2) & F.col("z").between(0, nz - 2))
    return cells.withColumn("cell_id", linear_id(F.col("x"), F.col("y"), F.col("z"), nx - 1, ny - 1))


def brick_corners(key: tuple, voxels: pa.Table, size: int, time: list[str]) -> pa.Table:
    """The cells of a brick that have all corners."""
    low = [k.as_py() * size for k in key[:3]]
    at = tuple(voxels.column(a).to_numpy() - first for a, first in zip("xyz", low, strict=True))
    values, there = np.full((size + 1,) * 3, -np.inf), np.zeros((size + 1,) * 3, bool)
    # of a voxel given twice the larger value
    np.maximum.at(values, at, voxels.column("v").to_numpy())
    there[at] = True
    views = [tuple(slice(d, size + d) for d in corner) for corner in CORNERS]
    cells = np.nonzero(np.logical_and.reduce([there[view] for view in views]))
    columns = {k: pa.repeat(v, len(cells[0])) for k, v in zip(time, key[3:], strict=True)}
    columns |= {a: pa.array((i + first).astype(np.int32)) for a, i, first in zip("xyz", cells, low, strict=True)}
    return pa.table(columns | {f"f{k}": pa.array(values[view][cells]) for k, view in enumerate(views)})


def with_case(cells: DataFrame, iso: float) -> DataFrame:
    """Adds ``case``: a bit for each corner at or below the isovalue."""
    bits = [F.when(F.col(f"f{k}") <= iso, 1 << k).otherwise(0) for k in range(8)]
    return cells.withColumn("case", sum(bits[1:], bits[0]))


def active(cells: DataFrame, iso: float) -> DataFrame:
    """Cells that the surface passes, with ``edges`` and ``n_verts``."""
    rows = with_case(cells, iso).filter(~F.col("case").isin(0, 255))
    return rows.withColumn("edges", F.element_at(cases_array(), F.col("case") + 1)).withColumn("n_verts", F.size("edges"))


def vertex(e: Column, iso: float) -> list[Column]:
    """Where the surface cuts edge ``e`` of a row's cell, in voxel units with voxel centres at .5."""
    pick = lambda table, at: F.element_at(F.array(*[F.lit(x) for x in table]), at)
    values = F.array(*[f"f{k}" for k in range(8)])
    a, b = (pick([x[i] for x in EDGES], e + 1) + 1 for i in (0, 1))
    fa, step = F.element_at(values, a), F.element_at(values, b) - F.element_at(values, a)
    t = F.when(F.abs(step) < 0.001, 0.0).otherwise((F.lit(iso) - fa) / F.nullif(step, F.lit(0.0)))
    ends = [[pick([c[k] for c in CORNERS], end) for end in (a, b)] for k in range(3)]
    return [F.col(axis) + c0 + t * (c1 - c0) + 0.5 for axis, (c0, c1) in zip("xyz", ends, strict=True)]


def vertices(active_cells: DataFrame, iso: float) -> DataFrame:
    """``cell_id, n, vx, vy, vz``: the n-th vertex of each cell, with ``t`` in a series."""
    rows = active_cells.withColumns({"n": F.explode(F.sequence(F.lit(0), F.col("n_verts") - 1))})
    place = vertex(F.element_at("edges", F.col("n") + 1), iso)
    return rows.select(*steps(rows), "cell_id", "n", *[v.alias(f"v{axis}") for v, axis in zip(place, "xyz", strict=True)])


def triangles(active_cells: DataFrame, iso: float) -> DataFrame:
    """One row per triangle: ``cell_id, tri, ax … cz`` and its normal ``nx, ny, nz``. All corners are in the cell's row, so
    nothing is shuffled."""
    rows = active_cells.withColumn("tri", F.explode(F.sequence(F.lit(0), (F.col("n_verts") / 3).cast("int") - 1)))
    keys = [*steps(rows), "cell_id", "tri"]
    places = [(f"{p}{axis}", v) for i, p in enumerate("abc") for axis, v in zip("xyz", vertex(F.element_at("edges", F.col("tri") * 3 + i + 1), iso), strict=True)]
    rows = rows.select(*keys, *[v.alias(name) for name, v in places])
    normal = triangle_normal(*[tuple(F.col(f"{p}{axis}") for axis in "xyz") for p in "abc"])
    return rows.select("*", *[v.alias(f"n{axis}") for v, axis in zip(normal, "xyz", strict=True)])


def offsets(active_cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """``cell_id, n_verts, first``: the number of vertices in the cells before, for each step (``t``) of a series."""
    keys = steps(active_cells)
    # each level of the sums reads them again
    return running_sums(kept(active_cells.select(*keys, "cell_id", "n_verts"), "cells"), "cell_id", "n_verts", keys, block)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and read back from the shared folder."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_obj(points: DataFrame, path: str) -> None:
    """All vertices in order of cell and number as v lines, then a face for every three. The vertices are computed once. A series has one folder for each step
    (``t=…``), each with a mesh of its own."""
    keys = steps(points)
    points = kept(points, "vertices")
    counts = points.groupBy(*keys, "cell_id").agg(F.count("*").alias("n_verts"))
    rows = points.join(offsets(counts), [*keys, "cell_id"]).withColumn("vid", F.col("first") + F.col("n"))
    v = rows.select(*keys, F.lit(0).alias("part"), "vid", "vx", "vy", "vz")
    f = rows.filter(F.col("vid") % 3 == 0).select(*keys, F.lit(1).alias("part"), "vid", *[F.lit(None).cast("double").alias(c) for c in ("vx", "vy", "vz")])
    # Numbers are sorted, and become text afterwards: to find the ranges, Spark reads all rows once more.
    order, i = [*keys, "part", "vid"], F.col("vid")
    rows = v.unionByName(f).repartitionByRange(*order).sortWithinPartitions(*order)
    value = F.when(F.col("part") == 0, F.format_string("v %f %f %f", "vx", "vy", "vz")).otherwise(F.format_string("f %d %d %d", i + 1, i + 2, i + 3))
    rows.select(*keys, value.alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
