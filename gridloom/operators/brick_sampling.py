"""Trilinear sampling by bricks: a point travels once, to the brick that it lies in, and is interpolated there by numpy.

Bricks carry one more layer of voxels on their upper sides, so that a brick has all corners of its points. Only bricks that
have points are sent, and a brick in which more than ``crowd`` points lie is sent to several tasks, each with its share of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import clamp
from gridloom.operators.sampling import AXES, steps

BRICK = 32
#: Points that one task interpolates in one brick.
CROWD = 100_000


def grid_place(p: Column, n: int) -> Column:
    """A position in [0, 1] in units of voxels from the first one's centre, as ``sampling.trilinear`` has it."""
    return clamp(p * n, 0.5, n - 0.5) - 0.5


def brick_points(points: DataFrame, dims: tuple, size: int, id_column: str) -> DataFrame:
    places = [grid_place(F.col(f"p{a}"), n).alias(f"q{a}") for a, n in zip(AXES, dims, strict=True)]
    rows = points.select(*steps(points), F.col(id_column).alias("id"), *places)
    return rows.select("*", *[F.floor(F.floor(f"q{a}") / size).cast("int").alias(f"b{a}") for a in AXES])


def brick_voxels(voxels: DataFrame, size: int) -> DataFrame:
    """Voxels for the brick that they lie in, and for the one below along each axis if they are its layer."""
    rows = voxels.select(*steps(voxels), *AXES, F.col("v").cast("double").alias("v"))
    for a in AXES:
        own = F.floor(F.col(a) / size).cast("int")
        rows = rows.withColumn(f"b{a}", F.explode(F.when((F.col(a) % size == 0) & (F.col(a) > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    return rows


def interpolated(key: tuple, points: pa.Table, voxels: pa.Table, size: int, schema: pa.Schema) -> pa.Table:
    """The points' values from a brick's voxels. A missing voxel adds nothing; a point without any is left out."""
    low = [k.as_py() * size for k in key[:3]]
    values, there = np.zeros((size + 1,) * 3), np.zeros((size + 1,) * 3, bool)
    at = tuple(voxels.column(a).to_numpy() - o for a, o in zip(AXES, low, strict=True))
    # a voxel given twice counts twice, as in a join
    np.add.at(values, at, voxels.column("v").to_numpy())
    there[at] = True
    q = [points.column(f"q{a}").to_numpy() - o for a, o in zip(AXES, low, strict=True)]
    whole = [np.floor(x).astype(np.int64) for x in q]
    rest = [x - i for x, i in zip(q, whole, strict=True)]
    total, met = np.zeros(len(points)), np.zeros(len(points), bool)
    for corner in itertools.product((0, 1), repeat=3):
        w = np.prod([f if c else 1 - f for f, c in zip(rest, corner, strict=True)], axis=0)
        near = tuple(np.minimum(i + c, size) for i, c in zip(whole, corner, strict=True))
        total += np.where(w > 0, w * values[near], 0.0)
        met |= (w > 0) & there[near]
    kept = points.select([n for n in schema.names if n != "v"]).append_column("v", pa.array(total, pa.float64()))
    return kept.filter(pa.array(met)).select(schema.names).cast(schema)


def trilinear_by_bricks(points: DataFrame, voxels: DataFrame, nx: int, ny: int, nz: int, id_column: str = "point_id", size: int = BRICK, crowd: int = CROWD) -> DataFrame:
    """``id, v`` (with ``t`` in a series): the values of ``sampling.trilinear``. Points without a time step are looked up in
    every step of a series in which their brick has voxels."""
    asked, filled = brick_points(points, (nx, ny, nz), size, id_column), brick_voxels(voxels, size)
    time, brick = steps(filled), ["bx", "by", "bz"]
    if time and not steps(asked):
        asked = asked.join(filled.select(*time, *brick).distinct(), brick)
    home = [*brick, *time]
    crowds = asked.groupBy(*home).agg(F.ceil(F.count("*") / F.lit(crowd)).cast("int").alias("parts"))
    share = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    asked = asked.join(crowds, home).withColumn("part", share).drop("parts")
    filled = filled.join(crowds, home).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    kind = asked.schema["id"].dataType.simpleString()
    columns = [*time, "id", "v"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, [*[asked.schema[k].dataType.simpleString() for k in time], kind, "double"], strict=True))
    def each(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [pa.field(c, left.schema.field(c).type if c != "v" else pa.float64()) for c in columns]
        return interpolated(key, left, right, size, pa.schema(fields))

    groups = [*home, "part"]
    filled = filled.select(*[F.col(c).alias(c) for c in filled.columns])  # columns of their own where the points' came from here
    return asked.groupBy(*groups).cogroup(filled.groupBy(*groups)).applyInArrow(each, schema).withColumnRenamed("id", id_column)
