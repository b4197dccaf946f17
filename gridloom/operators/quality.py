"""Comparison of two volumes on one grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import l1
from gridloom.operators.sampling import AXES, steps, trilinear

#: Half width of the SSIM window, its number of voxels, and the two stabilising constants for values on [0, 1].
HALF, WINDOW, C1, C2 = 3, 343, 0.01**2, 0.03**2


def align(reference: DataFrame, other: DataFrame, *keys: str, strict: bool = False) -> DataFrame:
    """``ref, pred`` at equal grid points. With ``strict``, a point that only one side has is an error."""
    a, b = reference.select(*keys, *AXES, F.col("v").alias("ref")), other.select(*keys, *AXES, F.col("v").alias("pred"))
    if not strict:
        return a.join(b, [*keys, *AXES])
    rows = a.join(b, [*keys, *AXES], "full_outer")
    alone = F.col("ref").isNull() | F.col("pred").isNull()
    return rows.withColumn("ref", F.when(alone, F.raise_error(F.lit("grids differ")).cast("double")).otherwise(F.col("ref")))


def psnr(aligned: DataFrame, *keys: str) -> DataFrame:
    """``mse, psnr`` over all points; equal volumes have infinite PSNR."""
    error = F.col("ref") - F.col("pred")
    sums = aligned.groupBy(*keys).agg(F.avg(error * error).alias("mse"), (F.max("ref") - F.min("ref")).alias("span"))
    value = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.col("span") * F.col("span") / F.nullif("mse", F.lit(0.0))))
    return sums.select(*keys, "mse", value.alias("psnr"))


def mean_loss(aligned: DataFrame, loss: Column | None = None, *keys: str) -> DataFrame:
    """Mean of a loss over aligned points; ``loss`` is any expression of ref and pred, by default |ref - pred|."""
    return aligned.groupBy(*keys).agg(F.avg(l1(F.col("ref"), F.col("pred")) if loss is None else loss).alias("loss"))


def sampled_loss(points: DataFrame, reference: DataFrame, other: DataFrame, dims: tuple, loss: Column | None = None) -> DataFrame:
    """Mean loss at points, both volumes looked up there."""
    a = trilinear(points, reference, *dims).withColumnRenamed("v", "ref")
    b = trilinear(points, other, *dims).withColumnRenamed("v", "pred")
    return mean_loss(a.join(b, [*steps(reference), "point_id"]), loss, *steps(reference))


def box_sums(rows: DataFrame, columns: list[str], half: int | tuple = HALF, sparse: bool = False) -> DataFrame:
    """Sums over the box of 2 * half + 1 voxels (one number, or one for each axis) around each voxel, in its time step: one
    pass along each axis. A pass takes sums at the voxels that are there, so on a grid with gaps a box is whole only if all its
    voxels are; with ``sparse`` voxels are spread over the places around them instead, gaps add nothing, and all sums are right."""
    keys = [*steps(rows), *AXES]
    own = rows.select(*keys)
    for a, h in zip(AXES, (half,) * 3 if isinstance(half, int) else half, strict=True):
        if not h:
            continue
        if sparse:
            near = rows.withColumn(a, F.explode(F.sequence(F.col(a) - h, F.col(a) + h)))
            rows = near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
        else:
            line = Window.partitionBy(*[k for k in keys if k != a]).orderBy(a).rangeBetween(-h, h)
            rows = rows.select(*keys, *[F.sum(c).over(line).alias(c) for c in columns])
    return rows.join(own, keys, "left_semi") if sparse else rows


def ssim(reference: DataFrame, other: DataFrame, dims: tuple, value_span: float = 1.0) -> DataFrame:
    """Mean structural similarity over all windows that lie inside the grid and have all their voxels (``mssim``), for each
    time step of a series."""
    keys = steps(reference)
    rows = align(reference, other, *keys).select(*keys, *AXES, F.col("ref").alias("a"), F.col("pred").alias("b"), (F.col("ref") * F.col("ref")).alias("aa"), (F.col("pred") * F.col("pred")).alias("bb"), (F.col("ref") * F.col("pred")).alias("ab"), F.lit(1).alias("n"))
    sums = box_sums(rows, ["a", "b", "aa", "bb", "ab", "n"])
    inside = reduce(Column.__and__, [F.col(a).between(HALF, n - 1 - HALF) for a, n in zip(AXES, dims, strict=True)])
    mean = {c: F.col(c) / WINDOW for c in ("a", "b", "aa", "bb", "ab")}
    sample = WINDOW / (WINDOW - 1)
    va, vb, vab = (sample * (mean[p + q] - mean[p] * mean[q]) for p, q in (("a", "a"), ("b", "b"), ("a", "b")))
    c1, c2 = C1 * value_span**2, C2 * value_span**2
    value = (2 * mean["a"] * mean["b"] + c1) * (2 * vab + c2) / ((mean["a"] * mean["a"] + mean["b"] * mean["b"] + c1) * (va + vb + c2))
    return sums.filter(inside & (F.col("n") == WINDOW)).groupBy(*keys).agg(F.avg(value).alias("mssim"))


def cell_psnr(reference_cells: DataFrame, other_cells: DataFrame) -> DataFrame:
    """PSNR of the cells' lower and upper values: ``psnr_min, psnr_max``."""
    key = ["cx", "cy", "cz"]
    rows = reference_cells.select(*key, F.col("vmin").alias("r0"), F.col("vmax").alias("r1")).join(other_cells.select(*key, F.col("vmin").alias("p0"), F.col("vmax").alias("p1")), key)

    def value(ref: str, pred: str) -> Column:
        error, span = F.col(ref) - F.col(pred), F.max(ref) - F.min(ref)
        mse = F.avg(error * error)
        return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(span * span / F.nullif(mse, F.lit(0.0))))

    return rows.agg(value("r0", "p0").alias("psnr_min"), value("r1", "p1").alias("psnr_max"))
