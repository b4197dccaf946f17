"""Transfer functions as small tables ``i, n, r, g, b, a`` of equally spaced knots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: End knots of an opacity curve below this are fully transparent.
FAINT = 0.01


def knot_array(alphas: list[float]) -> Column:
    return F.array(*[F.lit(float(a)) for a in alphas])


def evenly(spark: SparkSession, points: list[tuple[float, float]], n: int) -> DataFrame:
    """Opacity points (position, alpha) on n equally spaced knots: ``i, n, a``."""
    points = sorted(points)
    place = F.col("id") / (n - 1)
    a = F.lit(float(points[-1][1]))
    for (p0, a0), (p1, a1) in reversed(list(zip(points, points[1:], strict=False))):
        share = (place - p0) / (p1 - p0) if p1 > p0 else F.lit(0.0)
        a = F.when(place <= p1, F.lit(float(a0)) + share * (a1 - a0)).otherwise(a)
    a = F.when(place <= points[0][0], F.lit(float(points[0][1]))).otherwise(a)
    ends = F.col("id").isin(0, n - 1) & (a < FAINT)
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.lit(n).alias("n"), F.when(ends, 0.0).otherwise(a).alias("a"))


def with_colours(alphas: DataFrame, colours: list[tuple[float, float, float]]) -> DataFrame:
    """Adds r, g, b from equally spaced colours."""
    from gridloom.functions.scalars import transfer

    place = F.col("i") / (F.col("n") - 1)
    return alphas.select("*", *[transfer(place, knot_array([c[k] for c in colours]), len(colours)).alias(name) for k, name in enumerate("rgb")])


def gaussians(spark: SparkSession, bumps: list[tuple[float, float, float]], n: int) -> DataFrame:
    """Opacity as a sum of bumps (mean, width, height), at most 1: ``i, n, a``."""
    place = F.col("id") / (n - 1)
    total = F.lit(0.0)
    for mean, width, height in bumps:
        total = total + F.lit(float(height)) * F.exp(-F.pow(place - mean, 2) / (2 * width * width))
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.lit(n).alias("n"), F.least(total, F.lit(1.0)).alias("a"))


def intersect_range(lo: Column, hi: Column, data_lo: Column, data_hi: Column) -> tuple[Column, Column]:
    """The part of a transfer function's range that the data covers."""
    return F.greatest(lo, data_lo), F.least(hi, data_hi)
