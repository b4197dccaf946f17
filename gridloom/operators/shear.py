"""Light in a volume by sheared sweeps: work that grows with the voxels, not with voxels times the samples of a line each.

For each light the axis along which it comes most is swept slice by slice. Slices are moved against each other so that
what lies on one line towards the light has one place ``u, w`` in all slices; values there are blends of a slice's four
voxels around them. One running product over each such column gives the light that reaches it, and blending back gives that of
the voxels. A slice moves as a whole, so weights depend on the slice alone, and no voxel is looked up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import opacity
from gridloom.operators.lines import AXES, transmittance
from gridloom.operators.sampling import steps


def sweeps(spark: SparkSession, given: list, dims: tuple) -> DataFrame:
    """A row with what each light's sweep needs: ``m, p, q`` number the swept axis and the two others, ``sp, sq`` how far a
    slice moves along these, ``np, nq`` their sizes, ``sign`` the side of the light, ``dist`` the length of a line within a slice."""
    found = []
    for no, light in enumerate(given):
        d = [float(light[a]) for a in AXES]
        m = max(range(3), key=lambda k: abs(d[k]))
        p, q = (k for k in range(3) if k != m)
        dist = math.sqrt(sum(x * x for x in d)) / abs(d[m])
        found.append((no, m, p, q, d[p] / d[m], d[q] / d[m], dims[p], dims[q], 1 if d[m] > 0 else -1, dist, float(light.intensity)))
    schema = "no int, m int, p int, q int, sp double, sq double, np int, nq int, sign int, dist double, intensity double"
    return F.broadcast(spark.createDataFrame(found, schema))  # a handful of rows


def moved(slope: Column, depth: Column) -> tuple[Column, Column]:
    """Whole voxels and the rest that a slice moves by."""
    by = slope * depth
    return F.floor(by).cast("int"), by - F.floor(by)


def onto_columns(at: Column, slope: Column, depth: Column, n: Column) -> Column:
    """The two columns that a voxel adds to along one axis, with its weights; a voxel at the border also stands for those
    beyond it."""
    i, f = moved(slope, depth)
    near = F.struct((at - i).alias("u"), (1 - f + F.when(at == n - 1, f).otherwise(0.0)).alias("w"))
    far = F.struct((at - i - 1).alias("u"), (f + F.when(at == 0, 1 - f).otherwise(0.0)).alias("w"))
    return F.filter(F.array(near, far), lambda s: s["w"] > 0)


def onto_voxels(u: Column, slope: Column, depth: Column) -> Column:
    """The two voxels that read a column along one axis, with its weights for them."""
    i, f = moved(slope, depth)
    return F.filter(F.array(F.struct((u + i).alias("at"), (1 - f).alias("w")), F.struct((u + i + 1).alias("at"), f.alias("w"))), lambda s: s["w"] > 0)


def sheared_shadow(voxels: DataFrame, lights: DataFrame, dims: tuple, transfer: Callable[[Column], Column], rate: float = 1.0) -> DataFrame:
    """``x, y, z, light``: the light that reaches the centre of each voxel from distant lights in any direction, for each step of
    a series; ``lights`` as for ``lines.shadow``. A column has one sample for each slice, half of it in front of the voxel."""
    given = lights.collect()  # a handful of lights, given by the user
    time = steps(voxels)
    if not given:
        return voxels.select(*time, *AXES, F.lit(0.0).alias("light"))
    table = sweeps(voxels.sparkSession, given, dims)
    axis = lambda k: F.element_at(F.array(*AXES), F.col(k) + 1)
    rows = voxels.select(*time, *AXES, "v", F.explode(F.sequence(F.lit(0), F.lit(len(given) - 1))).alias("no")).join(table, "no")
    rows = rows.select(*time, "no", "v", axis("m").alias("depth"), axis("p").alias("b"), axis("q").alias("e"), "sp", "sq", "np", "nq")
    rows = rows.withColumn("u", F.explode(onto_columns(F.col("b"), F.col("sp"), F.col("depth"), F.col("np"))))
    rows = rows.withColumn("w", F.explode(onto_columns(F.col("e"), F.col("sq"), F.col("depth"), F.col("nq"))))
    line = [*time, "no", "u", "w"]
    points = rows.select(*time, "no", "depth", F.col("u.u").alias("u"), F.col("w.u").alias("w"), (F.col("u.w") * F.col("w.w") * F.col("v")).alias("v"))
    points = points.groupBy(*line, "depth").agg(F.sum("v").alias("v")).join(table, "no")
    inside = [(F.col(u) + F.col(slope) * F.col("depth")).between(F.lit(-0.5), F.col(n) - 0.5) for u, slope, n in (("u", "sp", "np"), ("w", "sq", "nq"))]
    points = points.withColumn("a", F.when(inside[0] & inside[1], opacity(transfer(F.col("v")), F.col("dist"), rate)).otherwise(0.0))
    lit = transmittance(points.withColumn("from_light", -F.col("depth") * F.col("sign")), line, "from_light")
    lit = lit.withColumn("share", F.col("intensity") * F.col("clear") * F.sqrt(1 - F.col("a")))
    lit = lit.withColumn("b", F.explode(onto_voxels(F.col("u"), F.col("sp"), F.col("depth"))))
    lit = lit.withColumn("e", F.explode(onto_voxels(F.col("w"), F.col("sq"), F.col("depth"))))
    on_axis = lambda k: F.when(F.col("m") == k, F.col("depth")).when(F.col("p") == k, F.col("b.at")).otherwise(F.col("e.at"))
    light = lit.select(*time, *[on_axis(k).alias(a) for k, a in enumerate(AXES)], (F.col("share") * F.col("b.w") * F.col("e.w")).alias("light"))
    return voxels.select(*time, *AXES).join(light.groupBy(*time, *AXES).agg(F.sum("light").alias("light")), [*time, *AXES])
