"""Volumes decoded from a model slab by slab, with a cursor that is kept from call to call. A call may decode several slabs, so that the number of
calls need not grow with the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.blocks import procedural_volume
from gridloom.operators.pyramid import AXES, Config, reconstruct

#: Slices of a slab.
THICK = 16
#: Voxels that a call decodes, if a slab has fewer.
VOXELS = 1 << 24
CURSOR = "call long, next int"
SCHEMA = "x int, y int, z int, v double, slab int"


def slab_count(nz: int, thick: int = THICK) -> int:
    return -(-nz // thick)


def cursor(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of calls so far and the slab that is decoded next."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cursor")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return 0, 0
    row = spark.read.schema(CURSOR).json(f"{path}/cursor").orderBy(F.desc("call")).first()
    return (row.call, row.next) if row else (0, 0)


def slabs_per_call(dims: tuple, thick: int = THICK, most: int = VOXELS) -> int:
    """Slabs that together have at most ``most`` voxels, at least one and no more than there are."""
    return max(1, min(most // (dims[0] * dims[1] * thick), slab_count(dims[2], thick)))


def decode_next(model: DataFrame, dims: tuple, config: Config, path: str, thick: int = THICK, voxels: DataFrame | None = None, slabs: int = 1) -> int:
    """Decodes the next ``slabs`` slabs of the volume, or those that are left up to the last one, into their parts of the table at ``path``, moves the
    cursor on, back to the first slab after the last, and returns the number of the first one decoded. A call that fails leaves the cursor where it was, and
    the next one writes the same slabs again. Without ``voxels`` all of the grid are decoded, with them only those that they name (of a grid that lacks
    some). Voxels with a column ``slab`` are read by it."""
    spark = model.sparkSession
    calls, first = cursor(spark, path)
    end = min(first + slabs, slab_count(dims[2], thick))
    low, high = first * thick, min(end * thick, dims[2])
    if voxels is None:
        index = procedural_volume(spark, (dims[0], dims[1], high - low), lambda x, y, z: F.lit(0.0))
        at = index.select("x", "y", (F.col("z") + low).cast("int").alias("z"))
    else:
        own = voxels.filter(F.col("slab").between(first, end - 1)) if "slab" in voxels.columns else voxels
        at = own.filter((F.col("z") >= low) & (F.col("z") < high)).select(*AXES)
    rows = reconstruct(at, model, dims, config).select(*[F.col(a).cast("int").alias(a) for a in AXES], "v")
    if end - first == 1:
        rows.write.mode("overwrite").parquet(f"{path}/voxels/slab={first}")
    else:
        # the slabs' own parts are replaced, those of other calls stay
        numbered = rows.withColumn("slab", F.floor(F.col("z") / thick).cast("int")).repartition("slab")
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slab").parquet(f"{path}/voxels")
    after = end % slab_count(dims[2], thick)
    spark.createDataFrame([(calls + 1, after)], CURSOR).coalesce(1).write.mode("append").json(f"{path}/cursor")
    return first


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z, v`` of all slabs that have been decoded; a filter on ``slab`` reads its own only."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/voxels")
