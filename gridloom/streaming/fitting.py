"""Hash grids kept current from a stream of voxels.

A slot's state is what adds up over parts of a volume: the weighted sum of what was left of its voxels' values, the sum of
weights and their number. A level's sums need the means of the levels before, so levels take turns: each reads the stream by
a query of its own, and every micro-batch writes its sums as one part of a table, so a batch that comes again after a failure
takes its own place. When new voxels have changed the first level, the others start anew beside what they had.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.pyramid import AXES, Config, left_over, means_of, slot_sums

SUMS = "slot long, wr double, w double, n long"


def batches_of(spark: SparkSession, place: str) -> int:
    """Number of batches whose sums have been written. Listing them reads no rows."""
    return spark.read.schema(f"{SUMS}, batch int").parquet(f"{place}/sums").filter("batch >= 0").select("batch").distinct().count()


def run_level(read: Callable[[], DataFrame], spark: SparkSession, level: int, lower: list[DataFrame], dims: tuple, config: Config, place: str) -> None:
    """Adds the sums of all batches that the level has not had."""
    spark.createDataFrame([], SUMS).write.mode("overwrite").parquet(f"{place}/sums/batch=-1")

    def each(batch: DataFrame, number: int) -> None:
        left = batch.select(*AXES, F.col("v").cast("double").alias("r"))
        for below, means in enumerate(lower):
            left = left_over(left, means, config, below, dims)
        slot_sums(left, config, level, dims).write.mode("overwrite").parquet(f"{place}/sums/batch={number}")

    read().writeStream.option("checkpointLocation", f"{place}/log").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def fit_stream(spark: SparkSession, read: Callable[[], DataFrame], dims: tuple, config: Config, path: str) -> DataFrame:
    """``level, slot, mean, n`` of all voxels ``x, y, z, v`` that the stream has so far; ``read`` gives the stream anew. Called again
    with the same ``path``, after a failure or when there are more voxels, it goes on from what is there."""
    first = f"{path}/level=0"
    run_level(read, spark, 0, [], dims, config, first)
    while True:
        had = batches_of(spark, first)
        lower: list[DataFrame] = []
        for level in range(config.levels):
            place = first if level == 0 else f"{path}/after={had}/level={level}"
            if level:
                run_level(read, spark, level, lower, dims, config, place)
            sums = spark.read.schema(f"{SUMS}, batch int").parquet(f"{place}/sums").drop("batch")
            means_of(sums).write.mode("overwrite").parquet(f"{place}/means")
            lower.append(spark.read.schema("slot long, mean double, n long").parquet(f"{place}/means"))
        run_level(read, spark, 0, [], dims, config, first)
        if batches_of(spark, first) == had:  # else voxels came in meanwhile
            break
    model = None
    for level, means in enumerate(lower):
        found = means.select(F.lit(level).alias("level"), "slot", "mean", "n")
        model = found if model is None else model.unionByName(found)
    return model
