"""Volumes derived from plain tables: the voxel table ``x, y, z, v`` (with ``t`` for series)."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A voxel table and its size."""

    voxels: DataFrame
    nx: int
    ny: int
    nz: int


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``; on a single machine without one, in
    its temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), "gridloom-checkpoints")
    return f"{base}/{name}-{uuid.uuid4()}"


def stored(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """The rows, computed once and kept as Parquet in the shared folder, without their lineage."""
    path = scratch(df.sparkSession, name)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(stored_rows: DataFrame) -> None:
    """Removes the files of a table that ``stored`` wrote, once nothing reads it any more."""
    spark = stored_rows.sparkSession
    folders = {f.rpartition("/")[0] for f in stored_rows.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Components of embeddings along x, 20 vectors a row, rows along z. Vectors are dealt to all tasks before they grow to voxels,
    as a small file is a single task."""
    rows = table(spark, sf_dir, "embeddings")
    last = rows.agg(F.coalesce(F.max("vec_id"), F.lit(0))).first()[0]
    voxels = rows.select("vec_id", "embedding").repartition("vec_id").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return Grid(voxels.select("x", (F.col("vec_id") % 20).cast("int").alias("y"), F.floor(F.col("vec_id") / 20).cast("int").alias("z"), F.col("v").cast("double").alias("v")), 64, 20, int(last) // 20 + 1)


def sales_grid(spark: SparkSession, sf_dir: str, n: int = 64) -> Grid:
    """Prices in whole cents, summed over keys modulo n; voxels without a sale are 0."""
    sums = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % n).cast("int").alias("x"), (F.col("l_orderkey") % n).cast("int").alias("y"), (F.col("l_suppkey") % n).cast("int").alias("z")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"))
    every = spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / (n * n)).cast("int").alias("z"))
    return Grid(every.join(sums, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("v", F.lit(0)).alias("v")), n, n, n)


EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]


def event_voxels(rows: DataFrame) -> DataFrame:
    """Events, as a table or a stream, as voxels ``t, x, y, z, v``: day, user modulo 32, hour and kind of event; values in whole
    cents. Several events can share a voxel."""
    kind = F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")).cast("int") - 1
    return rows.select(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t"), (F.col("user_id") % 32).cast("int").alias("x"), F.hour("ts").alias("y"), kind.alias("z"), F.round(F.col("value") * 100).cast("long").alias("v"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse series of the events' voxels, their values added."""
    return event_voxels(table(spark, sf_dir, "events")).groupBy("t", "x", "y", "z").agg(F.sum("v").alias("v"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' table, one file or a folder, as a stream of its files. A stream takes a single file only by a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
