"""Small helpers that the text operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than the six ASCII white-space characters. In UTF-8 this is what
#: ``bytes.split()`` without arguments gives.
WORD = r"[^\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; empty batches are skipped."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the cluster names in ``spark.checkpoint.dir``; sets one only where there is none, on
    a single machine; on a cluster without one it fails, as a machine's own folder is lost with it."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), "gridloom-checkpoints")
        spark.sparkContext.setCheckpointDir(base)


#: Lets a query's shuffle files go when it has ended, not when the driver happens to collect its garbage.
REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run in this block leave no shuffle files. The session's own setting comes back."""
    before = spark.conf.get(REMOVAL, None)
    spark.conf.set(REMOVAL, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVAL)
        else:
            spark.conf.set(REMOVAL, before)


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder, without their lineage and its shuffle files."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own, made with the setting


def stored(df: DataFrame) -> DataFrame:
    """Like ``saved``, as a Parquet table in the checkpoint folder: smaller, and read by columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_as_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def small_or_shuffled(df: DataFrame, most_rows: int, weight: str | None = None) -> DataFrame:
    """The rows with a broadcast hint if there are at most ``most_rows`` of them (or of the sum of the column ``weight``);
    otherwise as they are, for a shuffled join. ``df`` should be cheap to count, as it is counted."""
    size = df.agg(F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_rows else df
