"""Summaries that stay current while samples, frames, losses or time steps arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.cells import macrocells, macrocells_of_points, max_opacity
from gridloom.operators.lines import progressive_mean


def stream_cells(samples: DataFrame, dims: tuple, *keys: str) -> DataFrame:
    """Macrocell ranges of a stream of sample points, for output mode update. The state has a row per cell."""
    return macrocells_of_points(samples, *dims, *keys)


def start_cells(samples: DataFrame, dims: tuple, checkpoint: str, sink: Callable[[DataFrame, int], None], alphas: list[float] | None = None) -> StreamingQuery:
    """Gives ``sink`` the changed cells of each batch, with their opacity if a transfer function is given."""

    def each(batch: DataFrame, number: int) -> None:
        if alphas is not None:
            batch = max_opacity(batch, F.array(*[F.lit(a) for a in alphas]), len(alphas))
        sink(batch, number)

    return stream_cells(samples, dims).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def stream_mean(frames: DataFrame, key: list[str], value: str = "v") -> DataFrame:
    """Mean per key of a stream of frames; a new value of the column ``epoch`` begins anew."""
    return progressive_mean(frames, ["epoch", *key], value)


def stream_loss(losses: DataFrame, window: int = 1000) -> DataFrame:
    """Mean loss of each run and window of steps."""
    return losses.groupBy("run", F.floor(F.col("step") / window).alias("window")).agg(F.avg("loss").alias("loss"), F.max("step").alias("step"))


def start_losses(losses: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], window: int = 1000) -> StreamingQuery:
    """Gives ``sink`` the mean losses that each batch changes. The state has a row per run and window."""
    return stream_loss(losses, window).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into its own part of a table; a batch that comes again takes the place of its rows."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def latest(written: DataFrame, *keys: str) -> DataFrame:
    """The last state of each key from a table that ``table_sink`` wrote."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def alerts(means: DataFrame, above: float = 0.9, after: int = 5000) -> DataFrame:
    """Runs that should start again: their loss is still high after some steps."""
    return means.filter((F.col("step") > after) & (F.col("loss") > above))


def start_steps(steps: DataFrame, dims: tuple, path: str, checkpoint: str) -> StreamingQuery:
    """Rewrites the summaries of the time steps that each batch brings, one partition per step."""

    def each(batch: DataFrame, number: int) -> None:
        cells = macrocells(batch, *dims, "t")
        cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t").parquet(path)

    return steps.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
