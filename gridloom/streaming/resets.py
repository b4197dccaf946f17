"""Running means that begin anew: when frames of a new epoch arrive, or when they have been read.

Each key has a small state, a sum and a count, in Spark's state store. A batch's rows of a key come as pandas frames and are
summed up whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def mean_of_epoch(frames: DataFrame, keys: list[str], value: str = "v", epoch: str = "epoch") -> DataFrame:
    """``keys, epoch, mean, frames`` of each key that a batch brings frames for, for output mode update. The first frame of a
    later epoch empties the key's state; frames of earlier epochs that come late are left out, so the means do not depend on the order
    of arrival."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, total, count = state.get if state.exists else (None, 0.0, 0)
        for batch in batches:
            newest = int(batch[epoch].max())
            if now is None or newest > now:
                now, total, count = newest, 0.0, 0
            own = batch.loc[batch[epoch] == now, value].dropna()
            total, count = total + float(own.sum()), count + len(own)
        state.update((now, total, count))
        yield pd.DataFrame([[*key, now, total / count if count else None, count]], columns=[*keys, epoch, "mean", "frames"])

    rows = frames.select(*keys, epoch, value).filter(f"{epoch} is not null")
    output = StructType.fromDDL(f"{fields(frames, *keys)}, {epoch} long, mean double, frames long")
    return rows.groupBy(*keys).applyInPandasWithState(each, output, f"{epoch} long, total double, count long", "update", GroupStateTimeout.NoTimeout)


def mean_between_reads(losses: DataFrame, keys: list[str], order: str = "step", value: str = "loss", read: str = "is_read") -> DataFrame:
    """``keys, order, mean, count`` for each row that is a read (``read`` true): the mean of the losses since the read before,
    null if there were none; a read empties the key's state. Rows of a key count in their order within a batch, and batches in
    theirs. A key's rows of one batch are held together, so a batch should be bounded, as by ``maxFilesPerTrigger``."""

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, count = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        is_read = rows[read].fillna(False).astype(bool)
        span = is_read.cumsum() - is_read  # a read ends the span that it belongs to
        own = rows[value].where(~is_read)
        sums, counts = own.groupby(span).sum(), own.groupby(span).count()
        sums.iloc[0] += total
        counts.iloc[0] += count
        at = rows.loc[is_read, order].to_numpy()
        ended = len(at)
        last = sums.index[-1] == ended  # rows after the last read
        state.update((float(sums.iloc[-1]), int(counts.iloc[-1])) if last else (0.0, 0))
        if ended:
            done, n = sums.iloc[:ended].to_numpy(), counts.iloc[:ended].to_numpy()
            out = pd.DataFrame({order: at, "mean": [s / k if k else None for s, k in zip(done, n, strict=True)], "count": n})
            for name, k in zip(reversed(keys), reversed(key), strict=True):
                out.insert(0, name, k)
            yield out

    output = StructType.fromDDL(f"{fields(losses, *keys, order)}, mean double, count long")
    return losses.select(*keys, order, value, read).groupBy(*keys).applyInPandasWithState(each, output, "total double, count long", "append", GroupStateTimeout.NoTimeout)


def start_means(means: DataFrame, checkpoint: str, sink, mode: str):
    """Runs a stream of means into a sink (a function of a batch and its number) until all that is there has been read."""
    return means.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
