"""Table functions from signals to frames; tables go in and come out as Arrow batches.

The output schema follows from the table that goes in: the key keeps its type
and a frame is an array of whatever the signal holds, nulls included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of a series that one call of the table function cuts.
PIECE = 4096


def _check(width: int, hop: int) -> None:
    if width < 1 or hop < 1:
        raise ValueError("width and hop must be positive")


def _cut(values: pa.Array, starts: np.ndarray, width: int) -> pa.Array:
    """A list of ``width`` values from every start."""
    at = (starts[:, None] + np.arange(width)).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * width, pa.int32()), values.take(pa.array(at, pa.int64())))


def frame_rows(df: DataFrame, key: str, signal: str, width: int, hop: int) -> DataFrame:
    """(key, frame_idx, vec) of signals that are arrays in rows.

    Only whole frames; a shorter, empty or null signal has none. The table is
    taken as it is partitioned, without a shuffle.
    """
    _check(width, hop)
    types = dict(df.dtypes)

    class Frames:
        def eval(self, rows):
            keys, signals = rows.column(0), rows.column(1)
            sizes = np.asarray(signals.value_lengths().fill_null(0))
            counts = np.where(sizes >= width, (sizes - width) // hop + 1, 0)
            owner = np.repeat(np.arange(len(sizes)), counts)
            index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            # flatten() leaves out what null lists cover, as the sizes do
            starts = (np.cumsum(sizes) - sizes)[owner] + index * hop
            yield pa.table({
                key: keys.take(pa.array(owner, pa.int64())),
                "frame_idx": pa.array(index, pa.int32()),
                "vec": _cut(signals.flatten(), starts, width),
            })

    call = F.arrow_udtf(Frames, returnType=f"`{key}` {types[key]}, frame_idx int, vec {types[signal]}")
    return call(df.select(key, signal).asTable())


def series_frames(
    df: DataFrame, key: str, pos: str, value: str, width: int, hop: int, piece: int = PIECE
) -> DataFrame:
    """(key, frame_idx, vec) of series whose values are rows at positions 0, 1, 2, ...

    The table function sees PARTITION BY (key, piece) ORDER BY position and
    keeps less than a frame between batches, so neither a long series nor a
    key with a third of all rows is ever in one place: a piece is ``piece``
    frames, and rows shared by two pieces go to both. A missing or repeated
    position is an error.
    """
    _check(width, hop)
    types = dict(df.dtypes)
    step = piece * hop
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - (step - hop + width - 1)) / step)).cast("bigint")
    last = F.floor(F.col(pos) / step).cast("bigint")
    # with hops beyond the width some positions are in no frame
    rows = df.where(F.col(pos).isNotNull() & (first <= last)).select(
        F.col(key).alias("key"), F.explode(F.sequence(first, last)).alias("piece"), F.col(pos).cast("bigint").alias("pos"), F.col(value).alias("value")
    )

    class Frames:
        def __init__(self):
            self.held, self.at, self.end = None, 0, None

        def eval(self, rows):
            if not rows.num_rows:
                return
            number, where = rows.column("piece")[0].as_py(), np.asarray(rows.column("pos"))
            start = number * step if self.end is None else self.end
            if where[0] != start or (np.diff(where) != 1).any():
                raise ValueError(f"positions of a series must be 0, 1, 2, ...: {where[0]} instead of {start}")
            self.end = int(where[-1]) + 1
            values = rows.column("value")
            values = values if self.held is None else pa.concat_arrays([self.held, values])
            base = self.end - len(values)
            frame = number * piece + self.at
            ready = (self.end - width) // hop - frame + 1
            count = max(0, min(ready, piece - self.at))
            index = frame + np.arange(count)
            keys = rows.column("key").take(pa.array(np.zeros(count, "int64")))
            yield pa.table({"key": keys, "frame_idx": pa.array(index, pa.int64()), "vec": _cut(values, index * hop - base, width)})
            self.at += count
            keep = min(max((frame + count) * hop - base, 0), len(values))
            # a copy, so that the batch itself can go
            self.held = values.take(pa.array(np.arange(keep, len(values)), pa.int64()))

    call = F.arrow_udtf(Frames, returnType=f"key {types[key]}, frame_idx bigint, vec array<{types[value]}>")
    return call(rows.asTable().partitionBy("key", "piece").orderBy("pos")).withColumnRenamed("key", key)
