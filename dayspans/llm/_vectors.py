"""Helpers shared by the operators on vectors: whole-number components and exact products."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import maybe_broadcast

#: Whole numbers stay below this, so that sums of two of them fit 64 bits.
LARGEST = 2.0**62


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """Components as whole numbers: floor(``scale`` * c), c as double."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("long"))


def largest(vector: Column, scale: int) -> Column:
    """The greatest absolute scaled component, as double; 0 for an empty vector."""
    return F.aggregate(vector, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v.cast("double") * scale)))


def matrix(column: pa.Array, dims: int):
    """Rows of whole numbers from an Arrow list column; shorter vectors are filled up with zeros."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(column), dims).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


def grouped(frame: DataFrame, rows: int) -> dict[int, int]:
    """Partition of blocks -> its group: neighbours are put together while they have no more than ``rows`` rows.

    ``frame`` has part and known, a byte per row of its block. As many entries as there are partitions, which callers bound.
    """
    counts = frame.groupBy("part").agg(F.sum(F.length("known")).alias("n")).orderBy("part").collect()
    out, group, n = {}, -1, 0
    for r in counts:
        if group < 0 or n + r["n"] > rows:
            group, n = group + 1, 0
        out[r["part"]], n = group, n + r["n"]
    return out


def in_groups(frame: DataFrame, rows: int) -> DataFrame:
    """``part`` becomes the number of the group of its partition; ``no`` keeps the order of the blocks."""
    groups = list(grouped(frame, rows).items())
    table = frame.sparkSession.createDataFrame(groups, "part int, grouped int")
    return frame.join(maybe_broadcast(table, len(groups)), "part").withColumn("part", F.col("grouped")).drop("grouped")
