"""Vector columns: which rows count, and their entries as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: An entry beyond this, after scaling, is set to it: sums and differences of such entries stay exact.
LARGEST = float(1 << 40)


def integers(column: str, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of every entry, as longs; entries beyond +-2^40 are set to that."""

    def entry(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + F.lit(shift).cast("long")

    return F.transform(F.col(column), entry)


def finite(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is there, not empty, and without null, NaN or infinite entries.

    Vectors have one length: the most frequent among these rows, the greater one of two that are equally frequent. Rows of
    another length are dropped like the others.
    """

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    kept = rows.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(F.col(column), bad))
    lengths = kept.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return kept.where(F.size(column) == (lengths.length if lengths else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
