"""What the vector operators share: usable vectors, classes of equal vectors, and grouped rows as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Copies of a vector up to which they may meet in one task.
OFTEN = 1024


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Equal vectors are one class. Returns (cls, first, n, vector) and (id, cls), the members.

    Both come from written tables. Counting has partial sums, so a vector that fills a third of the rows is one row.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    each = cut(own.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # vectors with many copies are at most 10,000, so they are sent to every task; the rest meet in a shuffle
    many = F.col("n") > max(OFTEN, total // 10_000)
    told = own.join(F.broadcast(each.filter(many).select("vector", "cls")), "vector", "left")
    rest = told.filter(F.col("cls").isNull()).select("id", "vector").join(each.filter(~many).select("vector", "cls"), "vector")
    members = cut(told.filter(F.col("cls").isNotNull()).select("id", "cls").unionByName(rest.select("id", "cls")))
    return each.select("cls", "first", "n", "vector"), members


def matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a double matrix) for each dimension in a list column."""
    bounds, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(bounds)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[bounds[at][:, None] + np.arange(d)].astype(np.float64)
