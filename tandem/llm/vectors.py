"""Which rows of a vector table have a usable vector."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame, vector: str = "embedding", extra: tuple = ()) -> DataFrame:
    """vec_id, v (doubles) and ``extra`` columns of the rows whose vector has no null or
    non-finite entry and the length that most of these have (ties: the shorter)."""
    v = F.col(vector).cast("array<double>")
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *extra).where(
        F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    usual = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.where(F.size("v") == (usual["d"] if usual else 0))


def matrix(column, dim: int):
    """The rows of an Arrow list column as one numpy matrix."""
    import numpy as np
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)
