"""Aggregations over spatio-temporal frames (one pass, partial + final).

``global_stats`` is the statistics job of the join: envelope, row count,
time range and mean interval length / envelope extent, computed with a
map-side partial aggregate so only one row per task crosses the network.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAT_COLUMNS = ["minx", "miny", "maxx", "maxy", "n", "start_us", "end_us", "avg_len", "avg_extent", "max_len"]


def global_stats(df: DataFrame) -> DataFrame:
    """1-row frame: envelope union, count, [min start, max end], mean
    interval length (µs) and mean envelope extent (max of width, height)."""
    return df.agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        F.count(F.lit(1)).alias("n"),
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.avg(F.col("end_us") - F.col("start_us")).alias("avg_len"),
        F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))).alias("avg_extent"),
        F.max(F.col("end_us") - F.col("start_us")).alias("max_len"))


@dataclass(frozen=True)
class Stats:
    minx: float | None
    miny: float | None
    maxx: float | None
    maxy: float | None
    n: int
    start_us: int | None
    end_us: int | None
    avg_len: float | None
    avg_extent: float | None
    max_len: int | None = None

    @property
    def empty(self) -> bool:
        return self.n == 0


def collect_stats(df: DataFrame) -> Stats:
    """Run ``global_stats`` and bring its single row to the driver."""
    row = global_stats(df).first()
    return Stats(**{c: row[c] for c in STAT_COLUMNS})


def group_envelope(df: DataFrame, *keys: str) -> DataFrame:
    """Envelope and count per group (the bound of each partition / cell)."""
    return df.groupBy(*keys).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        F.count(F.lit(1)).alias("n"))

