"""The spatio-temporal frame: the one data layout every operator accepts.

Required columns (a *box frame*):

    id        BIGINT   caller-supplied, unique, stable across retries
    minx, miny, maxx, maxy  DOUBLE  envelope; a point has minx = maxx, miny = maxy
    start_us, end_us        BIGINT  closed interval in epoch microseconds

Optional geometry columns (a *geometry frame*; see ``functions.geometry``):

    kind STRING, pts ARRAY<STRUCT<x DOUBLE, y DOUBLE>>, parts ARRAY<INT>, shells ARRAY<INT>

Any further columns are payload and travel with the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.time import epoch_us

KEY_COLUMNS = ["id", "minx", "miny", "maxx", "maxy", "start_us", "end_us"]
GEOM_COLUMNS = ["kind", "pts", "parts", "shells"]


def has_geometry(df: DataFrame) -> bool:
    return "pts" in df.columns


def side(df: DataFrame, prefix: str = "") -> G.Side:
    cols = set(df.columns)
    return G.Side(prefix, has_geometry(df), has_segs=(prefix + "segs") in cols or "segs" in cols)


def with_segments(df: DataFrame) -> DataFrame:
    """Geometry frame + ``segs``: its segment array computed once per row, so
    a join evaluating many pairs per row does not rebuild it per pair."""
    if not has_geometry(df) or "segs" in df.columns:
        return df
    return df.withColumn("segs", G.segments(F.col("pts"), F.col("parts")))


def check_frame(df: DataFrame) -> DataFrame:
    needed = KEY_COLUMNS + (GEOM_COLUMNS if has_geometry(df) else [])
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"not a spatio-temporal frame, missing {missing}")
    return df


def point_frame(df: DataFrame, id_col: str, x: Column | str, y: Column | str,
                start: str, end: str | None = None, payload: list[str] | None = None) -> DataFrame:
    """Rows -> box frame of points.  ``start`` / ``end`` are timestamp (or
    epoch-µs) column names; without ``end`` every row is an instant."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    s = epoch_us(df, start)
    e = epoch_us(df, end) if end else s
    cols = [F.col(id_col).cast("bigint").alias("id"),
            x.cast("double").alias("minx"), y.cast("double").alias("miny"),
            x.cast("double").alias("maxx"), y.cast("double").alias("maxy"),
            s.alias("start_us"), e.alias("end_us")]
    return df.select(*cols, *(payload or []))


def with_row_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Attach an id when the input has none.  ``monotonically_increasing_id``
    is unique but depends on the input partitioning; for ids that survive a
    recomputation over re-split input, supply a natural key instead."""
    return df.withColumn(name, F.monotonically_increasing_id())


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
