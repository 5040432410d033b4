"""Predicates as DataFrame filters (F1-F7) and input validation (V1).

All predicates are plain column comparisons; on a projection of raw parquet
columns Catalyst pushes them into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import time as TM
from ..model import check_frame, has_geometry, side


def _box(b) -> G.LitBox:
    return G.LitBox(*[float(v) for v in b])


def interval_overlap_filter(df: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """rows whose interval overlaps ``[start_us, end_us]`` (closed)."""
    return df.where(TM.overlaps("start_us", "end_us", F.lit(start_us), F.lit(end_us)))


def envelope_intersects_filter(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """rows whose envelope meets a query box (closed)."""
    return df.where(G.envelope_intersects(side(df), _box(box)))


def bound_contains_point_filter(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """rows whose vertex lies in the box, half-open ``[min, max)``."""
    vx, vy = side(df).vertex()
    return df.where(G.contains_point_half_open(*[F.lit(float(v)) for v in box], vx, vy))


def bound_contains_time_filter(df: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """rows whose start instant lies in ``[start_us, end_us)``."""
    return df.where(TM.bound_contains_time("start_us", F.lit(start_us), F.lit(end_us)))


def bound_contains_range_filter(df: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """rows whose interval lies strictly inside ``(start_us, end_us)``."""
    return df.where(TM.bound_contains_range("start_us", "end_us", F.lit(start_us), F.lit(end_us)))


def bound_contains_envelope_filter(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """rows whose envelope lies inside the box (closed)."""
    return df.where(G.contains_envelope(_box(box), side(df)))


def right_prefilter(right: DataFrame, left: DataFrame, delta_us: int) -> DataFrame:
    """keep S rows that overlap R's whole time range widened by delta.
    R's range is one aggregate row; the filter then uses literals, so it can
    reach the scan of S."""
    row = left.agg(F.min("start_us").alias("s"), F.max("end_us").alias("e")).first()
    if row["s"] is None:
        return right.where(F.lit(False))
    return right.where(TM.overlaps("start_us", "end_us", F.lit(row["s"] - delta_us),
                                   F.lit(row["e"] + delta_us)))


#: every problem that ``row_problems`` names
PROBLEMS = ("malformed geometry", "empty geometry", "null id", "null time", "start after end", "missing coordinate",
            "infinite coordinate", "empty envelope")


def row_problems(df: DataFrame) -> Column:
    """NULL when the row is valid, else the first problem found."""
    checks = [
        (F.col("id").isNull(), "null id"),
        (F.col("start_us").isNull() | F.col("end_us").isNull(), "null time"),
        (F.col("start_us") > F.col("end_us"), "start after end"),
        (F.isnan("minx") | F.isnan("miny") | F.isnan("maxx") | F.isnan("maxy") | F.col("minx").isNull()
         | F.col("miny").isNull() | F.col("maxx").isNull() | F.col("maxy").isNull(), "missing coordinate"),
        (F.greatest(*[F.abs(F.col(c)) for c in ("minx", "miny", "maxx", "maxy")]) == float("inf"), "infinite coordinate"),
        (F.col("minx") > F.col("maxx"), "empty envelope"),
        (F.col("miny") > F.col("maxy"), "empty envelope"),
    ]
    if has_geometry(df):
        # a malformed text has neither points nor an envelope
        checks.insert(0, (F.col("kind").isNull(), "malformed geometry"))
        checks.insert(1, (F.coalesce(F.size("pts"), F.lit(0)) <= 0, "empty geometry"))
    out = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        out = F.when(cond, F.lit(msg)).otherwise(out)
    return out


def validate_rows(df: DataFrame, mode: str = "flag") -> DataFrame:
    """V1.  ``flag``: add ``problem`` (NULL = valid).  ``permissive``: keep
    valid rows only.  ``rejected``: keep invalid rows with ``problem``.
    ``strict``: fail the job on the first invalid row."""
    problem = row_problems(df)
    if mode == "flag":
        return df.withColumn("problem", problem)
    if mode == "permissive":
        return df.where(problem.isNull())
    if mode == "rejected":
        return df.withColumn("problem", problem).where(F.col("problem").isNotNull())
    if mode == "strict":
        checked = F.when(problem.isNotNull(), F.raise_error(F.concat(
            F.lit("invalid row "), F.col("id").cast("string"), F.lit(": "), problem)))
        return df.where(checked.isNull())
    raise ValueError(f"unknown mode {mode}")


def valid_rows(df: DataFrame, invalid: str = "drop") -> DataFrame:
    """The valid rows of a frame; an invalid one is dropped or fails the job."""
    modes = {"drop": "permissive", "fail": "strict"}
    if invalid not in modes:
        raise ValueError("invalid must be 'drop' or 'fail'")
    return validate_rows(check_frame(df), modes[invalid])
