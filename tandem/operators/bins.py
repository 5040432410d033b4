"""A2 / A3: interval histograms with cumulative sums and overlap-count bounds.

``interval_bins`` splits ``[min start, max end]`` into ``n_bins`` equal bins
and counts, per group and bin, the rows starting and ending there, with
``ends_le`` = rows ending in this bin or before and ``starts_ge`` = rows
starting in this bin or after.  The bins table has ``groups x n_bins`` rows
whatever the data size; its cumulative sums are windows per group.

``overlap_count_bound`` turns that table into a lower bound of the number of
rows overlapping a query interval ``[a, c]``:
``total - ends_le(bin(a)) - starts_ge(bin(c))`` (bins partly inside the
query are counted as outside, so the bound is safe), and ``has_k``.

``equi_depth_bins`` cuts each group's starts and ends at their own quantiles instead, so that
every bin holds about as many rows whatever the skew, and a query loses about two bins' rows
wherever it lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div


@dataclass(frozen=True)
class BinSpec:
    origin_us: int
    width_us: int
    n_bins: int
    end_us: int


def bin_spec(df: DataFrame, n_bins: int) -> BinSpec | None:
    row = df.agg(F.min("start_us").alias("s"), F.max("end_us").alias("e")).first()
    if row["s"] is None:
        return None
    width = max(1, math.ceil((row["e"] - row["s"] + 1) / n_bins))
    return BinSpec(row["s"], width, n_bins, row["e"])


def _bin(c, spec: BinSpec):
    b = floor_div(F.col(c) - F.lit(spec.origin_us), spec.width_us)
    return F.least(F.greatest(b, F.lit(0)), F.lit(spec.n_bins - 1))


def _counts(df: DataFrame, g: list[str], start_bin: Column, end_bin: Column) -> DataFrame:
    """Rows starting and ending per group and bin, in one pass and one shuffle."""
    ends = F.array(F.struct(start_bin.alias("bin"), F.lit(1).alias("s"), F.lit(0).alias("e")),
                   F.struct(end_bin.alias("bin"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    return df.select(*g, F.inline(ends)).groupBy(*g, "bin").agg(
        F.sum("s").alias("n_start"), F.sum("e").alias("n_end"))


def _cumulated(dense: DataFrame, counts: DataFrame, g: list[str], keep: list[str]) -> DataFrame:
    t = dense.join(counts, [*g, "bin"], "left").select(
        *g, *keep, "bin", F.coalesce("n_start", F.lit(0)).alias("n_start"), F.coalesce("n_end", F.lit(0)).alias("n_end"))
    return _running(t, g)


def _running(t: DataFrame, g: list[str]) -> DataFrame:
    w = Window.partitionBy(*g).orderBy("bin")  # n_bins rows a group
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (t.withColumn("ends_le", F.sum("n_end").over(upto))
            .withColumn("starts_ge", F.sum("n_start").over(after))
            .withColumn("total", F.sum("n_start").over(whole)))


def interval_bins(df: DataFrame, spec: BinSpec, group_cols: list[str] | None = None) -> DataFrame:
    """Columns: group..., ``bin, n_start, n_end, ends_le, starts_ge, total``."""
    g = list(group_cols or [])
    keys = (df.select(*g).distinct() if g else df.sparkSession.range(1).select())
    dense = keys.select(*g, F.explode(F.sequence(F.lit(0), F.lit(spec.n_bins - 1))).alias("bin"))
    return _cumulated(dense, _counts(df, g, _bin("start_us", spec), _bin("end_us", spec)), g, [])


def grouped_interval_bins(df: DataFrame, group_cols: list[str], n_bins: int) -> DataFrame:
    """A2 with an origin and a width of each group's own: group...,
    ``origin_us, width_us, bin, n_start, n_end, ends_le, starts_ge, total``."""
    g = list(group_cols)
    span = F.col("_e") - F.col("origin_us") + 1
    specs = df.groupBy(*g).agg(F.min("start_us").alias("origin_us"), F.max("end_us").alias("_e")) \
        .withColumn("width_us", F.call_function("div", span + (n_bins - 1), F.lit(n_bins).cast("bigint"))).drop("_e")

    def place(c):
        return F.call_function("div", F.col(c) - F.col("origin_us"), F.col("width_us")).cast("int")

    dense = specs.select(*g, "origin_us", "width_us", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return _cumulated(dense, _counts(df.join(specs, g), g, place("start_us"), place("end_us")), g, ["origin_us", "width_us"])


def overlap_count_bound(queries: DataFrame, bins: DataFrame, spec: BinSpec, delta_us: int, k: int,
                        group_cols: list[str] | None = None) -> DataFrame:
    """Per query row (``id, start_us, end_us`` widened by delta, plus the
    group columns): ``lower_bound`` and ``has_k``.  The bins table is
    ``groups x n_bins`` rows, joined on (group, bin)."""
    g = list(group_cols or [])
    a = F.col("start_us") - delta_us
    c = F.col("end_us") + delta_us
    q = queries.select("id", *g, a.alias("_a"), c.alias("_c"))
    q = q.withColumn("_ba", _bin("_a", spec)).withColumn("_bc", _bin("_c", spec))
    lo = bins.select(*g, F.col("bin").alias("_ba"), "ends_le", "total")
    hi = bins.select(*g, F.col("bin").alias("_bc"), "starts_ge")
    j = q.join(lo, [*g, "_ba"]).join(hi, [*g, "_bc"])
    before = F.when(F.col("_a") > F.lit(spec.origin_us), F.col("ends_le")).otherwise(F.lit(0))
    after = F.when(F.col("_c") < F.lit(spec.end_us), F.col("starts_ge")).otherwise(F.lit(0))
    disjoint = (F.col("_a") > F.lit(spec.end_us)) | (F.col("_c") < F.lit(spec.origin_us))
    bound = F.when(disjoint, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.col("total") - before - after)).cast("bigint")
    return j.select("id", *g, bound.alias("lower_bound"), (bound >= k).alias("has_k"))


def equi_depth_cuts(df: DataFrame, group_cols: list[str], n_bins: int, accuracy: int = 10_000) -> DataFrame:
    """Per group: ``start_cuts, end_cuts`` (at most ``n_bins - 1`` rising values each), ``min_end, max_start``.
    The quantiles come from a mergeable sketch (rank error 1 / accuracy), so a group of any size is
    summed up before the shuffle.  Rows with a null start or end take no part."""
    shares = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])

    def cuts(c):
        return F.array_distinct(F.percentile_approx(c, shares, accuracy))

    return df.where(F.col("start_us").isNotNull() & F.col("end_us").isNotNull()).groupBy(*group_cols).agg(
        cuts("start_us").alias("start_cuts"), cuts("end_us").alias("end_cuts"),
        F.min("end_us").alias("min_end"), F.max("start_us").alias("max_start"))


def _place(c, cuts: str):
    """Number of cuts at or below ``c``: the bin that holds it."""
    return F.size(F.filter(F.col(cuts), lambda cut: cut <= c))


def equi_depth_bins(df: DataFrame, cuts: DataFrame, group_cols: list[str], n_bins: int) -> DataFrame:
    """A2 over the cuts of ``equi_depth_cuts``: group..., ``bin, n_start, n_end, ends_le, starts_ge, total``, where
    ``n_start`` counts by ``start_cuts`` and ``n_end`` by ``end_cuts``.  The counts are exact whatever the
    sketch's error.  Null groups are a group of their own."""
    g = list(group_cols)
    rows = df.where(F.col("start_us").isNotNull() & F.col("end_us").isNotNull()).select(*g, "start_us", "end_us")
    placed = _same_group(rows, cuts.select(*g, "start_cuts", "end_cuts"), g)
    counts = _counts(placed, g, _place(F.col("start_us"), "start_cuts"), _place(F.col("end_us"), "end_cuts"))
    # every bin of every group, then one sum: no join on keys that may be null
    dense = cuts.select(*g, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"),
                        F.lit(0).cast("bigint").alias("n_start"), F.lit(0).cast("bigint").alias("n_end"))
    t = dense.unionByName(counts).groupBy(*g, "bin").agg(F.sum("n_start").alias("n_start"), F.sum("n_end").alias("n_end"))
    return _running(t, g)


def _same_group(left: DataFrame, right: DataFrame, g: list[str]) -> DataFrame:
    """Inner join on the group columns in which null equals null."""
    other = right.select(*[F.col(c).alias(f"_g_{c}") if c in g else F.col(c) for c in right.columns])
    met = F.lit(True)
    for c in g:
        met = met & left[c].eqNullSafe(F.col(f"_g_{c}"))
    return left.join(other, met).drop(*[f"_g_{c}" for c in g])


def equi_depth_bound(queries: DataFrame, bins: DataFrame, cuts: DataFrame, delta_us: int, k: int,
                     group_cols: list[str]) -> DataFrame:
    """A3 over equi-depth bins: per query row (``id, start_us, end_us`` and the group columns), widened by delta,
    ``lower_bound`` and ``has_k``.  Rows that end in the bin of the query's start or before, or start in the bin of its
    end or after, count as outside, so the bound never exceeds the true count.  A query
    whose group has no rows is left out."""
    g = list(group_cols)
    q = _same_group(queries.select("id", *g, (F.col("start_us") - delta_us).alias("_a"),
                                   (F.col("end_us") + delta_us).alias("_c")), cuts, g)
    q = q.select("id", *g, F.struct("_a", "_c", "min_end", "max_start").alias("_q"),
                 _place(F.col("_a"), "end_cuts").alias("_ba"), _place(F.col("_c"), "start_cuts").alias("_bc"))
    lo = bins.select(*g, F.col("bin").alias("_ba"), "ends_le", "total")
    hi = bins.select(*g, F.col("bin").alias("_bc"), "starts_ge")
    j = _same_group(_same_group(q, lo, [*g, "_ba"]), hi, [*g, "_bc"])
    before = F.when(F.col("_q._a") > F.col("_q.min_end"), F.col("ends_le")).otherwise(F.lit(0))
    after = F.when(F.col("_q._c") < F.col("_q.max_start"), F.col("starts_ge")).otherwise(F.lit(0))
    bound = F.greatest(F.lit(0), F.col("total") - before - after).cast("bigint")
    return j.select("id", *g, bound.alias("lower_bound"), (bound >= k).alias("has_k"))
