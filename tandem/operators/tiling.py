"""Sampling, time slicing and spatial tiling as data operators.

Everything that depends on all rows is an aggregate (histogram, per-level
counts) computed in parallel; only tables whose size is fixed by a
parameter (<= alpha periods, <= 4^max_level tiles) are ordered in one
window or brought to the driver as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.time import floor_div
from ..model import side

# Fixed values (Spark's sampling-size bound for sampling without replacement).
SAMPLE_FAILURE_RATE = 1e-4
SMALL_INPUT = 1000


# ------------------------------------------------------------------ D1

def sample_size(total: int, alpha: int, beta: int) -> int:
    return total if total < SMALL_INPUT else max(2 * alpha * beta, total // 100)


def sample_fraction(size: int, total: int) -> float:
    """Fraction that yields at least ``size`` of ``total`` rows with
    probability 1 - 1e-4 when sampling without replacement."""
    if total <= 0:
        return 1.0
    p = size / total
    gamma = -math.log(SAMPLE_FAILURE_RATE) / total
    return min(1.0, max(1e-10, p + gamma + math.sqrt(gamma * gamma + 2 * gamma * p)))


def sample_bounds(df: DataFrame, alpha: int, beta: int, seed: int = 42) -> DataFrame:
    """A Bernoulli sample of the rows' space-time bounds, sized as above.
    A row's draw is a hash of its id and the seed, so a retried task and another
    input split pick the same rows."""
    total = df.count()
    frac = sample_fraction(sample_size(total, alpha, beta), total)
    text = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    draw = F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.where(draw < F.lit(frac)).select("id", "minx", "miny", "maxx", "maxy", "start_us", "end_us")


# ------------------------------------------------------------------ D2 / A7

def time_periods(df: DataFrame, alpha: int, beta: int, k: int, delta_us: int,
                 rate: float = 1.0) -> DataFrame:
    """Cut the time axis into periods of roughly equal row counts.

    min_span = max(2 delta, mean length, range / alpha); min_count =
    max(n // alpha, ceil(rate * beta * k)).  Starts are counted in bins of
    width min_span (at most alpha + 1 bins).  A period takes bins until it
    holds min_count rows, so both minima hold; a last period with fewer joins
    the one before it.  Periods are half-open ``[p_start, p_end)``; the last ends after
    the last end instant.  Columns: ``period, p_start, p_end, n``.
    """
    st = df.agg(F.min("start_us").alias("s"), F.max("end_us").alias("e"), F.count(F.lit(1)).alias("n"),
                F.avg(F.col("end_us") - F.col("start_us")).alias("len")).first()
    if st["s"] is None:
        return df.sparkSession.createDataFrame([], "period int, p_start bigint, p_end bigint, n bigint")
    t0, t1, n = st["s"], st["e"], st["n"]
    span = max(1, int(math.ceil(max(2 * delta_us, st["len"] or 0.0, (t1 - t0) / alpha))))
    min_count = max(n // alpha, int(math.ceil(rate * beta * k)))
    hist = df.groupBy(floor_div(F.col("start_us") - F.lit(t0), span).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("cnt"))
    groups: list[list[int]] = []  # first bin, rows
    for bin_, cnt in sorted((r["bin"], r["cnt"]) for r in hist.collect()):  # at most alpha + 1 rows
        if groups and groups[-1][1] < min_count:
            groups[-1][1] += cnt
        else:
            groups.append([bin_, cnt])
    if len(groups) > 1 and groups[-1][1] < min_count:
        last = groups.pop()
        groups[-1][1] += last[1]
    starts = [t0 + b * span for b, _ in groups]
    ends = starts[1:] + [t1 + 1]
    return df.sparkSession.createDataFrame(
        [(i, s, e, g[1]) for i, (s, e, g) in enumerate(zip(starts, ends, groups))],
        "period int, p_start bigint, p_end bigint, n bigint")


def in_periods(df: DataFrame, periods: DataFrame, start: Column, end: Column) -> DataFrame:
    """Each row of ``df`` once per period ``[p_start, p_end)`` that its closed range
    ``[start, end]`` meets, with ``period`` added: a binned range join, for a periods
    table of any size (periods may leave gaps).

    The bins have the periods' mean length, so the periods stand in at most two bins
    each on average, and a row in about as many bins as periods it meets.  A pair that
    shares several bins counts in the bin of its later start."""
    spec = periods.agg(F.min("p_start").alias("lo"), F.max("p_end").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if spec["n"] == 0:
        return df.withColumn("period", F.lit(None).cast(periods.schema["period"].dataType)).where(F.lit(False))
    lo, hi = spec["lo"], spec["hi"]
    width = max(1, (hi - lo) // spec["n"])

    def bins(first, last):
        return F.sequence(floor_div(first - F.lit(lo), width), floor_div(last - F.lit(lo), width))

    p = periods.where("p_start < p_end").select(
        F.col("period").alias("_period"), F.col("p_start").alias("_ps"), F.col("p_end").alias("_pe"),
        F.explode(bins(F.col("p_start"), F.col("p_end") - 1)).alias("_bin"))
    rows = df.withColumn("_a", start).withColumn("_c", end).where((F.col("_c") >= lo) & (F.col("_a") < hi))
    rows = rows.withColumn("_bin", F.explode(bins(F.greatest("_a", F.lit(lo)), F.least("_c", F.lit(hi - 1)))))
    met = rows.join(p, "_bin").where((F.col("_ps") <= F.col("_c")) & (F.col("_pe") > F.col("_a"))
                                     & (floor_div(F.greatest("_a", "_ps") - F.lit(lo), width) == F.col("_bin")))
    return met.select(*df.columns, F.col("_period").alias("period"))


def periods_for_range(df: DataFrame, periods: DataFrame, delta_us: int = 0) -> DataFrame:
    """Every period ``[p_start, p_end)`` that a row's interval (widened by
    delta) meets -> rows ``(id, period)``."""
    return in_periods(df.select("id", "start_us", "end_us"), periods, F.col("start_us") - delta_us,
                      F.col("end_us") + delta_us).select("id", "period")


def period_density(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows (by start) per microsecond of each period; rows that start in no
    period do not count."""
    counts = in_periods(df.select("start_us"), periods, F.col("start_us"), F.col("start_us")) \
        .groupBy("period").agg(F.count(F.lit(1)).alias("cnt"))
    span = F.col("p_end") - F.col("p_start")
    return (periods.join(counts, "period", "left")
            .select("period", "p_start", "p_end", F.coalesce("cnt", F.lit(0)).alias("n"))
            .withColumn("density", F.when(span > 0, F.col("n") / span)))


# ------------------------------------------------------------------ D3 / D8 / D9

def level_counts(df: DataFrame, grid: G.Grid, max_level: int) -> DataFrame:
    """Rows per (level, cx, cy) for levels 0..max_level, each row counted once
    per level at the cell of its vertex."""
    from .knn import explode_levels
    vx, vy = side(df).vertex()
    return (explode_levels(df.select(vx.alias("_vx"), vy.alias("_vy")), max_level, "level")
            .groupBy("level", grid.cx(F.col("_vx"), F.col("level")).alias("cx"),
                     grid.cy(F.col("_vy"), F.col("level")).alias("cy"))
            .agg(F.count(F.lit(1)).alias("n")))


def tile_cap(n: int, beta: int, k: int, rate: float = 1.0) -> int:
    return max(n // beta, int(math.ceil(4 * rate * k)))


def quad_tiles(df: DataFrame, grid: G.Grid, beta: int, k: int, max_level: int, rate: float = 1.0,
               n: int | None = None) -> DataFrame:
    """D3: adaptive quad tiling.  cap = max(n // beta, ceil(4 rate k)).  A cell
    is split when it holds more than cap rows and is above max_level; the
    tiles are the root when unsplit, and every child (the four quadrants,
    empty ones included) of a split cell that is not split itself.  They
    cover the root exactly once.  Columns: ``level, cx, cy, n`` + box."""
    if n is None:
        n = df.count()
    cap = tile_cap(n, beta, k, rate)
    counts = level_counts(df, grid, max_level)
    split = counts.where((F.col("n") > cap) & (F.col("level") < max_level))
    kids = split.select((F.col("level") + 1).alias("level"),
                        F.explode(F.array(*[F.struct(*[c.alias(nm) for c, nm in zip(G.quadrant("cx", "cy", q), ("cx", "cy"))])
                                            for q in range(4)])).alias("q")) \
        .select("level", "q.cx", "q.cy")
    kids = kids.join(counts, ["level", "cx", "cy"], "left") \
        .select("level", "cx", "cy", F.coalesce("n", F.lit(0)).alias("n"))
    leaf_kids = kids.where((F.col("n") <= cap) | (F.col("level") == max_level))
    root = counts.where((F.col("level") == 0) & ~((F.col("n") > cap) & (F.lit(max_level) > 0)))
    tiles = root.unionByName(leaf_kids)
    x0, y0, x1, y1 = grid.cell_box(F.col("level"), F.col("cx"), F.col("cy"))
    return tiles.select("level", "cx", "cy", "n", x0.alias("minx"), y0.alias("miny"),
                        x1.alias("maxx"), y1.alias("maxy"))


def cell_envelope(cells: DataFrame, grid: G.Grid) -> DataFrame:
    """Box of each (level, cx, cy)."""
    x0, y0, x1, y1 = grid.cell_box(F.col("level"), F.col("cx"), F.col("cy"))
    return cells.withColumn("minx", x0).withColumn("miny", y0).withColumn("maxx", x1).withColumn("maxy", y1)


def quadrant_envelopes(cells: DataFrame, grid: G.Grid) -> DataFrame:
    """The four quadrant sub-boxes of each (level, cx, cy): quadrant 0 SW,
    1 SE, 2 NW, 3 NE, as cells one level down."""
    kids = F.array(*[F.struct(F.lit(q).alias("q"), *[c.alias(n) for c, n in zip(G.quadrant("cx", "cy", q), ("qx", "qy"))])
                     for q in range(4)])
    out = cells.select("level", "cx", "cy", F.inline(kids))
    x0, y0, x1, y1 = grid.cell_box(F.col("level") + 1, F.col("qx"), F.col("qy"))
    return out.select("level", "cx", "cy", "q", x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))


def period_cell_assign(df: DataFrame, periods: DataFrame, grid: G.Grid, level: int) -> DataFrame:
    """D4 over adaptive periods: every (period, cell) a row's interval and
    envelope meet -> ``(id, period, cx, cy)``; rows outside all periods are dropped."""
    met = in_periods(df.select("id", "minx", "miny", "maxx", "maxy", "start_us", "end_us"), periods,
                     F.col("start_us"), F.col("end_us"))
    return (met.select("id", "period",
                       F.sequence(grid.cx(F.col("minx"), level), grid.cx(F.col("maxx"), level)).alias("_xs"),
                       F.sequence(grid.cy(F.col("miny"), level), grid.cy(F.col("maxy"), level)).alias("_ys"))
            .select("id", "period", F.explode("_xs").alias("cx"), "_ys")
            .select("id", "period", "cx", F.explode("_ys").alias("cy")))


def cell_numbering(tiles: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Dense ids 0..n-1 over a small tile table (bounded by its level cap)."""
    w = Window.orderBy(*(order or ["level", "cx", "cy"]))
    return tiles.withColumn("tile", (F.row_number().over(w) - 1).cast("int"))


# ------------------------------------------------------------------ D4 / D5

def cell_assign(df: DataFrame, grid: G.Grid, level: int, bin_us: int) -> DataFrame:
    """Every (time bin, cell) a row's interval and envelope meet ->
    ``(id, tb, cx, cy)``; a row spanning several keys is replicated."""
    return cell_assign_within(df, grid, level, bin_us, 0.0, 0)


def cell_assign_within(df: DataFrame, grid: G.Grid, level: int, bin_us: int, dist: float,
                       delta_us: int) -> DataFrame:
    """As D4 after widening the envelope by ``dist`` and the interval by delta."""
    d = F.lit(float(dist))
    return (df.select("id",
                      F.explode(F.sequence(floor_div(F.col("start_us") - delta_us, bin_us),
                                           floor_div(F.col("end_us") + delta_us, bin_us))).alias("tb"),
                      F.sequence(grid.cx(F.col("minx") - d, level), grid.cx(F.col("maxx") + d, level)).alias("_xs"),
                      F.sequence(grid.cy(F.col("miny") - d, level), grid.cy(F.col("maxy") + d, level)).alias("_ys"))
            .select("id", "tb", F.explode("_xs").alias("cx"), "_ys")
            .select("id", "tb", "cx", F.explode("_ys").alias("cy")))


def grid_for(df: DataFrame) -> G.Grid:
    """Square root cell over a frame's envelope (one aggregate row)."""
    r = df.agg(F.min("minx").alias("a"), F.min("miny").alias("b"),
               F.max("maxx").alias("c"), F.max("maxy").alias("d")).first()
    if r["a"] is None:
        return G.Grid(0.0, 0.0, 1.0)
    s = max(r["c"] - r["a"], r["d"] - r["b"])
    return G.Grid(float(r["a"]), float(r["b"]), float(s) if s > 0 else 1.0)
