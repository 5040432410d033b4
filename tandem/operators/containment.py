"""R rows inside many S rows at once: the k smallest ids per space-time block.

An R row that lies in hundreds of boxes ties with all of them at distance 0, and the k
with the smallest ids win.  The cell join would compare it with every one.  Here each
block (cell of one level, time bin) keeps its ``limit`` smallest ids, and the
next one as a marker:

    R meets at most ``limit`` rows per block, whatever the block holds;
    horizon(R) = the least marker among R's blocks (none: R has met everything);
    every S row with an id below the horizon is kept in all of R's blocks,
    so k rows at distance 0 below the horizon are R's k nearest.

R rows without k such rows come again with ``GROWTH`` times the limit, at most ``ROUNDS`` times;
what is left takes the ordinary join.  Only R rows that stand in a block of more than
``limit`` rows take part, and only if S has extent (points rarely tie at 0; copies
of points are removed elsewhere).  Blocks keep their ids with a window whose limit runs
before the shuffle, so a block holding a third of S costs ``limit`` rows a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.time import floor_div
from ..model import KEY_COLUMNS, has_geometry, prefixed, side, with_segments
from ..session import stored
from . import knn as KN
from . import segments as SG

FIRST = 4       # times k: ids kept per block in the first round
GROWTH = 8
ROUNDS = 5
TASKS = 256     # (block, salt) keys that keep all cores busy
CELLS = 6       # most cells a row of either side stands in, on average
DEEPEST = 10    # deepest level of the blocks
NO_GAP = 1e-100  # gaps below it may have a distance of 0
BLOCK = ["_cx", "_cy", "_tb"]
OWN_BLOCK = [*KN.KEYS, "_full"]


def block_level(left: DataFrame, right: DataFrame, plan: KN.KnnPlan) -> int:
    """The deepest level at which the rows of either side stand in at most ``CELLS`` cells on average.  One level for
    all rows: R then meets few blocks, so few of them lower its horizon."""
    def cells(lv):
        g = plan.grid
        wide, high = (g.cx(F.col("maxx"), F.lit(lv)) - g.cx(F.col("minx"), F.lit(lv)) + 1,
                      g.cy(F.col("maxy"), F.lit(lv)) - g.cy(F.col("miny"), F.lit(lv)) + 1)
        return F.avg(wide.cast("double") * high).alias(f"l{lv}")
    mean = [cells(lv) for lv in range(DEEPEST + 1)]
    sides = left.agg(*mean).unionByName(right.agg(*mean)).collect()
    return max([lv for lv in range(DEEPEST + 1) if all((r[f"l{lv}"] or 0) <= CELLS for r in sides)], default=0)


def _placed(df: DataFrame, plan: KN.KnnPlan, level: int, p: str, widen: int) -> DataFrame:
    """Rows in the blocks that their envelope and their interval (widened by ``widen``) meet."""
    g, lv = plan.grid, F.lit(level)
    return (df.withColumn("_cx", F.explode(F.sequence(g.cx(F.col(p + "minx"), lv), g.cx(F.col(p + "maxx"), lv))))
            .withColumn("_cy", F.explode(F.sequence(g.cy(F.col(p + "miny"), lv), g.cy(F.col(p + "maxy"), lv))))
            .withColumn("_tb", F.explode(F.sequence(floor_div(F.col(p + "start_us") - widen, plan.join_bin_us),
                                                    floor_div(F.col(p + "end_us") + widen, plan.join_bin_us)))))


def blocks(right: DataFrame, plan: KN.KnnPlan, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S rows (``r_*``) in every block they meet at levels of their own, and those levels."""
    right_p = KN.with_own_level(prefixed(right, "r_"), plan)
    return KN.right_cells(right_p, plan, levels), right_p.select("_own").distinct()


def probes(left: DataFrame, plan: KN.KnnPlan, own_levels: DataFrame) -> DataFrame:
    """R rows (``l_*``) in the blocks their own envelope meets (search radius 0)."""
    lp = prefixed(left, "l_").withColumnRenamed("l__lv", "_lv").withColumn("_d", F.lit(0.0))
    return KN.left_cells(lp, plan, own_levels).withColumnRenamed("_probe", "_full")


def smallest_ids(cells: DataFrame, limit: int, block: list[str] = OWN_BLOCK) -> DataFrame:
    """The ``limit`` smallest ids of each block and the next one, with their place in it (``_nth``)."""
    nth = F.row_number().over(Window.partitionBy(*block).orderBy("r_id"))
    return cells.withColumn("_nth", nth).where(F.col("_nth") <= limit + 1)


def level_blocks(right: DataFrame, plan: KN.KnnPlan, level: int, limit: int) -> DataFrame:
    """The smallest ids of the blocks of one level, in which every S row stands (without its geometry)."""
    return smallest_ids(_placed(prefixed(right.select(*KEY_COLUMNS), "r_"), plan, level, "r_", 0), limit, BLOCK)


def _apart(plan: KN.KnnPlan) -> Column:
    """Envelopes at distance 0, overlap in time, and the pair counted in this block."""
    # most pairs of a block lie apart, which plain comparisons tell (a gap whose square is 0 is no gap here either)
    gap = lambda a, b: F.col(a) - F.col(b) < F.lit(NO_GAP)
    close = gap("l_minx", "r_maxx") & gap("r_minx", "l_maxx") & gap("l_miny", "r_maxy") & gap("r_miny", "l_maxy")
    return close & KN.time_match(plan) & (G.envelope_distance(G.Side("l_"), G.Side("r_")) == 0) & KN.owned_once(plan)


def met(left: DataFrame, right: DataFrame, plan: KN.KnnPlan, limit: int) -> DataFrame:
    """(l_id, r_id, _marker, _zero): the rows each R row meets, all at levels of their own (``_lv``); ``_zero`` says
    that the pair is at distance 0, overlaps in time and is counted in this block."""
    left, right = with_segments(left), with_segments(right)
    cells, own = blocks(right, plan, left.select("_lv").distinct())
    kept = smallest_ids(cells, limit).withColumn("_marker", F.col("_nth") > limit)
    pairs = KN.keyed(probes(left, plan, own)).join(kept, OWN_BLOCK)
    zero = F.when(~F.col("_marker") & _apart(plan), G.geometry_distance(side(left, "l_"), side(right, "r_")) == 0)
    return pairs.select("l_id", "r_id", "_marker", F.coalesce(zero, F.lit(False)).alias("_zero"))


def met_at_level(left: DataFrame, right: DataFrame, index: DataFrame, plan: KN.KnnPlan, limit: int, level: int,
                 salts: int, edges: DataFrame | None = None) -> DataFrame:
    """``met`` among the stored ``level_blocks``: only markers and pairs at distance 0.  R rows of a block are dealt
    to ``salts`` tasks, so few blocks still keep all cores busy.  ``edges``: S's geometry for an R of points."""
    kept = index.where(F.col("_nth") <= limit + 1).withColumn("_marker", F.col("_nth") > limit).drop("_nth")
    lp = _placed(prefixed(left.select(*KEY_COLUMNS), "l_"), plan, level, "l_", plan.delta_us)
    keys = list(BLOCK)
    if salts > 1:
        every = kept.withColumn("_salts", F.sequence(F.col("_tb") * 0, F.col("_tb") * 0 + (salts - 1)))
        kept = every.select(*kept.columns, F.explode("_salts").alias("_salt"))
        lp = lp.withColumn("_salt", F.pmod(F.xxhash64("l_id"), F.lit(salts)))
        keys.append("_salt")
    pairs = KN.keyed(lp).join(kept, keys).withColumns({"_lv": F.lit(level), "_d": F.lit(0.0)})
    at = [] if edges is None else ["l_minx", "l_miny"]
    near = pairs.select("l_id", "r_id", "_marker", (~F.col("_marker") & _apart(plan)).alias("_zero"), *at).where("_marker or _zero")
    if not (has_geometry(left) or has_geometry(right)):
        return near
    # few pairs are left: geometry joins them by id
    def shapes(df, p):
        df = with_segments(df)
        return prefixed(df.select("id", *[c for c in df.columns if c not in ("id", "start_us", "end_us")]), p)
    if edges is not None:
        touch = SG.point_distances(near.where("_zero"), edges).where(F.col("dist") == 0) \
            .select("l_id", "r_id", F.lit(False).alias("_marker"), F.lit(True).alias("_zero"))
    else:
        touch = near.where("_zero").join(KN.keyed(shapes(left, "l_")), "l_id").join(KN.keyed(shapes(right, "r_")), "r_id") \
            .where(G.geometry_distance(side(with_segments(left), "l_"), side(with_segments(right), "r_")) == 0)
    return near.where("_marker").groupBy("l_id").agg(F.min("r_id").alias("r_id")) \
        .select("l_id", "r_id", F.lit(True).alias("_marker"), F.lit(False).alias("_zero")) \
        .unionByName(touch.select("l_id", "r_id", "_marker", "_zero"))


def best_ids(pairs: DataFrame, k: int) -> DataFrame:
    """(l_id, ids): the k smallest ids at distance 0, for the R rows that have k below their horizon (the least
    marker): those whose first k rows by id, a marker before its equal, hold no marker.  The window's limit runs
    before the shuffle, so k rows an R row and task are shuffled, however many are at distance 0."""
    nth = F.row_number().over(Window.partitionBy("l_id").orderBy("r_id", F.col("_marker").desc()))
    first = pairs.where("_marker or _zero").select("l_id", "r_id", "_marker").withColumn("_nth", nth).where(F.col("_nth") <= k)
    found = first.groupBy("l_id").agg(F.max("_marker").alias("_cut"), F.array_sort(F.collect_list("r_id")).alias("ids"))
    return found.where(~F.col("_cut") & (F.size("ids") == k)).select("l_id", "ids")


def nearest_inside(left: DataFrame, right: DataFrame, plan: KN.KnnPlan,
                   edges: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """((l_id, r_id, dist, rank) of the R rows settled here or None, the R rows left).  ``edges``: see ``met_at_level``."""
    k = plan.k
    if not plan.right_stats.avg_extent or plan.right_stats.n <= FIRST * k:
        return None, left
    level, limit = block_level(left, right, plan), FIRST * k
    index = stored(level_blocks(right, plan, level, limit * GROWTH ** (ROUNDS - 1)), "blocks")
    fullest, n_blocks = index.agg(F.max("_nth"), F.count(F.when(F.col("_nth") == 1, 1))).first()
    if fullest is None or fullest <= limit:
        return None, left
    salts = math.ceil(TASKS / n_blocks)
    dense = index.where(F.col("_nth") == limit + 1).select(*BLOCK)
    inside = _placed(prefixed(left.select(*KEY_COLUMNS), "l_"), plan, level, "l_", plan.delta_us).select("l_id", *BLOCK).join(dense, BLOCK, "left_semi") \
        .select(F.col("l_id").alias("id")).distinct()
    pending, done = stored(left.join(inside, "id", "left_semi"), "pending"), None
    for _ in range(ROUNDS):
        found = stored(best_ids(met_at_level(pending, right, index, plan, limit, level, salts, edges), k), "inside")
        done = found if done is None else done.unionByName(found)
        if limit >= fullest:
            break
        pending = pending.join(found, F.col("id") == F.col("l_id"), "left_anti")
        if pending.isEmpty():
            break
        limit *= GROWTH
    rest = stored(left.join(done, F.col("id") == F.col("l_id"), "left_anti"), "rest")
    rows = done.select("l_id", F.posexplode("ids").alias("_at", "r_id")).select(
        "l_id", "r_id", F.lit(0.0).alias("dist"), (F.col("_at") + 1).alias("rank"))
    return rows, rest
