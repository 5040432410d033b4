"""Registered queries: one Spark plan per operator, each reading the shared
test tables of ``sf_dir`` (work grows with them), and the DuckDB SQL that
states the same result by brute force over the same parquet tables.

Column names and types match between a query and its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import time as TM
from ..functions.wkt import to_wkt, with_wkt_geometry
from ..model import point_frame, prefixed, with_row_id
from ..operators import bins as B
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import knn as KN
from ..operators import segments as SG
from ..operators import stats as ST
from ..operators import tiling as TL
from ..session import shared_dir, spread, stored
from ..sources import fixtures as fx
from ..sources import results as RS
from ..sources.layout import layout_knn_query, write_layout
from ..sources.tsv import VALID, load_wkt_tsv, parse_lines, read_wkt_tsv

# Parameters of the registered queries.
K = 5
DAY = TM.MICROS_PER_DAY
HOUR = 3_600_000_000
DELTA = DAY                     # time tolerance of the kNN queries
WIN_START = 1_704_844_800_000_000   # 2024-01-10 00:00:00 UTC in µs
WIN_END = 1_704_931_200_000_000     # 2024-01-11 00:00:00
WIN_END2 = 1_705_017_600_000_000    # 2024-01-12 00:00:00
QUERY_BOX = (100.0, 20.0, 200.0, 60.0)
OUTER_BOX = (100.0, 20.0, 300.0, 80.0)
N_BINS = 200
DEPTH_BINS = 8
ALPHA, BETA, TILE_K = 20, 4, 15
QUAD_BETA, QUAD_LEVEL = 40, 6


# ----------------------------------------------------------------- helpers

def _ev(spark, sf):
    return fx.table(spark, sf, "events")


def generated_wkt(spark: SparkSession, sf: str, event_type: str | None = None) -> DataFrame:
    """One WKT geometry per event, its shape fixed by the event type and
    placed at (value, k): purchase POINT, view LINESTRING (2 segments),
    click POLYGON 4x4 with a 1x1 hole, signup MULTIPOINT, error MULTIPOLYGON
    of two unit squares."""
    raw = _ev(spark, sf)
    if event_type is not None:
        raw = raw.where(F.col("event_type") == event_type)
    # staged: the JSON field is read once per row, not once per coordinate, and all cores take part
    ev = spread(raw, "event_id", costly=True).select("event_id", "event_type", "ts", F.col("value").alias("x"),
                    F.get_json_object("props", "$.k").cast("double").alias("y"),
                    TM.epoch_us(raw, "ts").alias("t"))
    x, y = F.col("x"), F.col("y")

    def n(c):
        return c.cast("string")

    def xy(dx, dy):
        return F.concat_ws(" ", n(x + dx), n(y + dy))

    def ring(*pts):
        return F.concat(F.lit("("), F.concat_ws(", ", *[xy(a, b) for a, b in pts]), F.lit(")"))

    sq = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    u1 = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    u2 = [(3, 0), (4, 0), (4, 1), (3, 1), (3, 0)]
    wkt = (F.when(F.col("event_type") == "purchase", F.concat(F.lit("POINT ("), xy(0, 0), F.lit(")")))
           .when(F.col("event_type") == "view", F.concat(F.lit("LINESTRING "), ring((0, 0), (2, 0), (2, 3))))
           .when(F.col("event_type") == "click",
                 F.concat(F.lit("POLYGON ("), ring(*sq), F.lit(", "), ring(*hole), F.lit(")")))
           .when(F.col("event_type") == "signup",
                 F.concat(F.lit("MULTIPOINT ("), ring((0, 0)), F.lit(", "), ring((1, 1)), F.lit(")")))
           .otherwise(F.concat(F.lit("MULTIPOLYGON (("), ring(*u1), F.lit("), ("), ring(*u2), F.lit("))"))))
    return ev.select(F.col("event_id").alias("id"), wkt.alias("wkt"), "ts", "x", "y", "t")


def geometry_frame(spark, sf, event_type: str | None = None) -> DataFrame:
    g = generated_wkt(spark, sf, event_type)
    p = with_wkt_geometry(g.select("id", "x", "y", "t", "wkt"), "wkt")
    return p.select("id", "kind", "pts", "parts", "shells", "minx", "miny", "maxx", "maxy",
                    F.col("t").alias("start_us"), F.col("t").alias("end_us"), "x", "y")


def _knn(spark, sf, k=K, delta=DELTA):
    return KN.st_knn_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), k, delta)


def _box_pairs(spark, sf):
    """box_left x box_right of the same user whose day falls in the left
    row's 4-day period: each right box meets exactly one left box."""
    bl = fx.box_left(spark, sf)
    br = fx.box_right(spark, sf)
    p4 = F.floor(F.col("start_us") / F.lit(4 * DAY)).cast("bigint")
    lp = bl.select(*[F.col(c).alias("l_" + c) for c in bl.columns], p4.alias("_p"))
    rp = br.select(*[F.col(c).alias("r_" + c) for c in br.columns], p4.alias("_p"))
    return lp.join(rp, (lp.l_user_id == rp.r_user_id) & (lp._p == rp._p))


def _round(c, d=6):
    return F.round(c, d)


# ----------------------------------------------------------------- queries

def q_parse_time(spark, sf):
    ev = _ev(spark, sf)
    text = F.date_format("ts", TM.TIME_FORMAT)
    return ev.select(F.col("event_id").alias("id"), text.alias("t_text"),
                     TM.parse_time(text).alias("epoch_us"))


def q_load_wkt_tsv(spark, sf):
    df = parse_lines(fx.wkt_lines(spark, sf))
    return df.select("id", "kind", "minx", "miny", "maxx", "maxy", "start_us", "end_us")


def q_parse_wkt(spark, sf):
    g = geometry_frame(spark, sf)
    return g.select("id", "kind", F.size("pts").alias("n_pts"), F.size("parts").alias("n_parts"),
                    "minx", "miny", "maxx", "maxy")


def q_envelope(spark, sf):
    g = geometry_frame(spark, sf)
    return g.select("id", "minx", "miny", "maxx", "maxy")


def q_envelope_expand(spark, sf):
    b = fx.box_right(spark, sf)
    x0, y0, x1, y1 = G.expand_envelope("minx", "miny", "maxx", "maxy", 2.5)
    return b.select("id", x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))


def q_time_expand(spark, sf):
    s = fx.sessions(spark, sf)
    a, c = TM.expand_time("start_us", "end_us", HOUR)
    return s.select("id", a.alias("start_us"), c.alias("end_us"))


def q_centroid(spark, sf):
    g = geometry_frame(spark, sf)
    c = G.centroid(G.Side("", True))
    return g.select("id", "kind", _round(c["x"]).alias("cx"), _round(c["y"]).alias("cy"))


def q_centre(spark, sf):
    s = fx.sessions(spark, sf)
    cx, cy = G.centre_xy(G.Side())
    return s.select("id", TM.centre_t("start_us", "end_us").alias("centre_t"),
                    cx.alias("centre_x"), cy.alias("centre_y"))


def q_distance(spark, sf):
    g = geometry_frame(spark, sf)
    p = g.withColumn("p_minx", F.col("y")).withColumn("p_maxx", F.col("y")) \
        .withColumn("p_miny", F.col("x")).withColumn("p_maxy", F.col("x"))
    d = G.geometry_distance(G.Side("", True), G.Side("p_", False))
    return p.select("id", "kind", _round(d).alias("dist"))


def q_envelope_distance(spark, sf):
    j = _box_pairs(spark, sf)
    return j.select("l_id", "r_id", G.envelope_distance(G.Side("l_"), G.Side("r_")).alias("env_dist"))


def q_envelope_intersection(spark, sf):
    j = _box_pairs(spark, sf)
    box = G.envelope_intersection(G.Side("l_"), G.Side("r_"))
    return j.select("l_id", "r_id", box["minx"].alias("ix_minx"), box["miny"].alias("ix_miny"),
                    box["maxx"].alias("ix_maxx"), box["maxy"].alias("ix_maxy"))


def q_time_reference_point(spark, sf):
    j = _box_pairs(spark, sf)
    a, c = TM.expand_time("l_start_us", "l_end_us", HOUR)
    return j.select("l_id", "r_id", TM.time_reference_point(a, c, "r_start_us", "r_end_us").alias("t_ref"))


def q_global_stats(spark, sf):
    s = ST.global_stats(fx.box_right(spark, sf))
    return s.select("minx", "miny", "maxx", "maxy", "n", "start_us", "end_us", "avg_len",
                    _round(F.col("avg_extent")).alias("avg_extent"))


def q_cell_envelope(spark, sf):
    pts = fx.all_points(spark, sf)
    grid = TL.grid_for(pts)
    cells = pts.select(F.lit(3).alias("level"), grid.cx(F.col("minx"), 3).alias("cx"),
                       grid.cy(F.col("miny"), 3).alias("cy")).distinct()
    return TL.cell_envelope(cells, grid)


def q_quadrant_envelope(spark, sf):
    pts = fx.all_points(spark, sf)
    grid = TL.grid_for(pts)
    cells = pts.select(F.lit(3).alias("level"), grid.cx(F.col("minx"), 3).alias("cx"),
                       grid.cy(F.col("miny"), 3).alias("cy")).distinct()
    return TL.quadrant_envelopes(cells, grid)


def q_period_cell_assign(spark, sf):
    s = fx.sessions(spark, sf)
    return TL.period_cell_assign(s, _periods(spark, sf), TL.grid_for(s), 2)


def q_st_knn_join(spark, sf):
    return _knn(spark, sf).select("l_id", "r_id", "dist", "rank")


def q_st_knn_join_nested(spark, sf):
    left = fx.pts_left(spark, sf)
    res = KN.st_knn_join(left, fx.pts_right(spark, sf), K, DELTA, nested=True)
    return res.select("l_id", "l_minx", F.size("neighbours").alias("n_neighbours"),
                      F.explode("neighbours").alias("nb")) \
        .select("l_id", "l_minx", "n_neighbours", F.col("nb.rank").alias("rank"),
                F.col("nb.id").alias("r_id"), F.col("nb.dist").alias("dist"))


def q_with_row_id(spark, sf):
    """How many rows share each row's id: one."""
    rows = with_row_id(_ev(spark, sf).select("event_id", "event_type"), "row_id")
    return rows.select("event_id", "event_type", F.count("*").over(Window.partitionBy("row_id")).alias("n_same_id"))


def q_interval_overlap_filter(spark, sf):
    return FL.interval_overlap_filter(fx.sessions(spark, sf), WIN_START, WIN_END) \
        .select("id", "start_us", "end_us")


def q_envelope_intersects(spark, sf):
    return FL.envelope_intersects_filter(fx.box_right(spark, sf), QUERY_BOX).select("id")


def q_bound_contains_point(spark, sf):
    return FL.bound_contains_point_filter(fx.all_points(spark, sf), QUERY_BOX).select("id")


def q_bound_contains_time(spark, sf):
    return FL.bound_contains_time_filter(fx.all_points(spark, sf), WIN_START, WIN_END).select("id")


def q_bound_contains_range(spark, sf):
    return FL.bound_contains_range_filter(fx.sessions(spark, sf), WIN_START, WIN_END2).select("id")


def q_bound_contains_envelope(spark, sf):
    return FL.bound_contains_envelope_filter(fx.box_right(spark, sf), OUTER_BOX).select("id")


def q_right_prefilter(spark, sf):
    """S = orders as ship intervals, R = orders placed in 1995 as instants."""
    orders = fx.table(spark, sf, "orders")
    r95 = orders.where(F.year("o_orderdate") == 1995)
    left = point_frame(r95, "o_orderkey", "o_totalprice", F.lit(0.0), "o_orderdate")
    return FL.right_prefilter(fx.long_intervals(spark, sf), left, DELTA).select("id", "start_us", "end_us")


def q_replicated_join_dedup(spark, sf):
    pairs = KN.st_distance_join(fx.box_left(spark, sf), fx.box_right(spark, sf), 5.0, HOUR)
    return pairs.select("l_id", "r_id", "dist")


def q_st_distance_join(spark, sf):
    pairs = KN.st_distance_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), 3.0, 6 * HOUR)
    return pairs.select("l_id", "r_id", "dist")


def q_validate_rows(spark, sf):
    return FL.validate_rows(fx.bad_rows(spark, sf), "flag") \
        .select("id", "l_linenumber", "start_us", "end_us", "problem")


def q_knn_bound(spark, sf):
    """Which R rows are bounded, and whether each bound is >= the exact k-th
    candidate distance, taken from the time join alone (no bound of the plan, no cells of its pyramid).  Rows
    near in time and place give each R row's reach, and the time join's pairs within it are ranked."""
    left, right = stored(fx.pts_left(spark, sf), "left"), stored(fx.pts_right(spark, sf), "right")
    plan, right_f = KN.plan_for(left, right, K, DELTA)
    bounds = KN.knn_bound(left, right_f, plan)
    reaching = stored(J.with_reach(left, right, K, DELTA), "reach")
    pairs = J.interval_overlap_join(reaching, right, DELTA, within="reach").select(
        "l_id", "r_id", "l_reach", G.envelope_distance(G.Side("l_"), G.Side("r_")).alias("dist"))
    pairs = pairs.where(F.col("l_reach").isNull() | (F.col("dist") <= F.col("l_reach"))).drop("l_reach")
    kth = KN.kth_distance(KN.top_k(pairs, K), K)
    j = kth.join(bounds.withColumnRenamed("id", "l_id"), "l_id", "left")
    ok = F.col("bound").isNull() | (F.col("bound") >= F.col("kth_dist"))
    return j.select("l_id", F.col("bound").isNotNull().alias("bounded"), F.coalesce(ok, F.lit(False)).alias("bound_ok"))


def q_st_knn_query(spark, sf):
    left = fx.pts_left(spark, sf)
    q = left.orderBy("id").select("minx", "miny", "start_us").first()
    top = KN.st_knn_query(fx.pts_right(spark, sf), q["minx"], q["miny"], q["start_us"], q["start_us"],
                          10, 12 * HOUR)
    w = Window.orderBy("dist", "r_id")  # over the k rows of the result
    return top.select(F.col("id").alias("r_id"), "dist").withColumn("rank", F.row_number().over(w))


def q_layout_knn_query(spark, sf):
    """The same query over the views stored by day and cell: only near partitions are read."""
    q = fx.pts_left(spark, sf).orderBy("id").select("minx", "miny", "start_us").first()
    path = write_layout(fx.pts_right(spark, sf), shared_dir(spark, "layout"), DAY, 25.0)
    top = layout_knn_query(spark, path, q["minx"], q["miny"], q["start_us"], q["start_us"], 10, 12 * HOUR).result
    w = Window.orderBy("dist", "r_id")  # over the k rows of the result
    return top.select(F.col("id").alias("r_id"), "dist").withColumn("rank", F.row_number().over(w))


def q_interval_overlap_join(spark, sf):
    pairs = J.interval_overlap_join(fx.pts_left(spark, sf), fx.sessions(spark, sf), 0)
    return pairs.select("l_id", "r_id")


def q_cell_equi_join(spark, sf):
    pts = fx.all_points(spark, sf)
    grid = TL.grid_for(pts)
    out = J.cell_summary_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), grid, 4, DAY)
    return out.select("id", "cx", "cy", "tb", "n_right")


def q_cell_assign(spark, sf):
    b = fx.box_right(spark, sf)
    return TL.cell_assign(b, TL.grid_for(b), 3, DAY)


def q_cell_assign_within(spark, sf):
    grid = TL.grid_for(fx.all_points(spark, sf))
    return TL.cell_assign_within(fx.pts_left(spark, sf), grid, 4, DAY, 10.0, 12 * HOUR)


def q_interval_bins(spark, sf):
    s = fx.sessions(spark, sf)
    spec = B.bin_spec(s, N_BINS)
    return B.interval_bins(s, spec)


def q_grouped_interval_bins(spark, sf):
    return B.grouped_interval_bins(fx.sessions(spark, sf), ["user_id"], 8)


def q_overlap_count_bound(spark, sf):
    s = fx.sessions(spark, sf)
    spec = B.bin_spec(s, N_BINS)
    bins = B.interval_bins(s, spec)
    return B.overlap_count_bound(fx.pts_left(spark, sf), bins, spec, HOUR, TILE_K)


def _depth(spark, sf):
    s = fx.sessions(spark, sf)
    cuts = B.equi_depth_cuts(s, ["user_id"], DEPTH_BINS)
    return cuts, B.equi_depth_bins(s, cuts, ["user_id"], DEPTH_BINS)


def q_equi_depth_bins(spark, sf):
    return _depth(spark, sf)[1]


def q_equi_depth_bound(spark, sf):
    cuts, bins = _depth(spark, sf)
    return B.equi_depth_bound(fx.pts_left(spark, sf), bins, cuts, 10 * DAY, TILE_K, ["user_id"])


def q_st_knn_count(spark, sf):
    res = KN.st_knn_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), K, DELTA, nested=True)
    return res.agg(F.count(F.lit(1)).alias("n"))


def _periods(spark, sf):
    return TL.time_periods(fx.sessions(spark, sf), ALPHA, BETA, TILE_K, HOUR)


def q_time_periods(spark, sf):
    return _periods(spark, sf)


def q_period_density(spark, sf):
    return TL.period_density(fx.sessions(spark, sf), _periods(spark, sf))


def q_periods_for_range(spark, sf):
    return TL.periods_for_range(fx.sessions(spark, sf), _periods(spark, sf))


def q_periods_many(spark, sf):
    """Events met by each period of 20 seconds over the table's time range (some 130 000 periods a
    month); an event lasts 45 seconds."""
    pts = fx.all_points(spark, sf)
    span = pts.agg(F.min("start_us").alias("lo"), F.max("start_us").alias("hi"))
    periods = span.select("lo", F.posexplode(F.sequence(F.col("lo"), F.col("hi"), F.lit(20_000_000)))).select(
        F.col("pos").alias("period"), F.col("col").alias("p_start"), (F.col("col") + 20_000_000).alias("p_end"))
    return TL.periods_for_range(pts.withColumn("end_us", F.col("start_us") + 45_000_000), periods)


def _shapes(spark, sf, event_type):
    return geometry_frame(spark, sf, event_type).drop("x", "y")


def q_area_distance_join(spark, sf):
    """Polygons with a hole against multipolygons, through the join of segments."""
    res = KN.st_distance_join(_shapes(spark, sf, "click"), _shapes(spark, sf, "error"), 6.0, 2 * HOUR, segment_pairs=0)
    return res.select("l_id", "r_id", _round(F.col("dist")).alias("dist"))


def q_trajectory_distance(spark, sf):
    """Each user's line of purchases against the line of views, in time order."""
    p, v = fx.user_lines(spark, sf, fx.LEFT_EVENT), fx.user_lines(spark, sf, fx.RIGHT_EVENT)
    lp, rp = prefixed(p, "l_"), prefixed(v, "r_")
    pairs = lp.join(rp, F.col("l_id") == F.col("r_id"))
    found = SG.exact_distances(pairs, G.Side("l_", True), G.Side("r_", True))
    return found.select(F.col("l_id").alias("user_id"), _round(F.col("dist")).alias("dist"))


def q_group_envelope(spark, sf):
    pts = fx.all_points(spark, sf)
    grid = TL.grid_for(pts)
    keyed = pts.withColumn("cx", grid.cx(F.col("minx"), 2)).withColumn("cy", grid.cy(F.col("miny"), 2))
    return ST.group_envelope(keyed, "cx", "cy")


def q_kth_distance(spark, sf):
    return KN.kth_distance(_knn(spark, sf), K)


def q_sample_bounds(spark, sf):
    return TL.sample_bounds(fx.sessions(spark, sf), ALPHA, BETA, seed=7)


def _tiles(spark, sf):
    pts = fx.all_points(spark, sf)
    grid = TL.grid_for(pts)
    return pts, grid, TL.quad_tiles(pts, grid, QUAD_BETA, TILE_K, QUAD_LEVEL)


def q_quad_tiles(spark, sf):
    return _tiles(spark, sf)[2]


def q_cell_numbering(spark, sf):
    return TL.cell_numbering(_tiles(spark, sf)[2]).select("tile", "level", "cx", "cy")


def q_tile_lookup(spark, sf):
    pts, grid, tiles = _tiles(spark, sf)
    numbered = TL.cell_numbering(tiles)
    return J.assign_to_tiles(pts.select("id", "minx", "miny", "maxx", "maxy"), numbered, grid, QUAD_LEVEL) \
        .select("id", "tile", "level")


def q_home_cell(spark, sf):
    left, right = fx.pts_left(spark, sf), fx.pts_right(spark, sf)
    plan, right_f = KN.plan_for(left, right, K, DELTA, max_level=6)
    return KN.home_cell(left, right_f, plan)


def q_st_knn_join_filtered(spark, sf):
    pts = fx.pts_right(spark, sf)
    res = KN.st_knn_join(pts, pts, K, DELTA, pair_filter=F.col("l_id") != F.col("r_id"), pair_filter_slack=1)
    return res.select("l_id", "r_id", "dist", "rank")


def q_st_knn_join_widening(spark, sf):
    """A predicate over payload columns that rejects six of seven candidates, no slack given."""
    same = F.pmod("l_user_id", F.lit(7)) == F.pmod("r_user_id", F.lit(7))
    res = KN.st_knn_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), K, DELTA, pair_filter=same)
    return res.select("l_id", "r_id", "dist", "rank")


def _shifted_right(spark, sf, x, y, t):
    """Views with other coordinates and instants."""
    pts = fx.pts_right(spark, sf)
    moved = pts.select("id", x.alias("minx"), y.alias("miny"), t.alias("start_us"))
    return moved.select("id", "minx", "miny", F.col("minx").alias("maxx"), F.col("miny").alias("maxy"),
                        "start_us", F.col("start_us").alias("end_us"))


def _self_knn(pts):
    res = KN.st_knn_join(pts, pts, K, DELTA, pair_filter=F.col("l_id") != F.col("r_id"), pair_filter_slack=1)
    return res.select("l_id", "r_id", "dist", "rank")


def q_st_knn_join_copies(spark, sf):
    """Places and days rounded, so that exact copies abound; self exclusion."""
    return _self_knn(_shifted_right(spark, sf, F.floor(F.col("minx") / 100) * 100.0, F.floor(F.col("miny") / 50) * 50.0,
                                    F.floor(F.col("start_us") / DAY).cast("bigint") * DAY))


def q_st_knn_join_hot(spark, sf):
    """A third of the rows in one tiny spot, a ninth at one location: takes the
    deep levels and the index of heavy locations."""
    spot, place = F.col("id") % 3 == 0, F.col("id") % 9 == 0
    def near(c, at, scale):
        return F.when(place, F.lit(at)).when(spot, F.lit(at) + F.col(c) * F.lit(scale)).otherwise(F.col(c))
    return _self_knn(_shifted_right(spark, sf, near("minx", 100.0, 1e-7), near("miny", 50.0, 1e-7), F.col("start_us")))


def q_validate_wkt(spark, sf):
    """Generated texts, four of six of them spoiled: the problem found."""
    raw = _ev(spark, sf)
    x, y = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    point = F.concat(F.lit("POINT ("), x, F.lit(" "), y, F.lit(")"))
    kind = F.col("event_id") % 6
    text = (F.when(kind == 0, point).when(kind == 1, F.concat(F.lit("POINT (abc "), y, F.lit(")")))
            .when(kind == 2, F.concat(F.lit("SRID=4326;"), point))
            .when(kind == 3, F.concat(F.lit("GEOMETRYCOLLECTION ("), point, F.lit(")")))
            .when(kind == 4, F.lit("POINT EMPTY")).otherwise(F.lit("POINT (1e999 0)")))
    t = TM.epoch_us(raw, "ts")
    rows = with_wkt_geometry(raw.select(F.col("event_id").alias("id"), text.alias("wkt"), t.alias("start_us"),
                                        t.alias("end_us")), "wkt")
    return FL.validate_rows(rows, "flag").select("id", "problem")


def q_load_rejects(spark, sf):
    """Text lines, six of seven spoiled, loaded in one pass: rows per problem as counted while
    writing, and as stored."""
    raw = _ev(spark, sf)
    x, y = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 7
    wkt = (F.when(kind == 1, F.concat(F.lit("POINT (abc "), y, F.lit(")"))).when(kind == 2, F.lit("POLYGON EMPTY"))
           .when(kind == 5, F.lit("POINT (1e999 0)")).otherwise(F.concat(F.lit("POINT ("), x, F.lit(" "), y, F.lit(")"))))
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    start = F.when(kind == 3, F.lit("yesterday")).otherwise(t)
    end = F.when(kind == 4, F.lit("1999-12-31 00:00:00")).when(kind == 6, F.lit(None).cast("string")).otherwise(t)
    lines = raw.select(F.col("event_id").alias("id"), F.concat_ws("\t", wkt, start, end).alias("value"))
    got = load_wkt_tsv(spark, lines, id_col="id")
    counted = spark.createDataFrame([(p, n) for p, n in got.counts.items() if n], "problem string, n_counted bigint")
    stored = got.rejected.select("id", "problem").unionByName(got.rows.select("id", F.lit(VALID).alias("problem"))) \
        .groupBy("problem").agg(F.count(F.lit(1)).alias("n_stored"), F.sum("id").alias("id_sum"))
    return stored.join(counted, "problem", "full").select("problem", "n_counted", "n_stored", "id_sum")


def q_multipolygon(spark, sf):
    """MULTIPOLYGON with a hole and both ring orientations: WKT round trip,
    polygons and rings, centroid, GeoJSON nesting."""
    ev = spread(_ev(spark, sf), "event_id", costly=True)
    cx = F.floor(F.col("value")).cast("int")
    raw = ev.select(F.col("event_id").alias("id"), cx.alias("x"), (F.col("event_id") % 2 == 0).alias("flip"))

    def ring(points, flip=None):
        def text(ps):
            return F.concat(F.lit("("), F.concat_ws(", ", *[
                F.concat((F.col("x") + a).cast("double").cast("string"), F.lit(f" {float(b)}")) for a, b in ps]), F.lit(")"))
        return text(points) if flip is None else F.when(flip, text(points[::-1])).otherwise(text(points))

    shell = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    other = [(10, 0), (12, 0), (12, 2), (10, 2), (10, 0)]
    wkt = F.concat(F.lit("MULTIPOLYGON (("), ring(shell), F.lit(", "), ring(hole, F.col("flip")), F.lit("), ("),
                   ring(other, F.col("flip")), F.lit("))"))
    g = with_wkt_geometry(raw.withColumn("wkt", wkt).withColumn("t", F.col("wkt")), "wkt")
    side = G.Side("", True)
    c = G.centroid(side)
    nested = F.from_json(F.get_json_object(G.geojson_geometry(side), "$.coordinates"), "array<array<array<array<double>>>>")
    return g.select("id", (to_wkt("kind", "pts", "parts", "shells") == F.col("t")).alias("same_text"),
                    F.size("shells").alias("n_polygons"), F.size(F.get(nested, 0)).alias("n_rings_first"),
                    F.size(F.get(nested, 1)).alias("n_rings_second"), _round(c["x"] - F.col("x")).alias("cx"),
                    _round(c["y"]).alias("cy"))


def generated_collections(spark, sf) -> DataFrame:
    """One nested collection per event at (x, y): a point, a line 3 up at x + 1 and a 2 x 2 square at
    x + 4, with Z and M coordinates, EMPTY members and the areas first; ``plain`` is its flat text."""
    raw = spread(_ev(spark, sf), "event_id", costly=True)
    at = raw.select(F.col("event_id").alias("id"), F.col("value").cast("double").alias("x"),
                    F.get_json_object("props", "$.k").cast("double").alias("y"), TM.epoch_us(raw, "ts").alias("t"))

    def coords(points, rest=""):
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", F.col("x") + a, F.col("y") + b, *[F.lit(v) for v in rest.split()])
                                                        for a, b in points]), F.lit(")"))

    line, square = [(1, 0), (1, 3)], [(4, 0), (6, 0), (6, 2), (4, 2), (4, 0)]
    nested = F.concat(F.lit("GEOMETRYCOLLECTION Z (MULTIPOLYGON Z (EMPTY, ("), coords(square, "7"),
                      F.lit(")), GeometryCollection (POINT EMPTY, POINT ZM "), coords([(0, 0)], "7 8"),
                      F.lit(", GEOMETRYCOLLECTION (MULTILINESTRING M (EMPTY, "), coords(line, "9"), F.lit("), LINESTRING EMPTY)))"))
    plain = F.concat(F.lit("GEOMETRYCOLLECTION (POINT "), coords([(0, 0)]), F.lit(", LINESTRING "), coords(line),
                     F.lit(", POLYGON ("), coords(square), F.lit("))"))
    parsed = with_wkt_geometry(at.select("id", "x", "y", "t", nested.alias("wkt"), plain.alias("plain")), "wkt")
    return parsed.withColumn("start_us", F.col("t")).withColumn("end_us", F.col("t")).drop("t")


def q_wkt_collections(spark, sf):
    """Nested collections: members, envelope, centroid, distance to (y, x), GeoJSON and written text."""
    g = generated_collections(spark, sf)
    side = G.Side("", True)
    p = g.withColumn("p_minx", F.col("y")).withColumn("p_maxx", F.col("y")) \
        .withColumn("p_miny", F.col("x")).withColumn("p_maxy", F.col("x"))
    c, json = G.centroid(side), G.geojson_geometry(side)
    types = [F.get_json_object(json, f"$.geometries[{i}].type") for i in range(3)]
    return p.select("id", "kind", F.size("pts").alias("n_pts"), F.size("parts").alias("n_parts"), F.size("shells").alias("n_shells"),
                    "minx", "miny", "maxx", "maxy", _round(c["x"]).alias("cx"), _round(c["y"]).alias("cy"),
                    _round(G.geometry_distance(side, G.Side("p_"))).alias("dist"), F.concat_ws(",", *types).alias("members"),
                    (to_wkt("kind", "pts", "parts", "shells") == F.col("plain")).alias("same_text"))


def q_collection_knn_join(spark, sf):
    g = generated_collections(spark, sf).drop("x", "y", "plain")
    res = KN.st_knn_join(fx.pts_left(spark, sf), g, K, DELTA, checkpoint_inputs=True)
    return res.select("l_id", "r_id", _round(F.col("dist")).alias("dist"), "rank")


def q_box_knn_join(spark, sf):
    res = KN.st_knn_join(fx.box_left(spark, sf), fx.box_right(spark, sf), K, DELTA)
    return res.select("l_id", "r_id", "dist", "rank")


def q_box_knn_join_overlapping(spark, sf):
    """Boxes of whole user months: every purchase lies inside many of them."""
    return KN.st_knn_join(fx.pts_left(spark, sf), fx.wide_boxes(spark, sf), K, DELTA).select("l_id", "r_id", "dist", "rank")


def q_session_knn_join(spark, sf):
    """S intervals (user-day sessions, hours long) much longer than delta."""
    res = KN.st_knn_join(fx.pts_left(spark, sf), fx.sessions(spark, sf), K, HOUR)
    return res.select("l_id", "r_id", "dist", "rank")


def q_vec_knn_join(spark, sf):
    v = fx.vec_pts(spark, sf)
    res = KN.st_knn_join(v, v, K, 0, pair_filter=F.col("l_id") != F.col("r_id"), pair_filter_slack=1)
    return res.select("l_id", "r_id", "dist", "rank")


def q_geom_knn_join(spark, sf):
    g = geometry_frame(spark, sf).drop("x", "y")
    res = KN.st_knn_join(fx.pts_left(spark, sf), g, K, DELTA, checkpoint_inputs=True)
    return res.select("l_id", "r_id", "r_kind", _round(F.col("dist")).alias("dist"), "rank")


def q_result_roundtrip(spark, sf):
    res = KN.st_knn_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), K, DELTA, nested=True)
    back = RS.store_and_reload(res)
    return back.select("l_id", F.explode("neighbours").alias("nb")) \
        .select("l_id", F.col("nb.rank").alias("rank"), F.col("nb.id").alias("r_id"),
                F.col("nb.dist").alias("dist"))


def q_load_join_store(spark, sf):
    """The whole job over files of the session's shared folder: text files of
    both sides are written, loaded, joined, stored and read again."""
    base = shared_dir(spark, "wkt-tsv")
    for name, kind in (("left", fx.LEFT_EVENT), ("right", fx.RIGHT_EVENT)):
        fx.wkt_lines(spark, sf, kind).select("value").write.text(f"{base}/{name}")
    left, right = read_wkt_tsv(spark, f"{base}/left"), read_wkt_tsv(spark, f"{base}/right")
    back = RS.store_and_reload(KN.st_knn_join(left, right, K, DELTA, nested=True, checkpoint_inputs=True))
    return back.select("l_minx", "l_miny", "l_start_us", F.explode("neighbours").alias("nb")).select(
        F.col("l_minx").alias("x"), F.col("l_miny").alias("y"), F.col("l_start_us").alias("start_us"),
        F.col("nb.rank").alias("rank"), F.col("nb.dist").alias("dist"))


def q_geojson_export(spark, sf):
    res = KN.st_knn_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), K, DELTA, nested=True)
    return RS.geojson_collections(res)


def q_sample_results(spark, sf):
    res = KN.st_knn_join(fx.pts_left(spark, sf), fx.pts_right(spark, sf), K, DELTA, nested=True)
    return RS.sample_results(res, 10, seed=7).select("l_id", F.size("neighbours").alias("n_neighbours"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_time": q_parse_time,
    "load_wkt_tsv": q_load_wkt_tsv,
    "parse_wkt": q_parse_wkt,
    "envelope": q_envelope,
    "envelope_expand": q_envelope_expand,
    "time_expand": q_time_expand,
    "centroid": q_centroid,
    "centre": q_centre,
    "distance": q_distance,
    "envelope_distance": q_envelope_distance,
    "envelope_intersection": q_envelope_intersection,
    "time_reference_point": q_time_reference_point,
    "global_stats": q_global_stats,
    "cell_envelope": q_cell_envelope,
    "quadrant_envelope": q_quadrant_envelope,
    "st_knn_join": q_st_knn_join,
    "st_knn_join_nested": q_st_knn_join_nested,
    "with_row_id": q_with_row_id,
    "interval_overlap_filter": q_interval_overlap_filter,
    "envelope_intersects": q_envelope_intersects,
    "bound_contains_point": q_bound_contains_point,
    "bound_contains_time": q_bound_contains_time,
    "bound_contains_range": q_bound_contains_range,
    "bound_contains_envelope": q_bound_contains_envelope,
    "right_prefilter": q_right_prefilter,
    "replicated_join_dedup": q_replicated_join_dedup,
    "st_distance_join": q_st_distance_join,
    "validate_rows": q_validate_rows,
    "knn_bound": q_knn_bound,
    "st_knn_query": q_st_knn_query,
    "layout_knn_query": q_layout_knn_query,
    "load_rejects": q_load_rejects,
    "equi_depth_bins": q_equi_depth_bins,
    "equi_depth_bound": q_equi_depth_bound,
    "interval_overlap_join": q_interval_overlap_join,
    "cell_equi_join": q_cell_equi_join,
    "cell_assign": q_cell_assign,
    "cell_assign_within": q_cell_assign_within,
    "tile_lookup": q_tile_lookup,
    "interval_bins": q_interval_bins,
    "grouped_interval_bins": q_grouped_interval_bins,
    "overlap_count_bound": q_overlap_count_bound,
    "st_knn_count": q_st_knn_count,
    "time_periods": q_time_periods,
    "period_density": q_period_density,
    "periods_for_range": q_periods_for_range,
    "periods_many": q_periods_many,
    "area_distance_join": q_area_distance_join,
    "trajectory_distance": q_trajectory_distance,
    "period_cell_assign": q_period_cell_assign,
    "group_envelope": q_group_envelope,
    "kth_distance": q_kth_distance,
    "sample_bounds": q_sample_bounds,
    "quad_tiles": q_quad_tiles,
    "cell_numbering": q_cell_numbering,
    "home_cell": q_home_cell,
    "st_knn_join_filtered": q_st_knn_join_filtered,
    "st_knn_join_widening": q_st_knn_join_widening,
    "st_knn_join_copies": q_st_knn_join_copies,
    "st_knn_join_hot": q_st_knn_join_hot,
    "validate_wkt": q_validate_wkt,
    "multipolygon": q_multipolygon,
    "wkt_collections": q_wkt_collections,
    "collection_knn_join": q_collection_knn_join,
    "box_knn_join": q_box_knn_join,
    "box_knn_join_overlapping": q_box_knn_join_overlapping,
    "session_knn_join": q_session_knn_join,
    "vec_knn_join": q_vec_knn_join,
    "geom_knn_join": q_geom_knn_join,
    "result_roundtrip": q_result_roundtrip,
    "load_join_store": q_load_join_store,
    "geojson_export": q_geojson_export,
    "sample_results": q_sample_results,
}
