"""P8 for large geometries: distances of pairs by a join of segments over a grid.

The column expression ``geometry_distance`` compares every segment of one geometry
with every one of the other, which is the right thing for a few vertices.  For pairs of
more than ``SEGMENT_PAIRS`` segment pairs this module compares near segments only:

1. **Upper bound** per pair, in one pass over the vertices of each side: from the
   left's first vertex to the nearest right vertex, from there to the nearest left one.
2. **Grid** per pair, with cells as wide as the bound or the mean segment, whichever is more.
   Long segments are cut into pieces no longer than a cell, so the pieces number at most twice
   the segments.  Left pieces stand in the cells they meet when widened by the
   bound, right pieces in the cells they meet: the nearest two segments share a cell.
3. An equi-join on (pair, cell) compares whole segments; their minimum is the distance
   unless one geometry lies inside the other.
4. **Containment** by ray counts: the first vertex of every part against the other side's
   rings, joined on horizontal strips, so only segments at its height are met.

Pairs of at most ``SEGMENT_PAIRS`` segment pairs that come here skip 1 and 2: all their segments meet (``_crossed``).

All rows are segments, pieces or vertices; a pair of very large geometries is spread over
tasks by cell and strip.

Points against geometries (``point_distances``) need no grid: one row per pair and edge, and two hash
aggregates where the pairs already are.  Rows of plain numbers compile to a loop, while the column
expression walks the arrays of every pair through lambdas, which Spark interprets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..model import GEOM_COLUMNS, side, with_segments
from ..session import stored

#: pairs with at most so many segment pairs keep the column expression
SEGMENT_PAIRS = 4096
WIDER = 1 + 1e-9
PAIR = ["l_id", "r_id"]
ENDS = ["ax", "ay", "bx", "by"]


def _nearest_vertex(pts: Column, x: Column, y: Column) -> Column:
    """``struct(d, x, y)`` of the vertex nearest to (x, y)."""
    return F.array_min(F.transform(pts, lambda p: F.struct(
        G.point_distance(p["x"], p["y"], x, y).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))


def _length(segs: Column) -> Column:
    return F.aggregate(segs, F.lit(0.0), lambda a, s: a + G.point_distance(s["ax"], s["ay"], s["bx"], s["by"]))


def _rise(segs: Column) -> Column:
    return F.aggregate(segs, F.lit(0.0), lambda a, s: a + F.abs(s["by"] - s["ay"]))


def _shapes(pairs: DataFrame, left: G.Side, right: G.Side) -> DataFrame:
    return pairs.select(*PAIR, left.kind.alias("l_kind"), right.kind.alias("r_kind"), left.pts.alias("l_pts"),
                        right.pts.alias("r_pts"), left.parts.alias("l_parts"), right.parts.alias("r_parts"),
                        left.shells.alias("l_shells"), right.shells.alias("r_shells"),
                        left.segs.alias("l_segs"), right.segs.alias("r_segs"))


def bounded_pairs(pairs: DataFrame, left: G.Side, right: G.Side) -> DataFrame:
    """One row per pair: kinds, parts, segments, an upper bound ``_ub`` and the cell width ``_w``."""
    shape = _shapes(pairs, left, right)
    first = F.get("l_pts", 0)
    near = shape.withColumn("_r", _nearest_vertex(F.col("r_pts"), first["x"], first["y"]))
    near = near.withColumn("_ub", _nearest_vertex(F.col("l_pts"), F.col("_r.x"), F.col("_r.y"))["d"] * WIDER)
    mean = F.greatest(_length(F.col("l_segs")) / F.size("l_segs"), _length(F.col("r_segs")) / F.size("r_segs"))
    # points alone, all in one place: any width does
    width = F.greatest("_ub", mean)
    return near.drop("_r").withColumn("_w", F.when(width > 0, width).otherwise(F.lit(1.0)))


def _cells(shape: DataFrame, p: str, reach: Column) -> DataFrame:
    """(pair, cx, cy, segment): the cells that the pieces of each segment meet, widened by ``reach``."""
    segs = shape.select(*PAIR, "_w", reach.alias("_reach"), F.inline(f"{p}segs"))
    s, w = {c: F.col(c) for c in ENDS}, F.col("_w")
    pieces = F.greatest(F.ceil(G.point_distance(s["ax"], s["ay"], s["bx"], s["by"]) / w), F.lit(1))
    cut = segs.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def along(a, b, i):
        return a + (b - a) * (i / F.col("_n"))

    def cells(a, b):
        u, v = along(a, b, F.col("_i")), along(a, b, F.col("_i") + 1)
        margin = F.col("_reach") + (F.abs(u) + F.abs(v)) * 1e-12
        return F.sequence(F.floor((F.least(u, v) - margin) / w), F.floor((F.greatest(u, v) + margin) / w))

    return cut.withColumn("_cx", F.explode(cells(s["ax"], s["bx"]))).withColumn("_cy", F.explode(cells(s["ay"], s["by"]))) \
        .select(*PAIR, "_cx", "_cy", *[F.col(c).alias(p + c) for c in ENDS])


def segment_distance(s, t) -> Column:
    """Distance of two segments, given as structs or dicts of ax, ay, bx, by."""
    ends = F.least(G.point_segment_distance(s["ax"], s["ay"], t), G.point_segment_distance(s["bx"], s["by"], t),
                   G.point_segment_distance(t["ax"], t["ay"], s), G.point_segment_distance(t["bx"], t["by"], s))
    return F.when(G.segments_cross(s, t), F.lit(0.0)).otherwise(ends)


def near_segments(shape: DataFrame) -> DataFrame:
    """(pair, ends of a left and a right segment) that share a cell; a pair of segments may repeat."""
    return _cells(shape, "l_", F.col("_ub")).join(_cells(shape, "r_", F.lit(0.0)), [*PAIR, "_cx", "_cy"]).drop("_cx", "_cy")


def _hit() -> Column:
    """Whether the ray from (x, y) meets the edge ax .. by."""
    s, y = {c: F.col(c) for c in ENDS}, F.col("y")
    return ((s["ay"] > y) != (s["by"] > y)) & (F.col("x") < (s["bx"] - s["ax"]) * (y - s["ay"]) / (s["by"] - s["ay"]) + s["ax"])


def _inside(shape: DataFrame, inner: str, outer: str) -> DataFrame:
    """Pairs of which some part of ``inner`` starts inside the areas of ``outer`` (even-odd,
    for each polygon of a collection)."""
    area = G.Side(outer, True, has_segs=True)
    areas = shape.where(G.has_area(area))
    segs = F.col(f"{outer}segs")
    low = F.array_min(F.transform(segs, lambda s: F.least(s["ay"], s["by"])))
    high = F.array_max(F.transform(segs, lambda s: F.greatest(s["ay"], s["by"])))
    # strips of such height that the segments stand in at most two on average
    height = F.greatest(high - low, _rise(segs)) / F.size(segs)
    areas = areas.withColumn("_low", low).withColumn("_h", F.when(height > 0, height).otherwise(F.lit(1.0)))

    def strip(y):
        return F.floor((y - F.col("_low")) / F.col("_h"))

    starts = areas.select(*PAIR, "_low", "_h", F.inline(F.transform(f"{inner}parts", lambda i: F.struct(
        i.alias("part"), F.get(f"{inner}pts", i)["x"].alias("x"), F.get(f"{inner}pts", i)["y"].alias("y"))))) \
        .select(*PAIR, "part", "x", "y", strip(F.col("y")).alias("_strip"))
    polygons = areas.select(*PAIR, "_low", "_h", F.posexplode(G.area_segments(area)).alias("_poly", "_rings"))
    rings = polygons.select(*PAIR, "_low", "_h", "_poly", F.inline("_rings")).select(*PAIR, "_poly", *ENDS, F.explode(F.sequence(
        strip(F.least("ay", "by")), strip(F.greatest("ay", "by")))).alias("_strip"))
    return starts.join(rings, [*PAIR, "_strip"]).where(_hit()).groupBy(*PAIR, "part", "_poly").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") % 2 == 1).select(*PAIR)


def _crossed(shape: DataFrame) -> DataFrame:
    """(l_id, r_id, dist) candidates of pairs of few segments: every segment meets every one of the other geometry, and
    every part's first vertex every edge of its areas, where the pair is.  One row per meeting, so plain numbers in a
    compiled loop; grid and strips would shuffle several rows per segment."""
    s, t = ({c: F.col(p + c) for c in ENDS} for p in ("l_", "r_"))

    def ends(p, name):
        return F.inline(F.transform(name, lambda e: F.struct(*[e[c].alias(p + c) for c in ENDS])))

    near = shape.select(*PAIR, "r_segs", ends("l_", "l_segs")).select(*PAIR, *[f"l_{c}" for c in ENDS], ends("r_", "r_segs")) \
        .groupBy(*PAIR).agg(F.min(segment_distance(s, t)).alias("dist"))

    def inside(inner, outer):
        area = G.Side(outer, True, has_segs=True)
        areas = shape.where(G.has_area(area))
        starts = F.inline(F.transform(f"{inner}parts", lambda i: F.struct(
            i.alias("part"), F.get(f"{inner}pts", i)["x"].alias("x"), F.get(f"{inner}pts", i)["y"].alias("y"))))
        rows = areas.select(*PAIR, F.posexplode(G.area_segments(area)).alias("_poly", "_rings"), f"{inner}parts", f"{inner}pts") \
            .select(*PAIR, "_poly", "_rings", starts).select(*PAIR, "_poly", "part", "x", "y", F.inline("_rings"))
        return rows.groupBy(*PAIR, "part", "_poly").agg(F.sum(_hit().cast("int")).alias("n")) \
            .where(F.col("n") % 2 == 1).select(*PAIR, F.lit(0.0).alias("dist"))

    return near.unionByName(inside("l_", "r_")).unionByName(inside("r_", "l_"))


def exact_distances(pairs: DataFrame, left: G.Side, right: G.Side, most: int | None = None) -> DataFrame:
    """(l_id, r_id, dist) of every pair (unique by ids) with ``l_*`` and ``r_*`` geometry.  ``most``: the largest
    number of segment pairs any pair can have, if known."""
    few = F.size("l_segs") * F.size("r_segs") <= SEGMENT_PAIRS
    found = _crossed(_shapes(pairs, left, right).where(few))
    if most is None or most > SEGMENT_PAIRS:
        shape = stored(bounded_pairs(pairs, left, right).where(~few), "pairs")
        s, t = ({c: F.col(p + c) for c in ENDS} for p in ("l_", "r_"))
        near = near_segments(shape).select(*PAIR, segment_distance(s, t).alias("dist"))
        inside = _inside(shape, "l_", "r_").unionByName(_inside(shape, "r_", "l_")).withColumn("dist", F.lit(0.0))
        found = found.unionByName(near).unionByName(inside)
    return found.groupBy(*PAIR).agg(F.min("dist").alias("dist"))


def with_edges(df: DataFrame) -> DataFrame:
    """(r_id, r_edges) of a geometry frame: its segments as ``array<struct<poly, ax, ay, bx, by>>``.  ``poly``
    numbers the rings that one even-odd rule decides (all of a plain kind, each polygon of a collection);
    points and lines have -1."""
    whole = with_segments(df)
    a = side(whole)
    plain = F.coalesce(F.get(a.parts, F.get(a.shells, 0)), F.size(a.pts))   # a collection's points and lines
    loose = F.when(~G.has_area(a), a.segs).when(a.kind == G.COLLECTION, F.slice(a.segs, F.lit(1), plain)) \
        .otherwise(F.slice(a.segs, 1, 0))

    def numbered(segs, poly):
        return F.transform(segs, lambda s: F.struct(poly.alias("poly"), *[s[c].alias(c) for c in ENDS]))

    areas = F.flatten(F.transform(G.area_segments(a), numbered))
    edges = F.when(G.has_area(a), F.concat(numbered(loose, F.lit(-1)), areas)).otherwise(numbered(loose, F.lit(-1)))
    return whole.select(F.col("id").alias("r_id"), edges.alias("r_edges"))


def point_distances(pairs: DataFrame, edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(l_id, r_id, *keep, dist) of the pairs (unique by ids) of a point ``l_minx, l_miny`` and a geometry of
    ``with_edges``, equal to ``geometry_distance``."""
    x, y, s = F.col("l_minx"), F.col("l_miny"), {c: F.col(c) for c in ENDS}
    rows = pairs.select(*PAIR, x, y, *keep).join(edges.hint("merge"), "r_id") \
        .select(*PAIR, x, y, *keep, F.inline("r_edges"))
    near = F.least(G.point_segment_distance(x, y, s), G.point_distance(x, y, s["ax"], s["ay"]))
    hit = ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / (s["by"] - s["ay"]) + s["ax"])
    # the join has brought all edges of a pair together: neither aggregate shuffles
    rings = rows.groupBy(*PAIR, *keep, "poly").agg(F.min(near).alias("_d"), F.sum(hit.cast("int")).alias("_hits"))
    inside = (F.col("poly") >= 0) & (F.col("_hits") % 2 == 1)
    return rings.groupBy(*PAIR, *keep).agg(F.min("_d").alias("_d"), F.max(inside).alias("_in")) \
        .select(*PAIR, *keep, F.when(F.col("_in"), F.lit(0.0)).otherwise(F.col("_d")).alias("dist"))


def most_segments(df: DataFrame) -> int:
    """Segments of the largest geometry of a frame (one row to the driver)."""
    row = df.agg(F.max(F.size("pts")).alias("n")).first()
    return row["n"] or 0


def with_distance(pairs: DataFrame, left: G.Side, right: G.Side, most: int, limit: int = SEGMENT_PAIRS) -> DataFrame:
    """``pairs`` (unique by l_id, r_id) with ``dist``.  ``most``: the largest number of segment
    pairs any pair can have; up to ``limit`` the column expression does for all."""
    if most <= limit:
        return pairs.withColumn("dist", G.geometry_distance(left, right))
    pairs = stored(pairs, "large-pairs")
    large = F.size(left.segs) * F.size(right.segs) > limit
    small = pairs.where(~large).withColumn("dist", G.geometry_distance(left, right))
    found = exact_distances(pairs.where(large), left, right, most)
    return small.unionByName(pairs.where(large).join(found, PAIR).select(*small.columns))


def largest_pair(left: DataFrame, right: DataFrame) -> int:
    """Upper bound of the segment pairs of any pair of rows; 0 where one side has only boxes."""
    if not all(set(GEOM_COLUMNS) <= set(f.columns) for f in (left, right)):
        return 0
    return most_segments(left) * most_segments(right)
