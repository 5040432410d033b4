"""Planar geometry column expressions.

Data model (see ``tandem.model``): every spatial row carries its envelope as
four doubles ``minx, miny, maxx, maxy``.  A frame *without* geometry columns
is a box frame: the geometry is the envelope itself, a point when it is
degenerate.  A frame *with* geometry has ``kind`` (upper-case WKT type),
``pts`` (``array<struct<x,y>>`` of all vertices in order) and ``parts``
(``array<int>``: start offset of each ring / line / point) and ``shells``
(``array<int>``: index in ``parts`` of the ring that starts each polygon; the
rings up to the next one are its holes, whatever their orientation).

Everything is written with built-in functions and higher-order functions
(``transform``, ``aggregate``, ``exists``) so Catalyst compiles it; no Python
runs per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

AREA_KINDS = ("POLYGON", "MULTIPOLYGON")
POINT_KINDS = ("POINT", "MULTIPOINT")
#: parts before the first shell are points (one vertex) and lines, the others rings
COLLECTION = "GEOMETRYCOLLECTION"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once a row, however often ``then`` uses it (an expression used
    inside a lambda is computed once per element otherwise)."""
    return F.get(F.transform(F.array(value), then), 0)


@dataclass(frozen=True)
class Side:
    """Column accessors for one spatial row, optionally with a name prefix
    (``l_`` / ``r_`` inside joins)."""

    prefix: str = ""
    has_geom: bool = False
    struct: Column | None = field(default=None, compare=False)
    has_segs: bool = False      # a precomputed ``segs`` column (see ``with_segments``)

    @classmethod
    def of_struct(cls, struct: Column, has_geom: bool = False, has_segs: bool = False) -> "Side":
        """Accessors over the fields of a struct value (e.g. a neighbour)."""
        return cls("", has_geom, struct, has_segs)

    def whole(self) -> Column:
        """The row's geometry with its segments as one struct, for ``of_struct``."""
        plain = [self.minx.alias("minx"), self.miny.alias("miny"), self.maxx.alias("maxx"), self.maxy.alias("maxy")]
        geom = [self.kind.alias("kind"), self.pts.alias("pts"), self.parts.alias("parts"), self.shells.alias("shells")]
        return F.struct(*(geom if self.has_geom else plain), self.segs.alias("segs"))

    def __call__(self, name: str) -> Column:
        if self.struct is not None:
            return self.struct[name]
        return F.col(self.prefix + name)

    @property
    def minx(self): return self("minx")
    @property
    def miny(self): return self("miny")
    @property
    def maxx(self): return self("maxx")
    @property
    def maxy(self): return self("maxy")
    @property
    def start(self): return self("start_us")
    @property
    def end(self): return self("end_us")

    @property
    def kind(self) -> Column:
        if self.has_geom:
            return self("kind")
        return F.when((self.minx == self.maxx) & (self.miny == self.maxy), F.lit("POINT")) \
            .otherwise(F.lit("POLYGON"))

    @property
    def pts(self) -> Column:
        if self.has_geom:
            return self("pts")
        return box_ring(self.minx, self.miny, self.maxx, self.maxy)

    @property
    def parts(self) -> Column:
        if self.has_geom:
            return self("parts")
        return F.array(F.lit(0))

    @property
    def shells(self) -> Column:
        if self.has_geom:
            return self("shells")
        return F.array(F.lit(0))

    @property
    def segs(self) -> Column:
        if self.has_segs:
            return self("segs")
        return segments(self.pts, self.parts)

    def vertex(self) -> tuple[Column, Column]:
        """One point that lies on the geometry (used for count bounds)."""
        if self.has_geom:
            first = F.get(self.pts, 0)
            return F.coalesce(first["x"], self.minx), F.coalesce(first["y"], self.miny)
        return self.minx, self.miny


@dataclass(frozen=True)
class LitBox:
    """A constant box with the envelope accessors of ``Side``."""

    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def minx(self): return F.lit(self.x0)
    @property
    def miny(self): return F.lit(self.y0)
    @property
    def maxx(self): return F.lit(self.x1)
    @property
    def maxy(self): return F.lit(self.y1)


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def box_ring(minx, miny, maxx, maxy) -> Column:
    """Vertices of a box: one point when degenerate, else a closed ring."""
    ring = F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy),
                   point(minx, maxy), point(minx, miny))
    return F.when((_c(minx) == _c(maxx)) & (_c(miny) == _c(maxy)),
                  F.array(point(minx, miny))).otherwise(ring)


# ---------------------------------------------------------------- envelopes

def envelope(pts) -> tuple[Column, Column, Column, Column]:
    """(minx, miny, maxx, maxy) of a vertex array."""
    pts = _c(pts)
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def expand_envelope(minx, miny, maxx, maxy, d) -> tuple[Column, Column, Column, Column]:
    d = _c(d) if not isinstance(d, (int, float)) else F.lit(float(d))
    return _c(minx) - d, _c(miny) - d, _c(maxx) + d, _c(maxy) + d


def envelope_gap(lmin, lmax, rmin, rmax) -> Column:
    """Gap between two closed ranges on one axis, 0 when they meet."""
    return F.greatest(F.lit(0.0), _c(rmin) - _c(lmax), _c(lmin) - _c(rmax))


def envelope_distance(a: Side, b: Side) -> Column:
    """Distance between envelopes (a lower bound of the geometry distance;
    exact for box frames and points)."""
    dx = envelope_gap(a.minx, a.maxx, b.minx, b.maxx)
    dy = envelope_gap(a.miny, a.maxy, b.miny, b.maxy)
    return F.sqrt(dx * dx + dy * dy)


def envelope_intersects(a: Side, b: Side) -> Column:
    return (a.minx <= b.maxx) & (a.maxx >= b.minx) & (a.miny <= b.maxy) & (a.maxy >= b.miny)


def envelope_intersection(a: Side, b: Side) -> Column:
    """Box intersection as ``struct(minx, miny, maxx, maxy)``; NULL when the
    boxes are disjoint (tested arithmetically, touching boxes intersect)."""
    box = F.struct(F.greatest(a.minx, b.minx).alias("minx"),
                   F.greatest(a.miny, b.miny).alias("miny"),
                   F.least(a.maxx, b.maxx).alias("maxx"),
                   F.least(a.maxy, b.maxy).alias("maxy"))
    return F.when(envelope_intersects(a, b), box)


def centre_xy(a: Side) -> tuple[Column, Column]:
    return (a.minx + a.maxx) / 2, (a.miny + a.maxy) / 2


def contains_point_half_open(minx, miny, maxx, maxy, x, y) -> Column:
    """``minx <= x < maxx and miny <= y < maxy``: exactly one owner per point."""
    return (_c(x) >= _c(minx)) & (_c(x) < _c(maxx)) & (_c(y) >= _c(miny)) & (_c(y) < _c(maxy))


def contains_envelope(outer: Side, inner: Side) -> Column:
    """Closed containment of one box in another."""
    return (inner.minx >= outer.minx) & (inner.maxx <= outer.maxx) & \
        (inner.miny >= outer.miny) & (inner.maxy <= outer.maxy)


def maxdist_point_box(px, py, minx, miny, maxx, maxy) -> Column:
    """Largest distance from a point to any point of a box."""
    dx = F.greatest(F.abs(_c(px) - _c(minx)), F.abs(_c(px) - _c(maxx)))
    dy = F.greatest(F.abs(_c(py) - _c(miny)), F.abs(_c(py) - _c(maxy)))
    return F.sqrt(dx * dx + dy * dy)


# ----------------------------------------------------------- exact distance

def point_distance(ax, ay, bx, by) -> Column:
    dx = _c(ax) - _c(bx)
    dy = _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def segments(pts, parts) -> Column:
    """``array<struct<ax,ay,bx,by>>``: one segment per vertex, joining it to the
    next vertex of the same part; the last vertex of a part (and every point
    of a point kind) becomes a degenerate segment."""
    pts, parts = _c(pts), _c(parts)
    n = F.size(pts)

    def seg(i):
        nxt = F.when((i + 1 < n) & ~F.array_contains(parts, i + 1), i + 1).otherwise(i)
        a, b = F.get(pts, i), F.get(pts, nxt)
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))

    return F.transform(F.sequence(F.lit(0), n - 1), seg)


def point_segment_distance(px, py, s) -> Column:
    """Distance to a segment: perpendicular where the foot lies between the
    ends (exact for axis-parallel segments, so touching gives 0), else to the
    nearer end."""
    dx = s["bx"] - s["ax"]
    dy = s["by"] - s["ay"]
    l2 = dx * dx + dy * dy
    along = (px - s["ax"]) * dx + (py - s["ay"]) * dy
    aside = F.abs(dx * (py - s["ay"]) - dy * (px - s["ax"])) / F.sqrt(l2)
    return (F.when(along <= 0, point_distance(px, py, s["ax"], s["ay"]))
            .when(along >= l2, point_distance(px, py, s["bx"], s["by"]))
            .when(dx == 0, F.abs(px - s["ax"])).when(dy == 0, F.abs(py - s["ay"])).otherwise(aside))


def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(s, t) -> Column:
    """Proper crossing of two segments (touching is caught by the vertex
    distances, which are then 0)."""
    o1 = _orient(s["ax"], s["ay"], s["bx"], s["by"], t["ax"], t["ay"])
    o2 = _orient(s["ax"], s["ay"], s["bx"], s["by"], t["bx"], t["by"])
    o3 = _orient(t["ax"], t["ay"], t["bx"], t["by"], s["ax"], s["ay"])
    o4 = _orient(t["ax"], t["ay"], t["bx"], t["by"], s["bx"], s["by"])
    return (o1 * o2 < 0) & (o3 * o4 < 0)


def point_in_rings(px, py, segs) -> Column:
    """Even-odd rule over all rings (holes included)."""
    crossings = F.size(F.filter(segs, lambda s: ((s["ay"] > py) != (s["by"] > py)) & (
        px < (s["bx"] - s["ax"]) * (py - s["ay"]) / (s["by"] - s["ay"]) + s["ax"])))
    return (crossings % 2) == 1


def has_area(a: Side) -> Column:
    return a.kind.isin(*AREA_KINDS) | ((a.kind == COLLECTION) & (F.size(a.shells) > 0))


def area_segments(a: Side) -> Column:
    """The segments whose even-odd rule decides what lies inside, as an array of arrays: all in one
    for the plain kinds, one per polygon of a collection (its polygons may overlap)."""
    if not a.has_geom:
        return F.array(a.segs)

    def polygon(shell, j):
        first = F.get(a.parts, shell)
        stop = F.coalesce(F.get(a.parts, F.get(a.shells, j + 1)), F.size(a.pts))
        return F.slice(a.segs, first + 1, stop - first)

    return F.when(a.kind == COLLECTION, F.transform(a.shells, polygon)).otherwise(F.array(a.segs))


def geometry_distance(a: Side, b: Side) -> Column:
    """Exact planar distance between two geometries; 0 when they touch,
    cross or one contains the other.  Points take a closed-form path."""
    if not a.has_geom and not b.has_geom:
        return envelope_distance(a, b)
    both_points = (a.kind == "POINT") & (b.kind == "POINT")

    def general(a: Side, b: Side) -> Column:
        a_to_b = F.array_min(F.transform(a.pts, lambda p: F.array_min(
            F.transform(b.segs, lambda s: point_segment_distance(p["x"], p["y"], s)))))
        b_to_a = F.array_min(F.transform(b.pts, lambda p: F.array_min(
            F.transform(a.segs, lambda s: point_segment_distance(p["x"], p["y"], s)))))
        crossing = F.exists(a.segs, lambda s: F.exists(b.segs, lambda t: segments_cross(s, t)))

        def part_inside(inner, outer):
            # without a crossing a part lies inside as a whole or not at all
            def inside(rings):
                def at(i):
                    p = F.get(inner.pts, i)
                    return point_in_rings(p["x"], p["y"], rings)
                return F.exists(inner.parts, at)
            return has_area(outer) & F.exists(area_segments(outer), inside)

        return F.when(crossing | part_inside(a, b) | part_inside(b, a), F.lit(0.0)).otherwise(F.least(a_to_b, b_to_a))

    return F.when(both_points, point_distance(a.minx, a.miny, b.minx, b.miny)).otherwise(
        bound(a.whole(), lambda x: bound(b.whole(), lambda y: general(
            Side.of_struct(x, a.has_geom, True), Side.of_struct(y, b.has_geom, True)))))


def ring_moments(pts, parts) -> Column:
    """Per ring: twice the signed area ``a2`` and the first moments
    ``mx, my`` of the shoelace formula (rings are closed: last = first)."""
    pts, parts = _c(pts), _c(parts)
    n = F.size(pts)

    def ring(r):
        start = F.get(parts, r)
        stop = F.coalesce(F.get(parts, r + 1), n)
        idx = F.sequence(start, F.greatest(start, stop - 2))
        none = F.struct(*[F.lit(0.0).alias(c) for c in ("a2", "mx", "my")])

        def add(acc, i):
            def of(p, q):
                cross = F.when(i < stop - 1, p["x"] * q["y"] - q["x"] * p["y"]).otherwise(F.lit(0.0))
                return bound(cross, lambda c: F.struct(
                    (acc["a2"] + c).alias("a2"), (acc["mx"] + c * (p["x"] + q["x"])).alias("mx"),
                    (acc["my"] + c * (p["y"] + q["y"])).alias("my")))
            # the neutral row where a part has no next vertex
            return bound(F.struct(F.get(pts, i).alias("p"), F.coalesce(F.get(pts, i + 1), F.get(pts, i)).alias("q")),
                         lambda e: of(e["p"], e["q"]))

        return F.aggregate(idx, none, add)

    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), ring)


# ------------------------------------------------------------------ centroid

def centroid(a: Side) -> Column:
    """``struct(x, y)``: points -> mean; lines -> length-weighted segment
    midpoints; polygons -> area centroid, shells count for and holes against
    whatever their orientation; a collection -> that of its members of the highest dimension."""
    if not a.has_geom:
        return point((a.minx + a.maxx) / 2, (a.miny + a.maxy) / 2)
    pts, kind = a.pts, a.kind
    n = F.size(pts).cast("double")
    mean = point(F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["x"]) / n,
                 F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["y"]) / n)

    def summed(items, names, values):
        """Sums of ``values(item)`` in one pass, as a struct."""
        none = F.struct(*[F.lit(0.0).alias(c) for c in names])
        return F.aggregate(items, none, lambda acc, e: bound(values(e), lambda v: F.struct(
            *[(acc[c] + v[c]).alias(c) for c in names])))

    def of_segment(s):
        return bound(point_distance(s["ax"], s["ay"], s["bx"], s["by"]), lambda d: F.struct(
            d.alias("len"), (d * (s["ax"] + s["bx"]) / 2).alias("x"), (d * (s["ay"] + s["by"]) / 2).alias("y")))

    # +1 for shells, -1 for holes, independent of ring orientation
    first_shell = F.get(a.shells, 0)    # before it stand the points and lines of a collection

    def of_ring(z):
        r, i = z["r"], z["i"]
        sign = F.when(F.array_contains(a.shells, i), F.lit(1.0)) \
            .when((kind == COLLECTION) & (i < F.coalesce(first_shell, n)), F.lit(0.0)).otherwise(F.lit(-1.0)) * F.signum(r["a2"])
        return bound(sign, lambda w: F.struct(*[(w * r[c]).alias(c) for c in ("a2", "mx", "my")]))

    rings = F.transform(ring_moments(pts, a.parts), lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    areas = summed(rings, ("a2", "mx", "my"), of_ring)
    lines = summed(a.segs, ("len", "x", "y"), of_segment)

    def by_line():
        return bound(lines, lambda t: F.when(t["len"] > 0, point(t["x"] / t["len"], t["y"] / t["len"])).otherwise(mean))

    def by_area(otherwise):
        return bound(areas, lambda t: F.when(t["a2"] != 0, point(t["mx"] / (3 * t["a2"]), t["my"] / (3 * t["a2"]))).otherwise(otherwise))

    return (F.when(kind == "POINT", point(a.minx, a.miny))
            .when(kind == "MULTIPOINT", mean)
            .when(kind.isin("LINESTRING", "MULTILINESTRING"), by_line())
            .when(kind.isin(*AREA_KINDS), by_area(mean))
            .when(kind == COLLECTION, F.when(F.size(a.shells) > 0, by_area(by_line())).otherwise(by_line()))
            .otherwise(mean))


# --------------------------------------------------------------- grid cells

@dataclass(frozen=True)
class Grid:
    """Square root cell ``[x0, x0+side] x [y0, y0+side]`` split into
    ``2^level x 2^level`` cells per level.  Cell numbers are clamped, so
    points outside the root belong to the edge cells and the last cell of a
    level is closed."""

    x0: float
    y0: float
    side: float

    def cell(self, v, origin: float, level) -> Column:
        level = _c(level) if not isinstance(level, int) else F.lit(level)
        n = F.pow(F.lit(2.0), level)  # exact for powers of two
        raw = F.floor((_c(v) - F.lit(origin)) / F.lit(self.side) * n)
        return F.least(F.greatest(raw, F.lit(0)), (n - 1).cast("bigint")).cast("int")

    def cx(self, x, level) -> Column:
        return self.cell(x, self.x0, level)

    def cy(self, y, level) -> Column:
        return self.cell(y, self.y0, level)

    def cell_size(self, level) -> Column:
        level = _c(level) if not isinstance(level, int) else F.lit(level)
        return F.lit(self.side) / F.pow(F.lit(2.0), level)

    def cell_box(self, level, cx, cy) -> tuple[Column, Column, Column, Column]:
        size = self.cell_size(level)
        minx = F.lit(self.x0) + _c(cx) * size
        miny = F.lit(self.y0) + _c(cy) * size
        return minx, miny, minx + size, miny + size


def quadrant(cx, cy, q: int) -> tuple[Column, Column]:
    """Child cell of ``(cx, cy)`` one level down; quadrant 0 SW, 1 SE, 2 NW, 3 NE."""
    return _c(cx) * 2 + (q & 1), _c(cy) * 2 + (q >> 1)


# ------------------------------------------------------------------- GeoJSON

def _xy(p) -> Column:
    return F.array(p["x"], p["y"])


def geojson_geometry(a: Side) -> Column:
    """GeoJSON geometry object as a JSON string."""
    def obj(kind, coords):
        return F.to_json(F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")))

    if not a.has_geom:
        pt = obj("Point", F.array(a.minx, a.miny))
        ring = F.transform(box_ring(a.minx, a.miny, a.maxx, a.maxy), _xy)
        return F.when(a.kind == "POINT", pt).otherwise(obj("Polygon", F.array(ring)))
    pts, parts = a.pts, a.parts
    n = F.size(pts)

    def part_coords(i):
        start = F.get(parts, i)
        stop = F.coalesce(F.get(parts, i + 1), n)
        return F.transform(F.slice(pts, start + 1, stop - start), _xy)

    kind = a.kind

    def of_parts(all_parts):
        def polygon(first, j):
            return F.slice(all_parts, first + 1, F.coalesce(F.get(a.shells, j + 1), F.size(parts)) - first)

        singles = F.transform(F.slice(all_parts, 1, F.coalesce(F.get(a.shells, 0), F.size(parts))),
                              lambda p: F.when(F.size(p) == 1, obj("Point", F.get(p, 0))).otherwise(obj("LineString", p)))
        members = F.concat(singles, F.transform(a.shells, lambda s, j: obj("Polygon", polygon(s, j))))
        collection = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(members, ","), F.lit("]}"))
        return (F.when(kind == "MULTILINESTRING", obj("MultiLineString", all_parts))
                .when(kind == "POLYGON", obj("Polygon", all_parts))
                .when(kind == "MULTIPOLYGON", obj("MultiPolygon", F.transform(a.shells, polygon)))
                .when(kind == COLLECTION, collection))

    return (F.when(kind == "POINT", obj("Point", _xy(F.get(pts, 0))))
            .when(kind == "MULTIPOINT", obj("MultiPoint", F.transform(pts, _xy)))
            .when(kind == "LINESTRING", obj("LineString", F.transform(pts, _xy)))
            .otherwise(bound(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), part_coords), of_parts)))
