"""Nested WKT: collections, Z and M, EMPTY members, against plain Python over the shapes they were written from."""

import json
import math
import random

import pytest
from conftest import wkt_frame
from pyspark.sql import functions as F

from tandem.functions import geometry as G
from tandem.functions.wkt import to_wkt
from tandem.model import GEOM_COLUMNS, with_segments
from tandem.operators import segments as SG

COLLECTED = "GEOMETRYCOLLECTION "


def square(x, y, a):
    return [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]


def shapes(rng):
    """Simple members: ("POINT", (x, y)), ("LINESTRING", [..]), ("POLYGON", [ring, hole ..])."""
    out = []
    for _ in range(rng.randint(1, 5)):
        x, y = rng.randint(-20, 20), rng.randint(-20, 20)
        kind = rng.choice(["POINT", "LINESTRING", "POLYGON"])
        if kind == "POINT":
            out.append((kind, (x, y)))
        elif kind == "LINESTRING":
            out.append((kind, [(x, y), (x + rng.randint(1, 5), y), (x, y + rng.randint(1, 9))]))
        else:
            a = rng.choice([2, 6, 12])
            out.append((kind, [square(x, y, a)] + ([square(x + 1, y + 1, a - 2)] if a > 2 and rng.random() < .5 else [])))
    return out


def coordinate(p, dim):
    return " ".join([f"{p[0]}", f"{float(p[1]):.1e}"] + ["7"] * (dim - 2))


def body(kind, shape, dim):
    def bracket(ps):
        return "(" + ", ".join(coordinate(p, dim) for p in ps) + ")"
    return {"POINT": lambda: bracket([shape]), "LINESTRING": lambda: bracket(shape),
            "POLYGON": lambda: "(" + ",".join(bracket(r) for r in shape) + ")"}[kind]()


def text_of(members, rng, depth=0):
    """WKT of the members with random tags, MULTI kinds, EMPTY members and nesting."""
    parts, rest = [], list(members)
    while rest:
        kind, shape = rest.pop(0)
        tag, dim = rng.choice([("", 2), ("", 3), (" Z", 3), ("M", 3), (" ZM ", 4), ("", 4)])
        if rng.random() < .3:
            parts.append(f"{rng.choice(['POINT', 'POLYGON Z', 'MULTILINESTRING'])} EMPTY")
        if rng.random() < .4:
            parts.append(f"MULTI{kind}{tag} (EMPTY, {body(kind, shape, dim)} ,EMPTY)")
        elif depth < 6 and rng.random() < .5:
            parts.append(text_of([(kind, shape)] + rest[:1], rng, depth + 1))
            rest = rest[1:]
        else:
            parts.append(f"{kind}{tag} {body(kind, shape, dim)}")
    return rng.choice([COLLECTED, COLLECTED.lower(), "GeometryCollection Z"]) + "(" + " , ".join(parts) + ")"


def segments_of(kind, shape):
    if kind == "POINT":
        return [(shape, shape)]
    lines = [shape] if kind == "LINESTRING" else shape
    return [(a, b) for ps in lines for a, b in zip(ps, ps[1:])]


def point_segment(p, s):
    (ax, ay), (bx, by) = s
    l2 = (bx - ax) ** 2 + (by - ay) ** 2
    u = 0 if l2 == 0 else min(1, max(0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / l2))
    return math.hypot(ax + u * (bx - ax) - p[0], ay + u * (by - ay) - p[1])


def cross(s, t):
    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return side(*s, t[0]) * side(*s, t[1]) < 0 and side(*t, s[0]) * side(*t, s[1]) < 0


def covers(polygon, p):
    inside = False
    for (ax, ay), (bx, by) in segments_of("POLYGON", polygon):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def distance(a, b):
    best = math.inf
    for ka, sa in a:
        for kb, sb in b:
            la, lb = segments_of(ka, sa), segments_of(kb, sb)
            if any(cross(s, t) for s in la for t in lb) or (kb == "POLYGON" and covers(sb, la[0][0])) \
                    or (ka == "POLYGON" and covers(sa, lb[0][0])):
                return 0.0
            best = min([best] + [point_segment(p, t) for s in la for t in lb for p in s]
                       + [point_segment(p, s) for s in la for t in lb for p in t])
    return best


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(11)
    members = [shapes(rng) for _ in range(60)]
    frame = wkt_frame(spark, [(i, text_of(m, rng), 0, 0) for i, m in enumerate(members)]).cache()
    return members, frame


def order(members):
    return sorted(members, key=lambda m: ["POINT", "LINESTRING", "POLYGON"].index(m[0]))


def test_members_at_any_depth(drawn):
    members, frame = drawn
    side = G.Side("", True)
    rows = frame.select("*", G.geojson_geometry(side).alias("json"), G.centroid(side).alias("c")).orderBy("id").collect()
    for r, want in zip(rows, members):
        assert r["kind"] == "GEOMETRYCOLLECTION"
        points = [p for k, s in want for seg in segments_of(k, s) for p in seg]
        xs, ys = zip(*points)
        assert (r["minx"], r["miny"], r["maxx"], r["maxy"]) == (min(xs), min(ys), max(xs), max(ys))
        assert len(r["shells"]) == sum(k == "POLYGON" for k, _ in want)
        got = json.loads(r["json"])
        assert got["type"] == "GeometryCollection"
        names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}
        plain = [{"type": names[k], "coordinates": json.loads(json.dumps(s))} for k, s in order(want)]
        assert got["geometries"] == plain


def test_centroid_is_that_of_the_highest_dimension(drawn):
    members, frame = drawn
    rows = frame.select("id", G.centroid(G.Side("", True)).alias("c")).orderBy("id").collect()
    seen = set()
    for r, want in zip(rows, members):
        kind = next(k for k in ("POLYGON", "LINESTRING", "POINT") if any(k == m for m, _ in want))
        seen.add(kind)
        weighed = []
        for k, s in want:
            if k != kind:
                continue
            if kind == "POINT":
                weighed.append((1, *s))
            elif kind == "LINESTRING":
                weighed += [(math.dist(a, b), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in segments_of(k, s)]
            else:
                weighed += [((1 if j == 0 else -1) * (ring[1][0] - ring[0][0]) ** 2, (ring[0][0] + ring[1][0]) / 2,
                             (ring[0][1] + ring[2][1]) / 2) for j, ring in enumerate(s)]
        total = sum(w for w, _, _ in weighed)
        assert r["c"]["x"] == pytest.approx(sum(w * x for w, x, _ in weighed) / total, abs=1e-9)
        assert r["c"]["y"] == pytest.approx(sum(w * y for w, _, y in weighed) / total, abs=1e-9)
    assert len(seen) > 1


def pairs_of(frame):
    rows = with_segments(frame)
    left, right = (rows.select(*[F.col(c).alias(p + c) for c in ("id", "segs", "minx", "miny", "maxx", "maxy", *GEOM_COLUMNS)])
                   for p in ("l_", "r_"))
    return left.join(right, F.col("l_id") < F.col("r_id"))


def test_distance_of_collections(drawn):
    members, frame = drawn
    pairs = pairs_of(frame.where("id < 40"))
    a, b = G.Side("l_", True, has_segs=True), G.Side("r_", True, has_segs=True)
    plain = {(r[0], r[1]): r[2] for r in pairs.select("l_id", "r_id", G.geometry_distance(a, b)).collect()}
    joined = {(r[0], r[1]): r[2] for r in SG.exact_distances(pairs, a, b).collect()}
    want = {(i, j): distance(members[i], members[j]) for i, j in plain}
    assert len(want) == 40 * 39 // 2 and any(v == 0 for v in want.values())
    assert plain == pytest.approx(want, abs=1e-9)
    assert joined == pytest.approx(want, abs=1e-9)


def test_overlapping_polygons_do_not_cancel(spark):
    both = f"{COLLECTED}(POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0)), POLYGON ((1 1, 8 1, 8 8, 1 8, 1 1)))"
    pairs = pairs_of(wkt_frame(spark, [(1, both, 0, 0), (2, f"{COLLECTED}(POINT (4 4))", 0, 0)]))
    a, b = G.Side("l_", True, has_segs=True), G.Side("r_", True, has_segs=True)
    assert pairs.select(G.geometry_distance(a, b)).first()[0] == 0.0
    assert SG.exact_distances(pairs, a, b).first()["dist"] == 0.0


def test_written_text_reads_back(spark, drawn):
    _, frame = drawn
    texts = frame.select("id", to_wkt(*GEOM_COLUMNS).alias("wkt")).collect()
    again = wkt_frame(spark, [(r["id"], r["wkt"], 0, 0) for r in texts])
    cols = ["id", *GEOM_COLUMNS]
    assert again.select(*cols).orderBy("id").collect() == frame.select(*cols).orderBy("id").collect()


@pytest.mark.parametrize("text, n_pts, parts", [
    ("POINT Z (1 2 3)", 1, [0]), ("POINT (1 2 3)", 1, [0]), ("pointzm(1 2 3 4)", 1, [0]), ("LINESTRING M (1 2 3, 4 5 6)", 2, [0]),
    ("POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))", 4, [0]), ("MULTIPOINT (EMPTY, 1 2, (3 4))", 2, [0, 1]),
    ("MULTILINESTRING (EMPTY, (0 0, 1 1), EMPTY, (2 2, 3 3))", 4, [0, 2]), ("MULTIPOINT (EMPTY)", 0, []),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), EMPTY, ((5 5, 6 5, 6 6, 5 5), (5 5, 6 5, 6 6, 5 5)))", 12, [0, 4, 8]),
    ("GEOMETRYCOLLECTION EMPTY", 0, []), ("GEOMETRYCOLLECTION Z EMPTY", 0, []), ("GEOMETRYCOLLECTION (POINT EMPTY)", 0, []),
    (COLLECTED * 1 + "(" + "GEOMETRYCOLLECTION (" * 40 + "POINT (1 2)" + ")" * 41, 1, [0]),
    (COLLECTED + "(" + ", ".join(["LINESTRING (0 0, 1 1)"] * 300) + ")", 600, list(range(0, 600, 2))),
    ("LINESTRING Z (" + ", ".join(f"{i} {i} 0" for i in range(20000)) + ")", 20000, [0])])
def test_accepted(spark, text, n_pts, parts):
    r = wkt_frame(spark, [(1, text, 0, 0)]).select("kind", F.size("pts").alias("n"), "parts").first()
    assert r["kind"] is not None and (r["n"], list(r["parts"])) == (n_pts, parts)


def test_rejected(spark):
    texts = ["POINT Z (1 2)", "POINT ZM (1 2 3)", "POINT M (1 2 3 4)", "POINT (1 2 3 4 5)", "LINESTRING (1 2, 3 4 5)", "POINTEMPTY",
             "POLYGON ((0 0, 1 0, 1 1, 0 0), EMPTY)", "MULTIPOLYGON ((EMPTY))", "LINESTRING (EMPTY, 1 2)", "MULTIPOINT (EMPTY 1 2)",
             "MULTIPOINT (,EMPTY)", "MULTILINESTRING (1 2, EMPTY)", "MULTILINESTRING ((1 2, 3 4)(5 6, 7 8))", "GEOMETRYCOLLECTION ()",
             "GEOMETRYCOLLECTION (POINT (1 2)", "GEOMETRYCOLLECTION (POINT (1 2) POINT (3 4))", "GEOMETRYCOLLECTION (POINT (1 2),)",
             "GEOMETRYCOLLECTION ((POINT (1 2)))", "GEOMETRYCOLLECTION (1 2)", "GEOMETRYCOLLECTION (POINT Z (1 2))", "POINT (1 2), POINT (3 4)",
             "GEOMETRYCOLLECTION (POINT (1 2)), POINT (3 4)", "POINT (1 2), POINT (3 4), POINT EMPTY",
             "SRID=4326;GEOMETRYCOLLECTION (POINT (1 2))", "POLYGON (((0 0, 1 0, 1 1, 0 0)))", "MULTIPOLYGON ((0 0, 1 0, 1 1, 0 0))", "g", "G"]
    kinds = wkt_frame(spark, [(i, t, 0, 0) for i, t in enumerate(texts)]).orderBy("id").select("kind").collect()
    assert [t for t, k in zip(texts, kinds) if k["kind"] is not None] == []
