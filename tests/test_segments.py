"""Distances through the join of segments equal the column expression, whatever the shapes."""

import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SEC
from conftest import wkt_frame as parsed_frame
from tandem.functions import geometry as G
from tandem.model import prefixed, with_segments
from tandem.operators import knn as KN
from tandem.operators import segments as SG
from tandem.session import stored


def wkt_frame(spark, rows):
    """Parsed once: a plan would parse the text again for every use of the points."""
    return stored(parsed_frame(spark, rows), "shapes")


def ring(x, y, r, n, turn=0.0):
    pts = [(x + r * math.cos(turn + 2 * math.pi * i / n), y + r * math.sin(turn + 2 * math.pi * i / n)) for i in range(n)]
    return "(" + ", ".join(f"{a!r} {b!r}" for a, b in [*pts, pts[0]]) + ")"


def shapes():
    rng = np.random.default_rng(5)
    out = ["POINT (3 3)", "POINT (50 50)", "MULTIPOINT ((0 0), (40 41), (3 3))", "LINESTRING (0 0, 100 100)",
           "LINESTRING (0 100, 100 0, 100 50)", "LINESTRING (5 5, 5 5)", "LINESTRING (1e6 1e6, 1.1e6 1e6)",
           f"POLYGON ({ring(50, 50, 40, 30)})", f"POLYGON ({ring(50, 50, 40, 24)}, {ring(50, 50, 20, 16)})",
           f"POLYGON ({ring(50, 50, 5, 16)})", f"POLYGON ({ring(52, 49, 1, 12)})", f"POLYGON ({ring(200, 50, 9, 40)})",
           f"MULTIPOLYGON (({ring(0, 0, 3, 9)}), ({ring(50, 50, 2, 9)}))", "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (1 1, 99 1, 99 99, 1 99, 1 1))"]
    for n in (2, 7, 20):
        walk = np.cumsum(rng.normal(size=(n, 2)) * 4, axis=0) + rng.uniform(0, 100, 2)
        out.append("LINESTRING (" + ", ".join(f"{a!r} {b!r}" for a, b in walk.tolist()) + ")")
    return [(i, w, 0, 10) for i, w in enumerate(out)]


def all_pairs(spark):
    rows = with_segments(wkt_frame(spark, shapes()))
    pairs = prefixed(rows, "l_").crossJoin(prefixed(rows, "r_"))
    return pairs, G.Side("l_", True, has_segs=True), G.Side("r_", True, has_segs=True)


def test_every_pair_of_shapes(spark):
    pairs, left, right = all_pairs(spark)
    want = {(r.l_id, r.r_id): r.d for r in pairs.select("l_id", "r_id", G.geometry_distance(left, right).alias("d")).collect()}
    got = {(r.l_id, r.r_id): r.dist for r in SG.exact_distances(pairs, left, right).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)
    assert want[9, 8] > 0 and want[9, 7] == 0  # inside a hole, inside an area


def test_large_and_small_pairs_in_one_frame(spark):
    pairs, left, right = all_pairs(spark)
    want = {(r.l_id, r.r_id): r.d for r in pairs.select("l_id", "r_id", G.geometry_distance(left, right).alias("d")).collect()}
    got = {(r.l_id, r.r_id): r.dist for r in SG.with_distance(pairs, left, right, 10 ** 6, limit=300).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)


def test_segment_pairs_stay_linear(spark):
    """Two rings of n segments each: near segments grow with n, not with n * n."""
    met = {}
    for n in (200, 800):
        rows = wkt_frame(spark, [(0, f"POLYGON ({ring(0, 0, 50, n)})", 0, 1), (1, f"POLYGON ({ring(101, 0, 50, n, .1)})", 0, 1)])
        pairs = prefixed(rows.where("id = 0"), "l_").crossJoin(prefixed(rows.where("id = 1"), "r_"))
        shape = SG.bounded_pairs(pairs, G.Side("l_", True), G.Side("r_", True))
        met[n] = SG.near_segments(shape).count()
    assert 0 < met[800] < 0.05 * 800 * 800 and met[800] < 8 * met[200]


def test_joins_of_large_geometries(spark):
    left = wkt_frame(spark, [(i, f"POLYGON ({ring(30 * i, 0, 10, 70)})", 0, 10) for i in range(4)])
    right = wkt_frame(spark, [(i, f"POLYGON ({ring(30 * i + 3, 25, 10, 60)})", 0, 10) for i in range(5)])
    near = {(r.l_id, r.r_id): r.dist for r in KN.st_distance_join(left, right, 12.0, SEC).collect()}
    plain = {(r.l_id, r.r_id): r.dist for r in KN.st_distance_join(left, right, 12.0, SEC, segment_pairs=10 ** 9).collect()}
    assert near.keys() == plain.keys() and all(abs(near[k] - plain[k]) < 1e-9 for k in near) and len(near) == 4
    best = KN.st_knn_join(left, right, 1, SEC).select("l_id", "r_id").collect()
    assert sorted((r.l_id, r.r_id) for r in best) == [(i, i) for i in range(4)]
