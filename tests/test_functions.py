"""Column expressions: WKT, envelopes, distances, centroid, time, grid."""

import math

import pytest

from pyspark.sql import functions as F

from conftest import SEC, frame, wkt_frame
from tandem.functions import geometry as G
from tandem.functions import time as TM
from tandem.functions.wkt import to_wkt
from tandem.operators.stats import collect_stats


def one(df, col):
    return df.select(col).first()[0]


def test_wkt_kinds(spark):
    df = wkt_frame(spark, [
        (1, "POINT (1.5 2)", 0, 0),
        (2, "LINESTRING (0 0, 2 0, 2 3)", 0, 0),
        (3, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", 0, 0),
        (4, "MULTIPOINT ((1 1), (3 4))", 0, 0),
        (5, "MULTIPOINT (1 1, 3 4)", 0, 0),
        (6, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((3 0, 4 0, 4 1, 3 1, 3 0)))", 0, 0),
        (7, "multilinestring ((0 0, 1 1), (2 2, 3 3))", 0, 0),
        (8, "POINT (-1.5e2 +2.25)", 0, 0),
    ]).orderBy("id")
    rows = df.select("kind", F.size("pts").alias("n"), "parts", "minx", "miny", "maxx", "maxy").collect()
    assert [(r["kind"], r["n"], list(r["parts"])) for r in rows] == [
        ("POINT", 1, [0]), ("LINESTRING", 3, [0]), ("POLYGON", 10, [0, 5]), ("MULTIPOINT", 2, [0, 1]),
        ("MULTIPOINT", 2, [0, 1]), ("MULTIPOLYGON", 10, [0, 5]), ("MULTILINESTRING", 4, [0, 2]),
        ("POINT", 1, [0])]
    assert (rows[2]["minx"], rows[2]["maxy"]) == (0.0, 4.0)
    assert (rows[7]["minx"], rows[7]["miny"]) == (-150.0, 2.25)


def test_wkt_roundtrip(spark):
    texts = ["POINT (1.5 2.0)", "LINESTRING (0.0 0.0, 2.0 0.0)",
             "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 1.0 2.0, 1.0 1.0))",
             "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0)), ((3.0 0.0, 4.0 0.0, 4.0 1.0, 3.0 0.0)))"]
    df = wkt_frame(spark, [(i, t, 0, 0) for i, t in enumerate(texts)]).orderBy("id")
    back = [r[0] for r in df.select(to_wkt("kind", "pts", "parts", "shells")).collect()]
    assert back == texts


SQUARE = "POLYGON ((-5 -5, 5 -5, 5 5, -5 5, -5 -5))"


@pytest.mark.parametrize("text", [
    "MULTIPOINT ((100 100), (0 0))", "MULTILINESTRING ((90 90, 100 100), (-1 0, 1 0))",
    "MULTIPOLYGON (((90 90, 91 90, 91 91, 90 90)), ((0 0, 1 0, 1 1, 0 0)))"])
def test_any_part_inside_is_at_distance_zero(spark, text):
    df = wkt_frame(spark, [(1, SQUARE, 0, 0)]).select(*[F.col(c).alias("l_" + c) for c in (
        "kind", "pts", "parts", "shells", "minx", "miny", "maxx", "maxy")])
    other = wkt_frame(spark, [(2, text, 0, 0)])
    both = df.join(other, F.lit(1) == F.lit(1))
    a, b = G.Side("l_", True), G.Side("", True)
    assert both.select(G.geometry_distance(a, b).alias("x"), G.geometry_distance(b, a).alias("y")).first() == (0.0, 0.0)


CLOCKWISE = "((3 0, 3 1, 4 1, 4 0, 3 0))"
HOLED = "((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"      # hole drawn like its shell


@pytest.mark.parametrize("text, centre, polygons", [
    (f"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), {CLOCKWISE})", (2.0, 0.5), [1, 1]),
    (f"MULTIPOLYGON ({HOLED})", (4.5375, 4.5375), [2]),
    (f"MULTIPOLYGON ({HOLED}, ((20 20, 21 20, 21 21, 20 20)))", None, [2, 1])])
def test_multipolygon_shells_and_holes(spark, text, centre, polygons):
    import json
    df = wkt_frame(spark, [(1, text, 0, 0)])
    side = G.Side("", True)
    row = df.select(G.centroid(side).alias("c"), G.geojson_geometry(side).alias("j"),
                    to_wkt("kind", "pts", "parts", "shells").alias("w")).first()
    assert [len(p) for p in json.loads(row["j"])["coordinates"]] == polygons
    again = wkt_frame(spark, [(1, row["w"], 0, 0)]).select("pts", "parts", "shells").first()
    assert again == df.select("pts", "parts", "shells").first()
    if centre:
        assert (round(row["c"]["x"], 9), round(row["c"]["y"], 9)) == centre


def test_malformed_wkt_is_rejected(spark):
    good = ["POINT(1 2)", " point ( 1   2 ) ", "POINT EMPTY", "LINESTRING (" + ", ".join(f"{i} {i}" for i in range(20000)) + ")",
            "MULTIPOINT ((1 2), (3 4))", "GEOMETRYCOLLECTION (POINT (1 2))", "POINT (1 2 3)", "POINT Z (1 2 3)",
            "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (0 0, 1 0, 1 1, 0 0)), ((0 0, 1 0, 1 1, 0 0)))"]
    bad = ["POINT (abc 2 3)", "SRID=4326;POINT (1 2)", "GEOMETRYCOLLECTION (POINT (1 2)", "POINT (1 2", "",
           "POINT (1 2, 3 4)", "LINESTRING (1 2,, 3 4)", "POLYGON (1 2, 3 4)", "POINT (1 2) x", "POINT Z (1 2)", "CIRCLE (1 2)"]
    df = wkt_frame(spark, [(i, t, 0, 0) for i, t in enumerate(good + bad)] + [(99, None, 0, 0)])
    kinds = [r[0] for r in df.orderBy("id").select("kind").collect()]
    assert all(kinds[:len(good)]) and not any(kinds[len(good):])


def test_floor_div_is_exact_for_far_times(spark):
    values = [2**53 + 1, 2**62 + 7, -2**62 - 7, -1, 0, 253_402_300_799_999_999]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(TM.floor_div("v", 3), TM.ceil_div("v", 3)).collect()
    assert [tuple(r) for r in got] == [(v // 3, -(-v // 3)) for v in values]


def test_envelope_of_union_fixture(spark):
    # triangle (0,0),(1,1),(1,0) with point (2,2): envelope (0,0,2,2)
    df = wkt_frame(spark, [(1, "POLYGON ((0 0, 1 1, 1 0, 0 0))", 0, 0), (2, "POINT (2 2)", 0, 0)])
    st = collect_stats(df)
    assert (st.minx, st.miny, st.maxx, st.maxy) == (0.0, 0.0, 2.0, 2.0)


def test_statistics_fixture(spark):
    df = wkt_frame(spark, [(1, "POLYGON ((0 0, 1 1, 1 0, 0 0))", 5, 7)])
    st = collect_stats(df)
    assert (st.minx, st.miny, st.maxx, st.maxy, st.n) == (0.0, 0.0, 1.0, 1.0, 1)
    assert (st.start_us, st.end_us) == (5 * SEC, 7 * SEC)


def test_distances(spark):
    geoms = wkt_frame(spark, [
        (1, "LINESTRING (-1 3, 1 3)", 0, 0),
        (2, "POLYGON ((-5 -5, 5 -5, 0 5, -5 -5))", 0, 0),
        (3, "LINESTRING (-3 -3, 3 3)", 0, 0),
        (4, "POLYGON ((10 0, 12 0, 12 2, 10 2, 10 0))", 0, 0),
    ])
    pt = geoms.withColumn("p_minx", F.lit(0.0)).withColumn("p_maxx", F.lit(0.0)) \
        .withColumn("p_miny", F.lit(0.0)).withColumn("p_maxy", F.lit(0.0))
    d = dict(pt.select("id", G.geometry_distance(G.Side("", True), G.Side("p_")).alias("d")).collect())
    assert d[1] == 3.0 and d[2] == 0.0 and d[3] == 0.0 and d[4] == 10.0
    # two crossing lines in one row (no vertex of either touches the other)
    both = wkt_frame(spark, [(3, "LINESTRING (-3 -3, 3 3)", 0, 0)]).join(
        wkt_frame(spark, [(3, "LINESTRING (-3 3, 3 -3)", 0, 0)]).select(
            "id", *[F.col(c).alias("o_" + c) for c in ("kind", "pts", "parts", "shells", "minx", "miny", "maxx", "maxy")]),
        "id")
    assert one(both, G.geometry_distance(G.Side("", True), G.Side("o_", True))) == 0.0


def test_centroids(spark):
    df = wkt_frame(spark, [
        (1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", 0, 0),
        (2, "LINESTRING (0 0, 2 0, 2 3)", 0, 0),
        (3, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((3 0, 4 0, 4 1, 3 1, 3 0)))", 0, 0),
        (4, "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))", 0, 0),
    ]).orderBy("id")
    c = [(r[0]["x"], r[0]["y"]) for r in df.select(G.centroid(G.Side("", True))).collect()]
    assert math.isclose(c[0][0], 30.5 / 15) and math.isclose(c[0][1], 30.5 / 15)
    assert math.isclose(c[1][0], 1.6) and math.isclose(c[1][1], 0.9)
    assert math.isclose(c[2][0], 2.0) and math.isclose(c[2][1], 0.5)
    assert math.isclose(c[3][0], 2.0) and math.isclose(c[3][1], 2.0)   # clockwise shell


def test_time_helpers(spark):
    df = spark.createDataFrame([(-7,), (7,), (10,), (0,)], "t bigint")
    got = [(r[0], r[1], r[2]) for r in df.select("t", TM.floor_div("t", 5), TM.ceil_div("t", 5)).collect()]
    assert got == [(-7, -2, -1), (7, 1, 2), (10, 2, 2), (0, 0, 0)]
    t = one(spark.range(1), TM.parse_time(F.lit("2024-01-10 00:00:00")))
    assert t == 1_704_844_800 * SEC
    assert one(spark.range(1), TM.centre_t(F.lit(-3), F.lit(0))) == -2
    assert one(spark.range(1), TM.time_reference_point(F.lit(1), F.lit(5), F.lit(3), F.lit(9))) == 3
    assert one(spark.range(1), TM.time_reference_point(F.lit(1), F.lit(2), F.lit(3), F.lit(9))) is None


def test_parse_time_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert one(spark.range(1), TM.parse_time(F.lit("2024-01-10 00:00:00"))) == 1_704_844_800 * SEC
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_grid_cells_clamped(spark):
    g = G.Grid(0.0, 0.0, 8.0)
    df = spark.createDataFrame([(-1.0,), (0.0,), (3.99,), (4.0,), (8.0,), (9.0,)], "x double")
    got = [r[0] for r in df.select(g.cx("x", 1)).collect()]
    assert got == [0, 0, 0, 1, 1, 1]
    box = df.limit(1).select(*g.cell_box(F.lit(2), F.lit(3), F.lit(1))).first()
    assert tuple(box) == (6.0, 2.0, 8.0, 4.0)


def test_box_predicates(spark):
    j = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 2.0, 0.0, 3.0, 2.0)],
                              "minx double, miny double, maxx double, maxy double, "
                              "b_minx double, b_miny double, b_maxx double, b_maxy double")
    assert one(j, G.envelope_intersects(G.Side(), G.Side("b_")))
    ix = j.select(G.envelope_intersection(G.Side(), G.Side("b_")).alias("i")).first()["i"]
    assert (ix["minx"], ix["maxx"]) == (2.0, 2.0)
    assert one(j, G.envelope_distance(G.Side(), G.Side("b_"))) == 0.0
