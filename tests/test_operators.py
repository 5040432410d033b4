"""Filters, validation, bins, tiling, joins and sources on small inputs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SEC, frame
from tandem.functions import geometry as G
from tandem.operators import bins as B
from tandem.operators import filters as FL
from tandem.operators import joins as J
from tandem.operators import knn as KN
from tandem.operators import tiling as TL
from tandem.sources import results as RS
from tandem.sources.tsv import read_wkt_tsv, write_wkt_tsv


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_validation_modes(spark):
    df = frame(spark, [(1, 0, 0, 0, 0, 5, 9), (2, 0, 0, 0, 0, 9, 5)])
    flagged = {r["id"]: r["problem"] for r in FL.validate_rows(df, "flag").collect()}
    assert flagged == {1: None, 2: "start after end"}
    assert ids(FL.validate_rows(df, "permissive")) == [1]
    assert ids(FL.validate_rows(df, "rejected")) == [2]
    with pytest.raises(Exception):
        FL.validate_rows(df, "strict").collect()


def test_time_filters(spark):
    df = frame(spark, [(1, 0, 0, 10, 20), (2, 0, 0, 20, 30), (3, 0, 0, 31, 40), (4, 0, 0, 5, 9)])
    assert ids(FL.interval_overlap_filter(df, 20 * SEC, 30 * SEC)) == [1, 2]
    assert ids(FL.bound_contains_time_filter(df, 10 * SEC, 20 * SEC)) == [1]
    assert ids(FL.bound_contains_range_filter(df, 9 * SEC, 31 * SEC)) == [1, 2]


def test_space_filters(spark):
    df = frame(spark, [(1, 0, 0, 1, 1, 0, 0), (2, 5, 5, 6, 6, 0, 0), (3, 1, 1, 1, 1, 0, 0)])
    assert ids(FL.envelope_intersects_filter(df, (1, 1, 2, 2))) == [1, 3]
    assert ids(FL.bound_contains_point_filter(df, (0, 0, 1, 1))) == [1]     # half-open
    assert ids(FL.bound_contains_envelope_filter(df, (0, 0, 1, 1))) == [1, 3]


def test_right_prefilter(spark):
    left = frame(spark, [(1, 0, 0, 100, 110)])
    right = frame(spark, [(1, 0, 0, 0, 89), (2, 0, 0, 0, 90), (3, 0, 0, 120, 130), (4, 0, 0, 121, 130)])
    assert ids(FL.right_prefilter(right, left, 10 * SEC)) == [2, 3]


def test_interval_bins_and_bound(spark):
    s = frame(spark, [(i, 0, 0, 10 * i, 10 * i + 15) for i in range(10)])
    spec = B.bin_spec(s, 10)
    bins = B.interval_bins(s, spec).orderBy("bin").collect()
    assert sum(r["n_start"] for r in bins) == 10 and bins[-1]["ends_le"] == 10 and bins[0]["starts_ge"] == 10
    q = frame(spark, [(100, 0, 0, 40, 40)])
    got = B.overlap_count_bound(q, B.interval_bins(s, spec), spec, 0, 1).first()
    exact = sum(1 for i in range(10) if 10 * i <= 40 <= 10 * i + 15)
    assert 0 <= got["lower_bound"] <= exact


def test_interval_overlap_join(spark):
    left = frame(spark, [(1, 0, 0, 0, 100), (2, 0, 0, 500, 500)])
    right = frame(spark, [(10, 0, 0, 50, 60), (11, 0, 0, 90, 200), (12, 0, 0, 101, 105), (13, 0, 0, 505, 505)])
    got = sorted((r["l_id"], r["r_id"]) for r in J.interval_overlap_join(left, right, 5 * SEC, bin_us=7 * SEC).collect())
    assert got == [(1, 10), (1, 11), (1, 12), (2, 13)]


def test_distance_join(spark):
    left = frame(spark, [(1, 0, 0, 0, 0), (2, 50, 50, 0, 0)])
    right = frame(spark, [(10, 1, 0, 0, 0), (11, 3, 0, 0, 0), (12, 0, 0, 0, 0, 100, 100), (13, 50, 51, 5, 5)])
    got = sorted((r["l_id"], r["r_id"]) for r in KN.st_distance_join(left, right, 2.0, 5 * SEC).collect())
    assert got == [(1, 10), (2, 13)]


def test_time_periods_cover(spark):
    s = frame(spark, [(i, 0, 0, 10 * i, 10 * i + 3) for i in range(200)])
    p = TL.time_periods(s, 10, 2, 3, 0).orderBy("period").collect()
    assert p[0]["p_start"] == 0 and p[-1]["p_end"] == (1990 + 3) * SEC + 1
    assert all(a["p_end"] == b["p_start"] for a, b in zip(p, p[1:]))
    assert sum(r["n"] for r in p) == 200


def test_quad_tiles_cover_root(spark):
    pts = frame(spark, [(i, (i * 37) % 100, (i * 53) % 100, 0, 0) for i in range(500)])
    grid = TL.grid_for(pts)
    tiles = TL.quad_tiles(pts, grid, 8, 2, 5).collect()
    area = sum((t["maxx"] - t["minx"]) * (t["maxy"] - t["miny"]) for t in tiles)
    assert abs(area - grid.side * grid.side) < 1e-6
    assert sum(t["n"] for t in tiles) == 500
    numbered = TL.cell_numbering(spark.createDataFrame(tiles))
    looked = J.assign_to_tiles(pts, numbered, grid, 5)
    assert looked.count() == 500 and looked.select("id").distinct().count() == 500


def test_cell_assign_replicates(spark):
    df = frame(spark, [(1, 0, 0, 3, 0.5, 0, 0)])
    got = TL.cell_assign(df, G.Grid(0.0, 0.0, 4.0), 2, 10 * SEC).collect()
    assert sorted((r["cx"], r["cy"]) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_sample_fraction():
    assert TL.sample_fraction(10, 10) == 1.0
    f = TL.sample_fraction(100, 100000)
    assert 0.001 < f < 0.002


def test_tsv_roundtrip_and_results(spark):
    from conftest import wkt_frame
    src = wkt_frame(spark, [(1, "POINT (1.5 2.0)", 100, 160), (2, "LINESTRING (0.0 0.0, 2.0 1.0)", 50, 50)])
    base = tempfile.mkdtemp(prefix="tandem-test-")
    path = os.path.join(base, "in")
    write_wkt_tsv(src, path)
    back = read_wkt_tsv(spark, path).orderBy("start_us").collect()
    assert [(r["kind"], r["start_us"], r["end_us"]) for r in back] == [
        ("LINESTRING", 50 * SEC, 50 * SEC), ("POINT", 100 * SEC, 160 * SEC)]
    res = KN.st_knn_join(frame(spark, [(0, 0, 0, 100, 100)]), src, 2, 100 * SEC, nested=True)
    stored = RS.store_and_reload(res)
    assert stored.count() == 1
    geo = RS.geojson_collections(stored, right_has_geom=True).first()["geojson"]
    assert geo.startswith('{"type": "FeatureCollection"') and '"LineString"' in geo
    assert RS.sample_results(stored, 5, seed=3).count() == 1


def test_periods_of_any_size_with_gaps_and_hot_spots(spark):
    """Uneven periods (long, short, gaps) against brute force; rows outside all of them meet none."""
    import numpy as np
    rng = np.random.default_rng(12)
    cuts = np.unique(np.concatenate([rng.integers(0, 10_000, 60), rng.integers(5000, 5050, 40)])).tolist()
    periods = [(10 * i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if i % 9]
    rows = [(i, 0.0, 0.0, 0.0, 0.0, int(s), int(s + w)) for i, (s, w) in enumerate(
        zip(rng.integers(-500, 11_000, 300), rng.integers(0, 800, 300) * (rng.random(300) < .5)))]
    P = spark.createDataFrame(periods, "period int, p_start bigint, p_end bigint")
    R = spark.createDataFrame(rows, "id bigint, minx double, miny double, maxx double, maxy double, start_us bigint, end_us bigint")
    for delta in (0, 25):
        want = sorted((r[0], p[0]) for r in rows for p in periods if r[5] - delta < p[2] and r[6] + delta >= p[1])
        assert sorted((x.id, x.period) for x in TL.periods_for_range(R, P, delta).collect()) == want
    n = {p[0]: sum(p[1] <= r[5] < p[2] for r in rows) for p in periods}
    assert {x.period: x.n for x in TL.period_density(R, P).collect()} == n
    none = P.where("period < 0")
    assert TL.periods_for_range(R, none).count() == TL.period_density(R, none).count() == 0


def test_loaded_ids_do_not_follow_the_input_split(spark, tmp_path):
    """Ids are written once: another split size, or other files later, changes nothing."""
    path = str(tmp_path / "lines")
    text = spark.range(3000).selectExpr("concat('POINT (', id, ' 1)\t2024-01-01 00:00:00\t2024-01-01 00:00:01') AS value")
    text.repartition(3).write.text(path)
    rows = read_wkt_tsv(spark, path)
    first = {r["id"]: r["minx"] for r in rows.select("id", "minx").collect()}
    assert sorted(first.values()) == [float(i) for i in range(3000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        text.limit(10).write.mode("append").text(path)
        assert {r["id"]: r["minx"] for r in rows.select("id", "minx").collect()} == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
