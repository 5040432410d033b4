"""Loading with rejects in one pass (S1, V1), equi-depth bins (A2, A3), stored layout."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SEC, frame, wkt_frame
from tandem.operators import bins as B
from tandem.operators.knn import st_knn_query
from tandem.session import shared_dir
from tandem.sources.layout import layout_knn_query, layout_partitions, read_layout, write_layout
from tandem.sources.tsv import VALID, load_wkt_tsv, read_wkt_tsv, write_wkt_tsv

T0, T1 = "2024-01-01 00:00:00", "2024-01-01 00:00:05"


# ------------------------------------------------------------ S1 / V1

def _lines(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id bigint, value string")


def test_load_separates_rejects_and_counts_them(spark):
    bad = {"abc\t" + T0 + "\t" + T1: "malformed geometry", "POINT EMPTY\t" + T0 + "\t" + T1: "empty geometry",
           "POINT (1 2)\tsoon\t" + T1: "null time", "POINT (1 2)\t" + T0: "null time", "POINT (1 2)": "null time",
           "POINT (1 2)\t2024-13-01 00:00:00\t" + T1: "null time", "POINT (1 2)\t" + T1 + "\t" + T0: "start after end",
           "POINT (1e999 2)\t" + T0 + "\t" + T1: "infinite coordinate", "": "malformed geometry"}
    good = ["POINT (1 2)\t" + T0 + "\t" + T1] * 2 + ["LINESTRING (0 0, 3 4)\t" + T0 + "\t" + T0 + "\textra"]
    got = load_wkt_tsv(spark, _lines(spark, [*bad, *good, None]), id_col="id")
    assert [r["id"] for r in got.rows.orderBy("id").collect()] == [9, 10, 11]
    rejected = got.rejected.collect()
    assert {r["line"]: r["problem"] for r in rejected} == {**bad, None: "malformed geometry"}
    assert {p: n for p, n in got.counts.items() if n} == {
        VALID: 3, "malformed geometry": 3, "empty geometry": 1, "null time": 4, "start after end": 1, "infinite coordinate": 1}
    assert sum(got.counts.values()) == 13


def test_load_reads_one_partition_per_side(spark):
    got = load_wkt_tsv(spark, _lines(spark, ["POINT (1 2)\t" + T0 + "\t" + T1, "x"]), id_col="id")
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "problem" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(got.rows.inputFiles()) == 2  # inputFiles lists the table's files; the filter leaves one
    assert got.rows.select(F.input_file_name()).distinct().count() == 1


def test_load_files_equals_strict_reader_and_empty_input(spark):
    base = shared_dir(spark, "t-load")
    write_wkt_tsv(wkt_frame(spark, [(i, f"POINT ({i} {i})", i, i + 1) for i in range(50)]), base)
    cols = ["kind", "minx", "miny", "start_us", "end_us"]
    a, b = load_wkt_tsv(spark, base), read_wkt_tsv(spark, base)
    assert sorted(map(tuple, a.rows.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    assert a.rows.columns == b.columns and a.rows.select("id").distinct().count() == 50
    none = load_wkt_tsv(spark, _lines(spark, []), id_col="id")
    assert none.rows.count() == 0 and none.rejected.count() == 0 and sum(none.counts.values()) == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_load_times_do_not_depend_on_the_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:  # 02:30 does not exist in New York on that day
        got = load_wkt_tsv(spark, _lines(spark, ["POINT (1 2)\t2024-03-10 02:30:00\t2024-03-10 02:30:01"]), id_col="id")
        assert [r["start_us"] for r in got.rows.collect()] == [1_710_037_800 * SEC]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# ------------------------------------------------------------ A2 / A3

def _skewed(spark, n, seed):
    """Two groups and a null one; nearly all intervals of one lie in a thousandth of its range."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(1000) if i % 50 else rng.randrange(1_000_000)
        rows.append((i, ["a", "b", None][i % 3], s, s + rng.randrange(30)))
    return rows, spark.createDataFrame(rows, "id bigint, grp string, start_us bigint, end_us bigint")


def test_equi_depth_bound_is_valid_and_tighter_on_skew(spark):
    rows, df = _skewed(spark, 1500, 5)
    rng = random.Random(6)
    qs = [(i, ["a", "b", None][i % 3], a, a + rng.randrange(400)) for i, a in
          enumerate([rng.randrange(-50, 1050) for _ in range(60)] + [-10**6, 10**7, 0, 999_999])]
    queries = spark.createDataFrame(qs, "id bigint, grp string, start_us bigint, end_us bigint")
    cuts = B.equi_depth_cuts(df, ["grp"], 32)
    bins = B.equi_depth_bins(df, cuts, ["grp"], 32)
    got = {r["id"]: r for r in B.equi_depth_bound(queries, bins, cuts, 10, 5, ["grp"]).collect()}
    true = {i: sum(g == h and s <= c + 10 and e >= a - 10 for _, h, s, e in rows) for i, g, a, c in qs}
    assert got.keys() == true.keys()
    assert all(r["lower_bound"] <= true[i] and r["has_k"] == (r["lower_bound"] >= 5) for i, r in got.items())
    spec = B.bin_spec(df, 32)
    some = [q for q in qs if q[1]]  # the equal-width form joins groups by plain equality
    width = B.overlap_count_bound(queries, B.interval_bins(df, spec, ["grp"]), spec, 10, 5, ["grp"]).collect()
    assert sum(r["lower_bound"] for r in width) * 5 < sum(got[q[0]]["lower_bound"] for q in some)
    # two bins' rows at most are lost beyond what lies outside
    assert all(true[i] - r["lower_bound"] <= 2 * (500 // 32 + 15) for i, r in got.items())


def test_equi_depth_bins_ties_nulls_and_empty(spark):
    rows = [(1, 7, 7)] * 40 + [(2, 1, 9), (2, None, 5), (2, 5, None)]
    df = spark.createDataFrame(rows, "grp int, start_us bigint, end_us bigint")
    cuts = B.equi_depth_cuts(df, ["grp"], 4)
    bins = B.equi_depth_bins(df, cuts, ["grp"], 4)
    by = {(r["grp"], r["bin"]): (r["n_start"], r["n_end"], r["total"]) for r in bins.collect()}
    assert len(by) == 8 and by[1, 1] == (40, 40, 40) and by[1, 0] == (0, 0, 40) and by[2, 1] == (1, 1, 1)
    q = spark.createDataFrame([(1, 1, 7, 7), (2, 1, 8, 9), (3, 9, 0, 9)], "id bigint, grp int, start_us bigint, end_us bigint")
    got = {r["id"]: r["lower_bound"] for r in B.equi_depth_bound(q, bins, cuts, 0, 1, ["grp"]).collect()}
    assert got == {1: 40, 2: 0}
    none = df.where("false")
    c0 = B.equi_depth_cuts(none, ["grp"], 4)
    assert B.equi_depth_bins(none, c0, ["grp"], 4).count() == 0


# ------------------------------------------------------------ J4

def _layout_rows(seed, n=600):
    """Points, wide boxes and long intervals; a third of all rows in one small spot."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (50 + rng.random(), 50 + rng.random()) if i % 3 == 0 else (rng.uniform(-100, 100), rng.uniform(-100, 100))
        w = rng.uniform(0, 60) if i % 10 == 1 else 0.0
        s = rng.randrange(1000)
        rows.append((i, x, y, x + w, y + w, s, s + (rng.randrange(800) if i % 7 == 0 else rng.randrange(20))))
    return rows


@pytest.mark.parametrize("k,ring", [(1, 1), (7, 2), (40, 8), (2000, 3)])
def test_layout_query_equals_full_scan(spark, k, ring):
    df = frame(spark, _layout_rows(1)).withColumn("note", F.concat(F.lit("n"), F.col("id")))
    path = write_layout(df, shared_dir(spark, "t-layout"), 100 * SEC, 10.0, rows_per_file=100)
    assert read_layout(spark, path).count() == 600
    for x, y, a, c in [(50.5, 50.5, 100, 120), (-300, 20, 0, 5000), (0, 0, 999, 999), (0, 0, -50, -40)]:
        got = layout_knn_query(spark, path, x, y, a * SEC, c * SEC, k, 5 * SEC, first_ring=ring)
        want = st_knn_query(df, x, y, a * SEC, c * SEC, k, 5 * SEC).collect()
        assert [(r["id"], r["dist"], r["note"]) for r in got.result.collect()] == [(r["id"], r["dist"], r["note"]) for r in want]


def test_layout_query_reads_few_partitions(spark):
    path = write_layout(frame(spark, _layout_rows(2)), shared_dir(spark, "t-layout"), 100 * SEC, 10.0)
    all_parts = layout_partitions(spark, path).count()
    got = layout_knn_query(spark, path, 50.5, 50.5, 400 * SEC, 410 * SEC, 5)
    assert got.partitions * 10 < all_parts and got.of < all_parts
    text = got.result._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("DataFilters")[0].split("PushedFilters")[0]
    assert "period" in filters and "tile" in filters
    files = read_layout(spark, path).select(F.input_file_name().alias("f")).distinct().count()
    assert got.result.count() == 5 and files >= all_parts


def test_layout_query_filter_limit_ties_and_empty(spark):
    rows = [(i, 1, 1, 0, 10) for i in range(20)] + [(100 + i, 40 * i, 0, 0, 10) for i in range(10)]
    df = frame(spark, rows)
    path = write_layout(df, shared_dir(spark, "t-layout"), 100 * SEC, 5.0)
    ask = dict(x=1, y=1, start_us=0, end_us=SEC, k=3)
    assert [r["id"] for r in layout_knn_query(spark, path, **ask).result.collect()] == [0, 1, 2]
    odd = layout_knn_query(spark, path, **ask, candidate_filter=F.col("id") > 105, first_ring=1)
    assert [r["id"] for r in odd.result.collect()] == [106, 107, 108]
    near = layout_knn_query(spark, path, 1, 1, 0, SEC, 100, max_distance=45.0)
    assert near.result.count() == 22
    empty = write_layout(df.where("false"), shared_dir(spark, "t-layout"), SEC, 1.0)
    assert layout_knn_query(spark, empty, **ask).result.count() == 0


def test_layout_keeps_geometry_and_refuses_clashing_names(spark):
    df = wkt_frame(spark, [(1, "LINESTRING (0 0, 100 0)", 0, 5), (2, "POINT (50 3)", 0, 5), (3, "POINT (50 90)", 0, 5)])
    path = write_layout(df, shared_dir(spark, "t-layout"), SEC, 1.0)
    got = layout_knn_query(spark, path, 50.0, 1.0, 2 * SEC, 3 * SEC, 2, first_ring=1).result.collect()
    assert [(r["id"], r["dist"]) for r in got] == [(1, 1.0), (2, 2.0)]
    with pytest.raises(ValueError):
        write_layout(df.withColumn("tile", F.lit(1)), shared_dir(spark, "t-layout"), SEC, 1.0)
