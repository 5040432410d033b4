"""A stored spatio-temporal table and the single kNN query over it.

``write_layout`` writes a frame as Parquet partitioned by ``period`` (of the start) and
``tile`` (grid cell of the envelope's lower corner).  Inside a partition rows are dealt to files by range of
position, so a partition that holds a third of all rows is many files, each of a
small area.  A second, small table keeps each partition's true space-time envelope and row
count; rows longer than a period or wider than a cell widen it, so no row is copied.

``layout_knn_query`` visits partitions in rings of rising distance: the partitions table is asked
for the next few nearest ones that can overlap the query's window, and only these are scanned (partition
filters), until the k-th distance so far lies below the distance of every partition
left.  The answer is that of the full scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.time import floor_div, overlaps
from ..model import check_frame
from ..operators.filters import valid_rows

#: partitions of the first ring; every further ring doubles the number
FIRST_RING = 8
ROWS_PER_FILE = 1_000_000
#: a partition's distance less this share is below that of its rows, whatever the rounding
ROUNDING = 1e-9


@dataclass
class Search:
    result: DataFrame
    partitions: int  # scanned
    of: int          # that can overlap the window
    rings: int


def _paths(path: str) -> tuple[str, str, str]:
    return tuple(f"{path.rstrip('/')}/{name}" for name in ("rows", "partitions", "columns"))


def write_layout(frame: DataFrame, path: str, period_us: int, cell: float, rows_per_file: int = ROWS_PER_FILE,
                 invalid: str = "drop") -> str:
    """Store a frame (all its columns) for ``layout_knn_query``: periods of ``period_us``, square cells of side
    ``cell``.  Invalid rows are left out, or fail the job under ``invalid="fail"``."""
    check_frame(frame)
    if {"period", "tile"} & set(frame.columns):
        raise ValueError("columns period and tile are the layout's own")
    rows_path, parts_path, columns_path = _paths(path)

    def place(c):  # clamped, so that both numbers fit in one
        return F.greatest(F.least(F.floor(F.col(c) / F.lit(float(cell))), F.lit(2**30 - 1)), F.lit(-(2**30))).cast("bigint")

    placed = valid_rows(frame, invalid).withColumn("period", floor_div("start_us", period_us)) \
        .withColumn("tile", place("minx") * F.lit(2**31) + place("miny") + F.lit(2**30))
    placed.limit(0).write.parquet(columns_path)  # an empty table has columns too
    files = max(1, -(-placed.count() // rows_per_file))
    placed.repartitionByRange(files, "period", "tile", "minx", "miny", "id") \
        .sortWithinPartitions("period", "tile", "minx", "miny", "id").write.partitionBy("period", "tile").parquet(rows_path)
    spark = frame.sparkSession
    spark.read.schema(placed.schema).parquet(rows_path).groupBy("period", "tile").agg(
        *[F.min(c).alias(c) for c in ("minx", "miny", "start_us")],
        *[F.max(c).alias(c) for c in ("maxx", "maxy", "end_us")], F.count(F.lit(1)).alias("n")).write.parquet(parts_path)
    return path


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """The stored frame with its partition columns ``period, tile``."""
    return spark.read.schema(spark.read.parquet(_paths(path)[2]).schema).parquet(_paths(path)[0])


def layout_partitions(spark: SparkSession, path: str) -> DataFrame:
    """One row per partition: ``period, tile``, its space-time envelope, ``n``."""
    return spark.read.parquet(_paths(path)[1])


def _at(partitions) -> Column:
    """Filter on the partition columns alone."""
    tiles: dict[int, list[int]] = {}
    for period, tile in partitions:
        tiles.setdefault(period, []).append(tile)
    out = F.lit(False)
    for period, some in sorted(tiles.items()):
        out = out | ((F.col("period") == period) & F.col("tile").isin(some))
    return out


def layout_knn_query(spark: SparkSession, path: str, x: float, y: float, start_us: int, end_us: int, k: int,
                     delta_us: int = 0, max_distance: float | None = None, candidate_filter: Column | None = None,
                     first_ring: int = FIRST_RING) -> Search:
    """J4 over a stored table: the result of ``st_knn_query`` (stored columns, ``dist``; nearest first, ties by id).

    The driver holds the numbers of the partitions scanned and k distances.  With a ``candidate_filter`` the rings
    go on until k rows pass it.  An empty table, or no row in the window, gives no rows."""
    from ..operators.knn import st_knn_query
    rows = read_layout(spark, path)
    q = G.LitBox(float(x), float(y), float(x), float(y))
    near = layout_partitions(spark, path).where(
        overlaps(F.lit(start_us - delta_us), F.lit(end_us + delta_us), F.col("start_us"), F.col("end_us"))) \
        .select("period", "tile", (G.envelope_distance(q, G.Side("")) * (1 - ROUNDING)).alias("least"))
    of = near.count()
    if max_distance is not None:
        near = near.where(F.col("least") <= max_distance)

    def search(partitions):
        return st_knn_query(rows.where(_at(partitions)), x, y, start_us, end_us, k, delta_us, max_distance,
                            candidate_filter).drop("period", "tile")

    seen, best, size, rings = [], [], first_ring, 0
    while True:
        left = near
        if seen:  # the next ones in the order (distance, period, tile)
            last = seen[-1]
            left = near.where(F.struct("least", "period", "tile") > F.struct(
                F.lit(last["least"]), F.lit(last["period"]).cast("bigint"), F.lit(last["tile"]).cast("bigint")))
        if len(best) == k:
            left = left.where(F.col("least") <= best[-1])
        ring = left.orderBy("least", "period", "tile").limit(size).collect()
        if not ring:
            break
        rings += 1
        seen += ring
        found = search([(r["period"], r["tile"]) for r in ring]).select("dist").collect()
        best = sorted(best + [r["dist"] for r in found])[:k]
        size *= 2
    # only partitions that can hold one of the k
    held = [(r["period"], r["tile"]) for r in seen if len(best) < k or r["least"] <= best[-1]]
    return Search(search(held), len(seen), of, rings)
