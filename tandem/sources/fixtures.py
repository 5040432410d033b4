"""Spatio-temporal frames derived from the shared test tables.

Each builder reads one or two parquet tables of ``sf_dir`` and projects them
to the frame layout of ``tandem.model``; the work grows with the tables.

Fixed values that define the mapping (see FIXTURES.md):
  events: x = value, y = the number under key "k" of the JSON text in props,
  time = ts; left rows are event_type 'purchase', right rows 'view'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import MICROS_PER_DAY, epoch_us, epoch_us_ntz
from ..model import point_frame

# Event kinds used as the left and right inputs.
LEFT_EVENT = "purchase"
RIGHT_EVENT = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _event_points(spark, sf_dir, event_type: str | None) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    if event_type is not None:
        ev = ev.where(F.col("event_type") == event_type)
    y = F.get_json_object("props", "$.k").cast("double")
    return point_frame(ev, "event_id", "value", y, "ts", payload=["user_id"])


def pts_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_points(spark, sf_dir, LEFT_EVENT)


def pts_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_points(spark, sf_dir, RIGHT_EVENT)


def all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_points(spark, sf_dir, None)


def _boxes(points: DataFrame, period_us: int) -> DataFrame:
    """Group points per user and period: envelope, [min t, max t], id = min id."""
    period = F.floor(F.col("start_us") / F.lit(period_us)).cast("bigint")
    return (points.groupBy("user_id", period.alias("period"))
            .agg(F.min("id").alias("id"), F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                 F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
                 F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
            .select("id", "minx", "miny", "maxx", "maxy", "start_us", "end_us", "user_id"))


def box_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views per user and day."""
    return _boxes(pts_right(spark, sf_dir), MICROS_PER_DAY)


def box_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases per user and 4-day period."""
    return _boxes(pts_left(spark, sf_dir), 4 * MICROS_PER_DAY)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events per user and day."""
    return _boxes(all_points(spark, sf_dir), MICROS_PER_DAY)


def wide_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views per user over 16 days: boxes that overlap heavily."""
    return _boxes(pts_right(spark, sf_dir), 16 * MICROS_PER_DAY)


def user_lines(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Each user's events of one type as a line in time order (id = user; a point
    for a single event)."""
    pts = _event_points(spark, sf_dir, event_type)
    step = F.struct("start_us", "id", F.struct(F.col("minx").alias("x"), F.col("miny").alias("y")).alias("p"))
    path = F.transform(F.array_sort(F.collect_list(step)), lambda s: s["p"])
    lines = pts.groupBy(F.col("user_id").alias("id")).agg(
        path.alias("pts"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return lines.select("id", F.when(F.size("pts") > 1, "LINESTRING").otherwise("POINT").alias("kind"), "pts",
                        F.array(F.lit(0)).alias("parts"), F.array().cast("array<int>").alias("shells"),
                        "minx", "miny", "maxx", "maxy", "start_us", "end_us")


def long_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals [first ship date, last ship date], no geometry
    (x = y = 0), id = l_orderkey."""
    li = table(spark, sf_dir, "lineitem")
    t = epoch_us(li, "l_shipdate")
    return (li.groupBy(F.col("l_orderkey").alias("id"))
            .agg(F.min(t).alias("start_us"), F.max(t).alias("end_us"))
            .select("id", F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"),
                    F.lit(0.0).alias("maxx"), F.lit(0.0).alias("maxy"), "start_us", "end_us"))


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as intervals [order date, ship date]; about half end before
    they start.  Box = (l_quantity, l_discount) point."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return j.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber"),
                    F.col("l_quantity").alias("minx"), F.col("l_discount").alias("miny"),
                    F.col("l_quantity").alias("maxx"), F.col("l_discount").alias("maxy"),
                    epoch_us_ntz("o_orderdate").alias("start_us"),
                    epoch_us_ntz("l_shipdate").alias("end_us"))


def vec_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points (elements 1 and 2), all at time 0."""
    em = table(spark, sf_dir, "embeddings")
    x = F.get("embedding", 1).cast("double")
    y = F.get("embedding", 2).cast("double")
    return em.select(F.col("vec_id").cast("bigint").alias("id"), x.alias("minx"), y.alias("miny"),
                     x.alias("maxx"), y.alias("maxy"), F.lit(0).cast("bigint").alias("start_us"),
                     F.lit(0).cast("bigint").alias("end_us"), F.col("label"))


def wkt_lines(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    """Events written in the tab-separated text layout ``WKT \\t start \\t end``
    (column ``value``, as ``spark.read.text`` gives it), plus the event id."""
    ev = table(spark, sf_dir, "events")
    if event_type is not None:
        ev = ev.where(F.col("event_type") == event_type)
    y = F.get_json_object("props", "$.k").cast("double")
    wkt = F.format_string("POINT (%s %s)", F.col("value").cast("string"), y.cast("string"))
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ev.select(F.col("event_id").alias("id"),
                     F.concat_ws("\t", wkt, t, t).alias("value"))
