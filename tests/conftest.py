import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SEC = 1_000_000


@pytest.fixture(scope="session")
def spark():
    from tandem.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app="tandem-tests")
    yield s


def frame(spark, rows):
    """Box frame from (id, minx, miny, maxx, maxy, start_s, end_s) tuples
    (times in seconds); a 5-tuple (id, x, y, start_s, end_s) is a point."""
    full = []
    for r in rows:
        if len(r) == 5:
            i, x, y, s, e = r
            full.append((i, float(x), float(y), float(x), float(y), s * SEC, e * SEC))
        else:
            i, x0, y0, x1, y1, s, e = r
            full.append((i, float(x0), float(y0), float(x1), float(y1), s * SEC, e * SEC))
    return spark.createDataFrame(
        full, "id bigint, minx double, miny double, maxx double, maxy double, start_us bigint, end_us bigint")


def wkt_frame(spark, rows):
    """Geometry frame from (id, wkt, start_s, end_s)."""
    from pyspark.sql import functions as F
    from tandem.functions import geometry as G
    from tandem.functions.wkt import parse_wkt
    df = spark.createDataFrame([(i, w, s * SEC, e * SEC) for i, w, s, e in rows],
                               "id bigint, wkt string, start_us bigint, end_us bigint")
    p = df.select("id", "start_us", "end_us", parse_wkt(F.col("wkt")).alias("g"))
    minx, miny, maxx, maxy = G.envelope(F.col("g.pts"))
    return p.select("id", F.col("g.kind").alias("kind"), F.col("g.pts").alias("pts"),
                    F.col("g.parts").alias("parts"), F.col("g.shells").alias("shells"), minx.alias("minx"), miny.alias("miny"),
                    maxx.alias("maxx"), maxy.alias("maxy"), "start_us", "end_us")
