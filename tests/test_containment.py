"""R rows inside many overlapping boxes meet a bounded number of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SEC, SF01, frame, wkt_frame
from tandem.operators import containment as CT
from tandem.operators import knn as KN
from tandem.sources import fixtures as fx

K, DELTA = 4, 20 * SEC


def scene(n_boxes=1500, n_left=60, seed=3, shuffle_ids=True):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n_boxes) if shuffle_ids else np.arange(n_boxes)
    boxes = []
    for i in range(n_boxes):
        x, y = rng.uniform(0, 60, 2)
        w, h = rng.uniform(20, 40, 2)
        s = int(rng.integers(0, 100))
        boxes.append((int(ids[i]), x, y, x + w, y + h, s, s + int(rng.integers(0, 60))))
    left = [(i, *(p := rng.uniform(20, 80, 2)), *p, 50, 55) for i in range(n_left)]
    left += [(1000 + i, x, y, x + 5, y + 2, 10, 90) for i, (x, y) in enumerate(rng.uniform(0, 130, (20, 2)))]
    return left, boxes


def brute(left, right, k=K):
    out = []
    for l in left:
        near = sorted((float(np.hypot(max(0, r[1] - l[3], l[1] - r[3]), max(0, r[2] - l[4], l[2] - r[4]))), r[0])
                      for r in right if r[5] <= l[6] + 20 and r[6] >= l[5] - 20)[:k]
        out += [(l[0], i, n + 1) for n, (_, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("shuffle_ids", [True, False])
def test_overlapping_boxes(spark, shuffle_ids):
    left, boxes = scene(shuffle_ids=shuffle_ids)
    got = KN.st_knn_join(frame(spark, left), frame(spark, boxes), K, DELTA).collect()
    assert sorted((r.l_id, r.r_id, r["rank"]) for r in got) == brute(left, boxes)


def test_ids_that_follow_place(spark):
    """Small ids stand far away, so the first round settles few rows and later ones more."""
    left, boxes = scene()
    far = [(i, 500 + i, 500, 520 + i, 540, 50, 60) for i in range(-400, 0)]
    got = KN.st_knn_join(frame(spark, left), frame(spark, boxes + far), K, DELTA).collect()
    assert sorted((r.l_id, r.r_id, r["rank"]) for r in got) == brute(left, boxes + far)


def test_pairs_are_bounded_by_the_limit(spark):
    left, boxes = scene(n_boxes=4000, n_left=100)
    L, R = frame(spark, left), frame(spark, boxes)
    plan, right_f = KN.plan_for(L, R, K, DELTA)
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    standing = L.withColumn("_lv", KN._level_for(F.lit(0.0), plan, extent))
    limit = CT.FIRST * K
    pairs = CT.met(standing, right_f, plan, limit)
    cells, own = CT.blocks(right_f, plan, standing.select("_lv").distinct())
    probed = CT.probes(standing, plan, own).groupBy("l_id").count()
    most = pairs.groupBy("l_id").count().join(probed.withColumnRenamed("count", "blocks"), "l_id")
    assert most.where(F.col("count") > F.col("blocks") * (limit + 1)).count() == 0
    inside = sum(b[1] <= l[1] <= b[3] and b[2] <= l[2] <= b[4] for l in left for b in boxes)
    settled, rest = CT.nearest_inside(L, right_f, plan)
    # a point meets a few hundred boxes; the ordinary join is left with rows near the rim only
    assert inside > 300 * 100 and settled.select("l_id").distinct().count() >= 90
    assert KN.candidate_pairs(rest, right_f, plan).count() < 0.3 * KN.candidate_pairs(L, right_f, plan).count()


def test_envelopes_that_overlap_without_touching(spark):
    """Distance 0 is decided by the geometry: inside the envelope of a triangle, not in it."""
    right = [(i, f"POLYGON ((0 0, {40 + i % 7} 0, 0 40, 0 0))", 0, 100) for i in range(60)]
    right += [(100 + i, "POLYGON ((0 0, 50 0, 50 50, 0 50, 0 0))", 0, 100) for i in range(60)]
    left = [(0, "POINT (35 35)", 50, 50), (1, "POINT (2 2)", 50, 50)]
    got = KN.st_knn_join(wkt_frame(spark, left), wkt_frame(spark, right), K, DELTA).collect()
    assert sorted((r.l_id, r.r_id) for r in got) == [(0, 100 + i) for i in range(K)] + [(1, i) for i in range(K)]


def test_points_and_sparse_boxes_skip_the_rounds(spark):
    left, right = fx.pts_left(spark, SF01), fx.pts_right(spark, SF01)
    plan, right_f = KN.plan_for(left, right, K, DELTA)
    assert CT.nearest_inside(left, right_f, plan)[0] is None
    sparse = frame(spark, [(i, 10 * i, 0, 10 * i + 1, 1, 10, 10) for i in range(50)])
    plan, right_f = KN.plan_for(sparse, sparse, K, DELTA)
    assert CT.nearest_inside(sparse, right_f, plan)[0] is None
