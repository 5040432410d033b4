"""Candidate predicates without a known number of rejected rows, and the pyramid's roll-up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SEC, frame
from tandem.functions import geometry as G
from tandem.model import KEY_COLUMNS
from tandem.operators import knn as KN
from tandem.operators import widening as WD

DELTA = 50 * SEC


def points(spark, n, seed, tags=7):
    rng = np.random.default_rng(seed)
    rows = [(i, *rng.uniform(0, 100, 2), *([int(rng.integers(0, 1000))] * 2)) for i in range(n)]
    return frame(spark, rows).withColumn("tag", (F.col("id") * 31 % tags).cast("int")), rows


def brute(left, right, ok, k):
    out = {}
    for l in left:
        near = sorted((float(np.hypot(l[1] - r[1], l[2] - r[2])), r[0]) for r in right
                      if r[3] <= l[4] + 50 and r[4] >= l[3] - 50 and ok(l[0], r[0]))[:k]
        if near:
            out[l[0]] = [i for _, i in near]
    return out


def ids(result):
    out = {}
    for r in result.orderBy("l_id", "rank").collect():
        out.setdefault(r["l_id"], []).append(r["r_id"])
    return out


def test_unknown_rejections_over_payload(spark):
    left, lrows = points(spark, 60, 1)
    right, rrows = points(spark, 3000, 2)
    got = ids(KN.st_knn_join(left, right, 4, DELTA, pair_filter=F.col("l_tag") == F.col("r_tag")))
    assert got == brute(lrows, rrows, lambda a, b: a * 31 % 7 == b * 31 % 7, 4)


def test_rows_whose_candidates_are_all_rejected(spark):
    left, lrows = points(spark, 20, 3)
    right, rrows = points(spark, 500, 4)
    got = ids(KN.st_knn_join(left, right, 3, DELTA, pair_filter=(F.col("l_id") < 10) & (F.col("r_id") % 100 == 0)))
    assert got == brute(lrows, rrows, lambda a, b: a < 10 and b % 100 == 0, 3)
    assert KN.st_knn_join(left, right, 3, DELTA, pair_filter=F.lit(False)).count() == 0
    assert KN.st_knn_join(left, right, 3, DELTA, pair_filter=F.lit(None).cast("boolean")).count() == 0


def test_copies_of_which_the_first_are_rejected(spark):
    """Copies beyond the k-th may be needed when the ones before are rejected."""
    right = [(i, 1, 1, 100, 100) for i in range(1, 200)] + [(500, 2, 2, 100, 100), (501, 9, 9, 100, 100)]
    left = [(0, 0, 0, 100, 100), (1, 1, 1, 100, 100)]
    got = ids(KN.st_knn_join(frame(spark, left), frame(spark, right), 3, DELTA, pair_filter=F.col("r_id") >= 150))
    assert got == {0: [150, 151, 152], 1: [150, 151, 152]}


def test_empty_inputs(spark):
    left, _ = points(spark, 5, 5)
    none = left.where("id < 0")
    for a, b in ((left, none), (none, left), (none, none)):
        assert KN.st_knn_join(a, b, 3, DELTA, pair_filter=F.col("l_tag") == F.col("r_tag")).count() == 0


def test_slack_over_payload_needs_one_round(spark):
    left, lrows = points(spark, 30, 6)
    right, rrows = points(spark, 400, 7)
    right = right.withColumn("bad", F.col("id").isin(5, 6, 7))
    got = ids(KN.st_knn_join(left, right, 4, DELTA, pair_filter=~F.col("r_bad"), pair_filter_slack=3))
    assert got == brute(lrows, rrows, lambda a, b: b not in (5, 6, 7), 4)


def test_pairs_stay_far_below_all_pairs(spark):
    """Half of R finds its k survivors at once; the pairs met are a small part of all pairs in time,
    and each round holds only the R rows still short."""
    left, lrows = points(spark, 200, 8)
    right, rrows = points(spark, 5000, 9)
    slim_l, slim_r = left.select(*KEY_COLUMNS), right.select(*KEY_COLUMNS)
    plan, right_f = KN.plan_for(slim_l, slim_r, 4, DELTA)
    tag = (F.col("l_id") % 2 == 0) | (F.col("l_tag") == F.col("r_tag"))
    done = WD.rounds(left, right, slim_l, right_f, plan, 4, tag)
    everything = sum(r[3] <= l[4] + 50 and r[4] >= l[3] - 50 for l in lrows for r in rrows)
    met = sum(pairs.count() for _, pairs, _ in done)
    assert [need for need, _, _ in done] == [8 * 4 ** i for i in range(len(done))] and len(done) >= 2
    assert met < 0.25 * everything
    left_over = [short.count() for _, _, short in done]
    assert left_over[0] <= 100 and left_over[-1] == 0 and left_over == sorted(left_over, reverse=True)


@pytest.mark.parametrize("lo,hi", [(0, 0), (0, 4), (0, 15), (3, 9), (8, 30)])
def test_roll_up_counts_every_level(spark, lo, hi):
    rng = np.random.default_rng(10)
    xy = np.concatenate([rng.uniform(0, 100, (300, 2)), rng.uniform(50, 50 + 1e-6, (200, 2)), [[0, 0], [100, 100]] * 3])
    rows = frame(spark, [(i, *p, s, s + 40) for i, (p, s) in enumerate(zip(xy, rng.integers(0, 500, len(xy)).tolist()))])
    grid = G.Grid(0.0, 0.0, 100.0)
    plan, _ = KN.plan_for(rows, rows, 3, 20 * SEC)
    plan = KN.replace(plan, grid=grid)
    got = {(r._lv, r._cx, r._cy, r._tl, r._b): r._n for r in KN._pyramid_keys(rows, plan, lo, hi).collect()}
    one_by_one = {}
    for level in range(lo, hi + 1):
        for r in KN._pyramid_keys(rows, plan, level, level).collect():
            one_by_one[r._lv, r._cx, r._cy, r._tl, r._b] = r._n
    assert got == one_by_one
    deepest = sum(n for (lv, *_), n in got.items() if lv == hi)
    assert all(sum(n for (lv, *_), n in got.items() if lv == level) == deepest for level in range(lo, hi + 1))


def test_rows_before_the_first_aggregate_do_not_grow_with_depth(spark):
    """S rows are exploded to their time bins only; levels are exploded from counts."""
    rows, _ = points(spark, 2000, 11)
    plan, _ = KN.plan_for(rows, rows, 3, 20 * SEC)
    text = KN._pyramid_keys(rows.select(*KEY_COLUMNS), plan, 0, 12)._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.rindex("Aggregate"):]
    assert "_cx" in below and "sequence(" in below and "_up" not in below and "_lv" not in below
