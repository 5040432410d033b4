"""kNN join under a candidate predicate (U1) without knowing how many rows it rejects.

Counts bound the distance of the ``need`` nearest rows, whatever a predicate then
makes of them.  So R meets its ``need`` nearest first, and only the R rows with fewer
than k survivors among them come again, with ``need`` ``GROWTH`` times as large:

    round 1   every R row, its 2 k nearest
    round 2   the R rows still short of k survivors, their 8 k nearest
    ...

An R row whose predicate rejects m rows before the k-th survivor takes about log4(m / k)
rounds and meets O(m + k) rows, instead of every row of its time window.

The predicate sees all columns of both inputs.  Where those it needs are a few numbers (and
there is no geometry), they go through the joins and every pair within the bound is judged as it arises:
only survivors are ranked, at most k of an R row are kept, and what is met beyond the ``need``
nearest counts too.  An R row is complete when it has k survivors, or when it has no bound
(then it has met every candidate).  Of many copies ``need`` are met and the next one is a marker: what lies behind it is
not certain.

Else only keys, envelopes and geometry go through the joins: the other columns join the
``need`` nearest by id.  An R row is complete when k of them survive, or when it has fewer than
``need`` candidates at all.

Every round is written to the shared folder, so a lost executor repeats one round at
most; only the number of R rows left reaches the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, NumericType, StructField, StructType, TimestampNTZType, TimestampType

from ..model import KEY_COLUMNS, has_geometry, prefixed
from ..session import stored
from . import knn as KN

FIRST = 2       # times k: rows met in the first round
GROWTH = 4
FIXED = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)   # columns that may go through the joins


def resolves(predicate: Column, columns: DataFrame) -> bool:
    """Whether the predicate needs no column but those of ``columns``."""
    try:
        columns.where(predicate)
        return True
    except AnalysisException:
        return False


def judged(nearest: DataFrame, left: DataFrame, right: DataFrame, predicate: Column) -> DataFrame:
    """(l_id, r_id, dist) of ``nearest`` with ``ok``: whether the pair passes the
    predicate over all columns of both inputs."""
    slim = nearest.select("l_id", "r_id", "dist")
    full = slim.join(KN.keyed(prefixed(left, "l_")), "l_id").join(KN.keyed(prefixed(right, "r_")), "r_id")
    return full.select("l_id", "r_id", "dist", F.coalesce(predicate, F.lit(False)).alias("ok"))


def carried(left: DataFrame, right: DataFrame, predicate: Column) -> tuple[list[str], list[str]] | None:
    """The columns besides the keys that the predicate needs, by side; None if they are too wide to stand in every
    cell (or geometry is there)."""
    if has_geometry(left) or has_geometry(right):
        return None
    every = {p + f.name: f.dataType for df, p in ((left, "l_"), (right, "r_")) for f in df.schema.fields}
    every["dist"] = DoubleType()

    def without(name):
        # an empty frame of its own: a projection's child would still resolve the dropped column
        fields = [StructField(c, kind) for c, kind in every.items() if c != name]
        return left.sparkSession.createDataFrame([], StructType(fields))

    sides = []
    for df, p in ((left, "l_"), (right, "r_")):
        sides.append([])
        for c in df.columns:
            if c in KEY_COLUMNS:
                continue
            # a column the text of the predicate names is not tried: Spark logs each failure
            if p + c not in str(predicate) and resolves(predicate, without(p + c)):
                every.pop(p + c)
            elif isinstance(df.schema[c].dataType, FIXED):
                sides[-1].append(c)
            else:
                return None
    return sides[0], sides[1]


def marked_copies(right: DataFrame, need: int) -> DataFrame:
    """``dedup_copies`` of ``need`` rows each and the next one, ``_more``."""
    keys = [c for c in KEY_COLUMNS if c != "id"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return right.withColumn("_copy", nth).where(F.col("_copy") <= need + 1) \
        .withColumn("_more", F.col("_copy") > need).drop("_copy")


def _judged_at_once(pending: DataFrame, once: DataFrame, plan: KN.KnnPlan, k: int, need: int,
                    predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(l_id, r_id, dist, ok) of each R row's first k survivors and markers, and the ids of the R rows still short."""
    bounded = stored(pending.join(KN.knn_bound(pending, once, plan, need=need), "id", "left"), "bounds")
    ok = F.coalesce(predicate, F.lit(False)) & ~F.col("r__more")
    met = KN.candidate_pairs(pending, once, plan, None, need, copies_done=True, bounded=bounded) \
        .select("l_id", "r_id", "dist", ok.alias("ok"), F.col("r__more").alias("_more")).where("ok or _more")
    pairs = stored(KN.top_k(met.drop("_more"), k).drop("rank"), "round")
    good = pairs.groupBy("l_id").agg(F.sum(F.col("ok").cast("int")).alias("good"), F.count(F.lit(1)).alias("n"))
    state = bounded.select(F.col("id").alias("l_id"), F.col("bound").isNull().alias("all")).join(good, "l_id", "left")
    done = (F.coalesce("good", F.lit(0)) >= k) | (F.col("all") & (F.coalesce("good", F.lit(0)) == F.coalesce("n", F.lit(0))))
    return pairs, stored(state.where(~done).select("l_id"), "short")


def _judged_after(pending: DataFrame, once: DataFrame, plan: KN.KnnPlan, k: int, need: int, left: DataFrame,
                  right: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(l_id, r_id, dist, ok) of each R row's ``need`` nearest, and the ids of the R rows still short."""
    nearest = KN.top_k(KN.candidate_pairs(pending, once, plan, None, need, copies_done=True, store=True, ids_only=True)
                       .select("l_id", "r_id", "dist"), need)
    pairs = stored(judged(nearest, left, right, predicate), "round")
    met = pairs.groupBy("l_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("good"))
    return pairs, stored(met.where((F.col("n") >= need) & (F.col("good") < k)).select("l_id"), "short")


def rounds(left: DataFrame, right: DataFrame, slim_left: DataFrame, slim_right: DataFrame, plan: KN.KnnPlan, k: int,
           predicate: Column, first: int = FIRST, growth: int = GROWTH) -> list[tuple[int, DataFrame, DataFrame]]:
    """Per round: (need, judged pairs, ids of the R rows still short of k survivors)."""
    out, need = [], first * k
    extra = carried(left, right, predicate)
    with_left, with_right = slim_left, slim_right
    if extra is not None:
        def joined(slim, whole, columns):
            # a column that is there already needs no join
            more = [c for c in columns if c not in slim.columns]
            return stored(slim.join(KN.keyed(whole.select("id", *more)), "id"), "carried") if more else slim
        with_left, with_right = joined(slim_left, left, extra[0]), joined(slim_right, right, extra[1])
    pending = with_left
    while True:
        at_once = extra is not None
        if at_once:
            once = stored(marked_copies(with_right, need), "once")
            at_once = not KN.has_crowds(once, plan, need)
        if at_once:
            pairs, short = _judged_at_once(pending, once, plan, k, need, predicate)
        else:
            once = stored(KN.dedup_copies(slim_right, need), "once")
            pairs, short = _judged_after(pending.select(*slim_left.columns), once, plan, k, need, left, right, predicate)
        out.append((need, pairs, short))
        if short.isEmpty():
            return out
        need *= growth
        pending = with_left.join(short, F.col("id") == F.col("l_id"), "left_semi")


def filtered_nearest(left: DataFrame, right: DataFrame, slim_left: DataFrame, slim_right: DataFrame, plan: KN.KnnPlan,
                     k: int, predicate: Column) -> DataFrame:
    """(l_id, r_id, dist, rank): the k nearest that pass the predicate."""
    found = None
    for _, pairs, short in rounds(left, right, slim_left, slim_right, plan, k, predicate):
        done = pairs.where("ok").join(short, "l_id", "left_anti")
        found = done if found is None else found.unionByName(done)
    return KN.top_k(found.select("l_id", "r_id", "dist"), k)
