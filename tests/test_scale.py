"""Steps whose cost must follow the input: no broadcast of multiplied rows, few columns in wide shuffles."""

import re

from conftest import SF001
from tandem.functions import geometry as G
from tandem.operators import knn as KN
from tandem.plans.catalog import QUERIES, geometry_frame
from tandem.sources import fixtures as fx

DAY = 86_400_000_000


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_multiplied_rows_are_not_broadcast(spark):
    """The files below a generator say nothing about its rows."""
    left, right = fx.pts_left(spark, SF001), fx.pts_right(spark, SF001)
    plan, right_f = KN.plan_for(left, right, 5, DAY)
    text = plan_text(KN._bound_hits(left, right_f, plan, 5))
    assert "BroadcastHashJoin [_lv" not in text and "SortMergeJoin [_lv" in text


def test_top_k_shuffles_ids_alone(spark):
    """Boxes, intervals and payload join the k best rows instead of going through the rounds."""
    res = KN.st_knn_join(fx.pts_left(spark, SF001), fx.pts_right(spark, SF001), 5, DAY)
    text = res._jdf.queryExecution().optimizedPlan().toString()
    project = re.search(r"Project \[(.*)\]", text[text.index("Window ["):]).group(1)
    while "(" in project:
        project = re.sub(r"\([^()]*\)", "", project)
    assert {c.split(" AS ")[-1].split("#")[0] for c in project.split(", ")} == {"l_id", "r_id", "dist"}


def test_geometry_is_computed_once_a_row(spark):
    """A centroid sums its rings once, not once per use of the sums."""
    plan = geometry_frame(spark, SF001).select(G.centroid(G.Side("", True)).alias("c"))
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.split("Project [")[1].count("aggregate(") <= 24


def test_costly_rows_are_dealt(spark):
    """A file of one row group is read by one task; the work on its rows is not."""
    for name in ("multipolygon", "wkt_collections", "centroid"):
        assert "RepartitionByExpression" in QUERIES[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()


def test_decontamination_does_not_shuffle_texts(spark):
    from tandem.llm.decontam import drop_contaminated
    docs = spark.createDataFrame([(i, " ".join(f"w{j + i % 2 * 100}" for j in range(20)), "x") for i in range(40)],
                                 "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([("a", " ".join(f"w{j}" for j in range(3, 14)))], "item_id string, text string")
    kept = drop_contaminated(docs, items)
    assert "hashpartitioning" not in plan_text(kept)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(1, 40, 2))
