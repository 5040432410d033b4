"""Approximate nearest neighbours: a hierarchical navigable small-world graph
per shard, stored as flat neighbour arrays; shard results are merged.

* Equal vectors form one node that keeps its ``top + 1`` smallest ids, so a
  group of copies of any size costs one node and loses no neighbour.
* Nodes are dealt by hash to shards of bounded size.  A node's level is drawn
  from a hash of its id with the usual falling probabilities; a level's graph
  links its nodes to near ones chosen by the diversity rule (a candidate is
  taken if it is nearer to the node than to any one taken before; remaining
  places go to the nearest), in both directions.  Candidates come from an exact
  block-wise comparison inside the shard.
* A search goes greedily down the levels and then widens to a beam of
  ``beam`` nodes on the lowest.  All queries of a block move together.
* Every shard answers every block of queries; a window keeps each query's best.

The measure is the inner product in double precision on the original vectors.
Graph links use it on unit vectors, which gives the same order where vectors
have equal length; searches always use the measure itself.

Defined results: a vector that is null, zero, or holds a null or non-finite
component, or whose length is not that of most vectors, takes no part, as query
or candidate; nor does a row without an id.  Rows repeated under one id count
once.  Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, parts_for, written

TOP = 20
EVERY = 20
SHARD = 4096
#: links per node above the lowest level, where it is twice as many
LINKS = 16
POOL = 64
BEAM = 96
QUERY_BLOCK = 2048


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col(vector)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")) \
        .where("vec_id is not null and v is not null and size(v) > 0") \
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) \
        .where(F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


# ------------------------------------------------------------------- the graph

def levels_of(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    draw = (mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum((-np.log(np.maximum(draw, 1e-300)) / np.log(links)).astype(np.int64), 8)


def choose_links(unit: np.ndarray, nodes: np.ndarray, links: int, pool: int = POOL) -> np.ndarray:
    """Neighbours of each of ``nodes`` among them, -1 where there are fewer."""
    n = len(nodes)
    out = np.full((n, links), -1, np.int32)
    if n < 2:
        return out
    x = unit[nodes]
    pool = min(pool, n - 1)
    for a in range(0, n, 512):
        b = min(a + 512, n)
        near = x[a:b] @ x.T
        near[np.arange(b - a), np.arange(a, b)] = -np.inf
        cand = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        value = np.take_along_axis(near, cand, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        cand, value = np.take_along_axis(cand, order, 1), np.take_along_axis(value, order, 1)
        between = np.einsum("npd,nqd->npq", x[cand], x[cand])
        taken = np.zeros((b - a, pool), bool)
        taken[:, 0] = True
        for k in range(1, pool):
            closer = np.where(taken, between[:, k], -np.inf).max(1)
            taken[:, k] = (value[:, k] > closer) & (taken.sum(1) < links // 2)
        # chosen ones first, then the nearest of the rest
        order = np.argsort(~taken, axis=1, kind="stable")[:, :links]
        picked = nodes[np.take_along_axis(cand, order, 1)]
        out[a:b, :picked.shape[1]] = picked
    return out


def both_ways(table: np.ndarray, nodes: np.ndarray, total: int, links: int, unit: np.ndarray) -> np.ndarray:
    """Links and reverse links of each node, the nearest ``links`` of them after
    its own first half."""
    out = np.full((total, links), -1, np.int32)
    src = np.repeat(nodes, table.shape[1])
    dst = table.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    own = np.tile(np.arange(table.shape[1]), len(nodes))[table.ravel() >= 0]
    first = own < links // 2
    a = np.concatenate([src, dst])
    b = np.concatenate([dst, src]).astype(np.int64)
    prior = np.concatenate([first, np.zeros(len(dst), bool)])
    value = np.einsum("nd,nd->n", unit[a], unit[b])
    order = np.lexsort((-value, ~prior, a))
    a, b = a[order], b[order]
    _, once = np.unique(a * total + b, return_index=True)
    once.sort()
    a, b = a[once], b[once]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    ok = nth < links
    out[a[ok], nth[ok]] = b[ok]
    return out


def build_graph(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """(top level of each node, flat neighbour arrays of all levels end to end:
    the lowest has 2 * links places a node, every other links)."""
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    level = levels_of(ids, links)
    flat = []
    for k in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= k)
        width = links * (2 if k == 0 else 1)
        flat.append(both_ways(choose_links(unit, nodes, width), nodes, len(ids), width, unit).ravel())
    return level, np.concatenate(flat)


def search(queries: np.ndarray, vectors: np.ndarray, level: np.ndarray, flat: np.ndarray,
           links: int = LINKS, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, values) of a beam per query, best first; -1 where there are fewer."""
    n, q = len(vectors), len(queries)
    short = vectors.astype(np.float32)
    ask = queries.astype(np.float32)
    widths = [2 * links] + [links] * int(level.max())
    starts = np.cumsum([0] + [n * w for w in widths])
    at = np.full(q, int(np.argmax(level)))
    value = np.einsum("qd,qd->q", ask, short[at])
    for k in range(int(level.max()), 0, -1):
        table = flat[starts[k]:starts[k + 1]].reshape(n, links)
        live = np.arange(q)
        while len(live):
            near = table[at[live]]
            v = np.einsum("qd,qmd->qm", ask[live], short[near])
            v[near < 0] = -np.inf
            best = v.argmax(1)
            top = v[np.arange(len(live)), best]
            go = top > value[live]
            at[live[go]], value[live[go]] = near[np.arange(len(live)), best][go], top[go]
            live = live[go]
    table = flat[:starts[1]].reshape(n, widths[0])
    beam = min(beam, n)
    node = np.full((q, beam), -1, np.int64)
    val = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    node[:, 0], val[:, 0], done[:, 0] = at, value, False
    seen = np.zeros((q, n), bool)
    seen[np.arange(q), at] = True
    live = np.arange(q)
    while len(live):
        # expand the best node of each beam not expanded yet
        pick = np.where(done[live], -np.inf, val[live]).argmax(1)
        more = ~done[live, pick]
        live, pick = live[more], pick[more]
        if not len(live):
            break
        done[live, pick] = True
        near = table[node[live, pick]]
        new = (near >= 0) & ~seen[live[:, None], near]
        rows, cols = np.nonzero(new)
        seen[live[rows], near[rows, cols]] = True
        v = np.full(near.shape, -np.inf, np.float32)
        v[rows, cols] = np.einsum("nd,nd->n", ask[live[rows]], short[near[rows, cols]])
        all_val = np.concatenate([val[live], v], 1)
        all_node = np.concatenate([node[live], near], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        keep = np.argpartition(-all_val, beam - 1, axis=1)[:, :beam]
        val[live] = np.take_along_axis(all_val, keep, 1)
        node[live] = np.take_along_axis(all_node, keep, 1)
        done[live] = np.take_along_axis(all_done, keep, 1) | ~np.isfinite(val[live])
    node[~np.isfinite(val)] = -1
    order = np.argsort(-val, axis=1, kind="stable")
    return np.take_along_axis(node, order, 1), np.take_along_axis(val, order, 1)


# ------------------------------------------------------------------ on Spark

GRAPH_TYPE = "shard int, n long, dim int, ids binary, members binary, vectors binary, level binary, flat binary"


def _build(links: int):
    def build(key, table):
        rows = table.sort_by("rep")
        ids = rows["rep"].to_numpy()
        vectors = np.array(rows["v"].combine_chunks().flatten()).reshape(len(ids), -1)
        members = rows["members"].to_pylist()
        width = max(len(m) for m in members)
        grid = np.full((len(ids), width), -1, np.int64)
        for k, m in enumerate(members):
            grid[k, :len(m)] = sorted(m)
        level, flat = build_graph(ids, vectors, links)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int64()),
            "dim": pa.array([vectors.shape[1]], pa.int32()), "ids": [ids.tobytes()], "members": [grid.tobytes()],
            "vectors": [vectors.tobytes()], "level": [level.astype(np.int8).tobytes()],
            "flat": [flat.astype(np.int32).tobytes()]})

    return build


def build_index(vectors: DataFrame, top: int = TOP, shard: int = SHARD, links: int = LINKS) -> DataFrame:
    """One row per shard with its graph.  ``vectors`` has vec_id and v."""
    by_copy = Window.partitionBy("v").orderBy("vec_id")
    first = vectors.dropDuplicates(["vec_id"]).withColumn("nth", F.row_number().over(by_copy)) \
        .where(F.col("nth") <= top + 1)  # pre-limited in every task before the shuffle
    nodes = written(first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.collect_list("vec_id").alias("members")),
                    "nodes")
    shards = parts_for(nodes.count(), shard)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(_build(links), GRAPH_TYPE), "graphs")


def _search(top: int, links: int, beam: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(row):
        n, dim = row["n"], row["dim"]
        ids = np.frombuffer(row["query_ids"], np.int64)
        grid = np.frombuffer(row["members"], np.int64).reshape(n, -1)
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        asked = np.frombuffer(row["queries"], np.float64).reshape(len(ids), dim)
        node, _ = search(asked, vectors, np.frombuffer(row["level"], np.int8).astype(np.int64),
                         np.frombuffer(row["flat"], np.int32), links, beam)
        q, k = np.nonzero(node >= 0)
        exact = np.einsum("nd,nd->n", asked[q], vectors[node[q, k]])
        # members of a node share its value; the query itself is not its neighbour
        member = grid[node[q, k]]
        who = np.repeat(q, member.shape[1])
        value = np.repeat(exact, member.shape[1])
        member = member.ravel()
        ok = (member >= 0) & (member != ids[who])
        who, value, member = who[ok], value[ok], member[ok]
        order = np.lexsort((member, -value, who))
        who, value, member = who[order], value[order], member[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        keep = nth < top
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[who[keep]]), pa.array(member[keep]), pa.array(value[keep])], schema=schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield answer({name: batch.column(name)[k].as_py() for name in batch.schema.names})

    return run


def _pack(key, table):
    rows = table.sort_by("vec_id")
    vectors = np.array(rows["v"].combine_chunks().flatten())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()),
                     "query_ids": [rows["vec_id"].to_numpy().tobytes()], "queries": [vectors.tobytes()]})


def nearest(queries: DataFrame, index: DataFrame, top: int = TOP, links: int = LINKS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for every query (vec_id, v)."""
    spark = index.sparkSession
    blocks = parts_for(queries.count(), QUERY_BLOCK)
    shards = index.agg(F.max("shard")).first()[0]
    none = "query_id long, rank int, vec_id long, score double"
    if shards is None:
        return spark.createDataFrame([], none)
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")) \
        .groupBy("block").applyInArrow(_pack, "block int, query_ids binary, queries binary")
    # the stated query set, in blocks, against every shard
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
    met = index.join(asked, "shard").repartition(max(1, blocks * (shards + 1)), "shard", "block").select(
        "n", "dim", "members", "vectors", "level", "flat", "query_ids", "queries")
    found = met.mapInArrow(_search(top, links, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where(F.col("vec_id") % EVERY == 0).dropDuplicates(["vec_id"])
    return nearest(queries, build_index(vectors))
