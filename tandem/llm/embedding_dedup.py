"""Embedding near-dedup: product quantisation with an exact answer.

Vectors of one label are linked where their cosine is at least 0.98, that is where their unit
vectors are at most ``r = sqrt(2 - 2 * 0.98)`` apart.

* Equal vectors of a label are one node with a count, so copies of any number cost one node.
* A coarse quantiser (k-means on a bounded sample, ``SAMPLE`` unit vectors) assigns every node to an
  inverted list; the residual is stored as one code per subspace (product quantiser, fitted on
  the same sample) with the length of what the codes leave (``error``).
* **Sufficient probes**: a neighbour of x in list B lies beyond the plane between B's centroid
  and that of x's own list, so x probes exactly the lists whose plane is at most r away.
* **Asymmetric distances**: one table of inner products of the query's subvectors with the
  codewords gives the distance to every coded vector of a list; a pair with distance less
  ``error`` over r can't link.  The rest is compared by cosine in double precision.
  Both bounds are strict, so no link is lost, whatever the sample was.
* Lists of a label are packed into blocks of at most ``BLOCK`` nodes, larger lists into several.
  A node is sent to the later blocks it probes; a task holds one block and streams the others past
  it.  It returns numbers of links per node and a spanning forest of the links, never
  the pairs.  Components come from the forests by large-star and small-star.

Defined results: a vector that is null, empty, zero, holds a null or non-finite component, or
has not the length most vectors have, and one without a label, links with nothing and is its own component.
Every row counts as a vector, also a repeated one, and rows without id, which have a null
component (and null ``kept``) unless they link to one with an id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .minhash import connected_components
from .vectors import finite, matrix

COSINE = 0.98
SAMPLE = 16384
BLOCK = 8192
MAX_LISTS = 1024
#: components of a subspace, and codewords of each
WIDTH = 8
WORDS = 128
#: pairs whose distances stand in memory at once
PAIRS = 1 << 20
SLACK = 1e-6
NODE = "label long, node long, many long, v array<double>, home int, probes array<int>"


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


# ------------------------------------------------------------------ quantisers

def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centroids of x; the first ones are spread evenly over its rows."""
    centres = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), 1)


class Quantiser:
    """Coarse centroids and, per subspace, the codewords of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        self.radius = radius + SLACK
        self.coarse = k_means(sample, lists)
        between = self.coarse[:, None] - self.coarse[None]
        self.apart = np.sqrt(np.einsum("abd,abd->ab", between, between))
        dim = sample.shape[1]
        self.parts = [slice(a, min(a + WIDTH, dim)) for a in range(0, dim, WIDTH)]
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.words = [k_means(np.ascontiguousarray(residual[:, p]), WORDS) for p in self.parts]

    def homes(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list of every vector, lists it must probe as a boolean matrix)."""
        far = (self.coarse ** 2).sum(1) - 2 * (u @ self.coarse.T)
        home = far.argmin(1)
        # distance to the plane between the own centroid and another one
        beyond = far - far[np.arange(len(u)), home][:, None]
        return home, beyond <= 2 * self.radius * self.apart[home]

    def codes(self, u: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, offset, error): |x - coded|^2 = |x - centroid|^2 + offset - 2 x . codewords."""
        residual = u - self.coarse[home]
        codes = np.stack([nearest(residual[:, p], w) for p, w in zip(self.parts, self.words)], 1)
        coded = np.concatenate([w[codes[:, m]] for m, w in enumerate(self.words)], 1)
        offset = np.einsum("nd,nd->n", coded, coded) + 2 * np.einsum("nd,nd->n", coded, self.coarse[home])
        return codes, offset, np.sqrt(((residual - coded) ** 2).sum(1))

    def tables(self, u: np.ndarray) -> list[np.ndarray]:
        return [u[:, p] @ w.T for p, w in zip(self.parts, self.words)]


class Block:
    """The nodes of one block in inverted lists."""

    def __init__(self, quantiser: Quantiser, v: np.ndarray, home: np.ndarray):
        self.q, self.u = quantiser, unit(v)
        self.codes, self.offset, self.error = quantiser.codes(self.u, home)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order])) + 1
        self.lists = {int(home[rows[0]]): rows for rows in np.split(order, cuts)} if len(home) else {}

    def links(self, u: np.ndarray, cosine: float):
        """(queries, nodes) arrays of the pairs at or above the cosine, list by list."""
        _, probes = self.q.homes(u)
        tables = self.q.tables(u)
        for cell, rows in self.lists.items():
            asking = np.flatnonzero(probes[:, cell])
            base = ((u[asking] - self.q.coarse[cell]) ** 2).sum(1)
            limit = (self.q.radius + self.error[rows]) ** 2 - self.offset[rows]
            step = max(1, PAIRS // len(rows))
            for a in range(0, len(asking), step):
                who = asking[a:a + step]
                shared = np.zeros((len(who), len(rows)))
                for m, table in enumerate(tables):
                    shared += table[who][:, self.codes[rows, m]]
                q, n = np.nonzero(base[a:a + step, None] - 2 * shared <= limit + SLACK)
                q, n = who[q], rows[n]
                exact = np.einsum("nd,nd->n", u[q], self.u[n])
                yield q[exact >= cosine], n[exact >= cosine]


class Forest:
    """Components of the nodes of a block: ``root`` names the smallest position of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links a - b; returns the joins made, at most one for every node that was a root."""
        high, low = [], []
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return np.concatenate([*high, a[:0]]), np.concatenate([*low, a[:0]])
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            hooked = np.unique(np.maximum(x, y))
            high.append(hooked)
            low.append(self.root[hooked])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


# --------------------------------------------------------------------- on Spark

def nodes_of(vectors: DataFrame) -> DataFrame:
    """label, node, many, v: distinct vectors of a label; vectors has key, label, v."""
    return vectors.groupBy("label", "v").agg(F.min("key").alias("node"), F.count("*").alias("many")) \
        .select("label", "node", "many", "v")


def fit(nodes: DataFrame, dim: int, radius: float) -> Quantiser:
    """Quantisers from at most ``SAMPLE`` nodes, those with the smallest hashes."""
    n = nodes.count()
    sample = nodes.select("v").orderBy(F.xxhash64("v"), "node").limit(SAMPLE).toArrow().column("v").combine_chunks()
    return Quantiser(unit(matrix(sample, dim)), min(MAX_LISTS, max(1, math.isqrt(n))), radius)


def _assigned(quantiser: Quantiser, dim: int):
    def run(batches):
        for batch in batches:
            home, probes = quantiser.homes(unit(matrix(batch.column("v"), dim)))
            who, lists = np.nonzero(probes)
            offsets = np.searchsorted(who, np.arange(len(home) + 1))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("label", "node", "many", "v")], pa.array(home.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(lists.astype(np.int32)))],
                names=["label", "node", "many", "v", "home", "probes"])

    return run


def blocked(assigned: DataFrame, block: int = BLOCK) -> DataFrame:
    """label, block, guest, node, many, v, home: every node in its own block and, as a guest, in the
    later blocks that hold a list it probes."""
    # lists of a label are packed one after the other; at most MAX_LISTS rows a label
    lists = assigned.groupBy("label", "home").agg(F.count("*").alias("n")).groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("home", "n"))).alias("lists"))
    packed = F.aggregate(
        "lists", F.expr("cast(array() as array<struct<home:int,first:bigint,blocks:bigint,filled:bigint>>)"),
        lambda done, x: F.concat(done, F.array(_placed(done, x, block))))
    # places by list number: an array is read at a position, a map is searched; null where a label lacks the list
    places = F.map_from_entries(F.transform(packed, lambda p: F.struct(p["home"], F.struct(p["first"], p["blocks"]))))
    lists = lists.withColumn("known", places).select(
        "label", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("known"))), lambda c: F.col("known")[c]).alias("places"),
        F.array_max(F.transform(F.map_values("known"), lambda p: p["first"] + p["blocks"] - 1)).alias("last"))
    placed = assigned.join(lists, "label")
    own = F.get("places", F.col("home"))
    # a list of several blocks deals its nodes by hash
    place = own["first"] + F.pmod(F.xxhash64("node"), own["blocks"])
    known = F.filter(F.transform("probes", lambda c: F.get("places", c)), lambda p: p.isNotNull())
    met = F.flatten(F.transform(known, lambda p: F.sequence(p["first"], p["first"] + p["blocks"] - 1)))
    met = F.when(F.col("place") < F.col("last"), met).otherwise(F.array().cast("array<bigint>"))
    targets = F.array_union(F.array(F.col("place")), F.filter(met, lambda b: b > F.col("place")))
    return placed.withColumn("place", place).select("label", "node", "many", "v", "home", "place", F.explode(targets).alias("block")) \
        .select("label", "block", (F.col("block") != F.col("place")).alias("guest"), "node", "many", "v", "home")


def _placed(done, x, block: int):
    """Where the next list goes: into the last block if it still fits, else into blocks of its own."""
    last = F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(
        F.struct(F.lit(0).alias("home"), F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("blocks"),
                 F.lit(0).cast("long").alias("filled")))
    fits = last["filled"] + x["n"] <= block
    own = F.ceil(x["n"] / F.lit(block)).cast("long")
    fresh = F.when(last["filled"] > 0, last["first"] + last["blocks"]).otherwise(last["first"])
    return F.struct(
        x["home"].alias("home"), F.when(fits, last["first"] + last["blocks"] - 1).otherwise(fresh).alias("first"),
        F.when(fits, F.lit(1)).otherwise(own).cast("long").alias("blocks"),
        F.when(fits, last["filled"] + x["n"]).when(own > 1, F.lit(block)).otherwise(x["n"]).cast("long").alias("filled"))


FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _compared(quantiser: Quantiser, dim: int, cosine: float):
    """Rows in order of block, hosts first.  Out: (node, links, null) and forest edges (node, null, other)."""
    def counted(node, links):
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.nulls(int(some.sum()), pa.int64())],
                                          schema=FOUND)

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64())],
                                          schema=FOUND)

    def hosts(rows):
        node = np.concatenate([r[0] for r in rows])
        many = np.concatenate([r[1] for r in rows])
        block = Block(quantiser, np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]))
        forest, links, high, low = Forest(len(node)), np.zeros(len(node), np.int64), [], []
        for q, n in block.links(block.u, cosine):
            other = q != n
            q, n = q[other], n[other]
            np.add.at(links, q, many[n])
            a, b = forest.join(q, n)
            high.append(node[a])
            low.append(node[b])
        return (node, many, block, forest, links), edges(np.concatenate([*high, node[:0]]), np.concatenate([*low, node[:0]]))

    def guests(state, node, many, v):
        own, weight, block, forest, links = state
        found, joined = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)]
        for q, n in block.links(unit(v), cosine):
            np.add.at(found, q, weight[n])
            np.add.at(links, n, many[q])
            joined.append(np.unique(q * len(own) + forest.root[n]))
        who, root = np.divmod(np.unique(np.concatenate(joined)), len(own))
        return found, edges(node[who], own[root])

    def run(batches):
        key, waiting, state = None, [], None
        for batch in batches:
            label, place = batch.column("label").to_numpy(), batch.column("block").to_numpy()
            guest = batch.column("guest").to_numpy(zero_copy_only=False)
            node, many = batch.column("node").to_numpy(), batch.column("many").to_numpy()
            v, home = matrix(batch.column("v"), dim), batch.column("home").to_numpy()
            cuts = np.flatnonzero((np.diff(label) != 0) | (np.diff(place) != 0) | (guest[1:] != guest[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(node)]):
                if a == b:
                    continue
                if key != (label[a], place[a]):
                    if waiting:
                        state, joins = hosts(waiting)
                        yield joins
                    if state:
                        yield counted(state[0], state[4])
                    key, waiting, state = (label[a], place[a]), [], None
                if not guest[a]:
                    waiting.append((node[a:b], many[a:b], v[a:b], home[a:b]))
                    continue
                if waiting:
                    state, joins = hosts(waiting)
                    yield joins
                    waiting = []
                if state:
                    found, joins = guests(state, node[a:b], many[a:b], v[a:b])
                    yield counted(node[a:b], found)
                    yield joins
        if waiting:
            state, joins = hosts(waiting)
            yield joins
        if state:
            yield counted(state[0], state[4])

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (vec_id, embedding, label)."""
    spark = rows.sparkSession
    # every row has a number; the least of a set of equal vectors names their node
    numbered = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"),
                                   F.monotonically_increasing_id().alias("number")), "vectors")
    vectors = finite(numbered, extra=(F.col("label"), F.col("number").alias("key"))).where(
        F.col("label").isNotNull() & F.exists("v", lambda c: c != 0))
    first = vectors.first()
    out = numbered.select("vec_id", "number")
    if first is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    dim = len(first["v"])
    nodes = written(nodes_of(vectors), "nodes")
    quantiser = fit(nodes, dim, math.sqrt(max(0.0, 2 - 2 * cosine)))
    assigned = written(nodes.mapInArrow(_assigned(quantiser, dim), NODE), "assigned")
    met = blocked(assigned, block).repartition("label", "block").sortWithinPartitions("label", "block", "guest", "node")
    found = written(met.mapInArrow(_compared(quantiser, dim, cosine), "node long, links long, other long"), "found")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    # what each row belongs to: its vector's node, that node's component, its smallest id
    belongs = vectors.join(nodes.select("label", "v", "node", "many"), ["label", "v"]).select("key", "node", "many", "vec_id") \
        .join(joined, "node", "left").join(links, "node", "left") \
        .select("key", "vec_id", F.coalesce("component", "node").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"))
    belongs = written(belongs, "belongs")
    least = belongs.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    placed = belongs.join(least, "component").select("key", "links", "component_id")
    return out.join(placed, F.col("number") == F.col("key"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE usual AS (
  SELECT len(embedding) AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
e AS (
  SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (
  SELECT k, vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM e, usual
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) = d AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0),
link AS (
  SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach AS (
  SELECT a AS k, a AS met FROM link UNION SELECT reach.k, link.b FROM reach JOIN link ON link.a = reach.met),
least_met AS (SELECT reach.k, min(vec_id) AS component_id FROM reach JOIN e ON e.k = reach.met GROUP BY 1),
n AS (SELECT a AS k, count(*) AS n_links FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links,
       CASE WHEN n.k IS NULL THEN e.vec_id ELSE component_id END AS component_id,
       e.vec_id = CASE WHEN n.k IS NULL THEN e.vec_id ELSE component_id END AS kept
FROM e LEFT JOIN n ON n.k = e.k LEFT JOIN least_met ON least_met.k = e.k
"""
