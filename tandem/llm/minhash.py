"""MinHash near-dedup.

1. A document is the set of its distinct word shingles.  Documents with equal
   sets form a class; its smallest ``doc_id`` stands for all of them, so a group
   of copies, however large, is one entry from here on.
2. A class gets ``BANDS`` x ``ROWS`` minima of universal hash functions.  Classes
   that agree in all minima of a band share a bucket.  At the threshold a pair
   shares none of the bands with probability under 1e-6.
3. Inside a bucket, signatures are compared in blocks and a pair is taken in
   the first band that it shares.  Pairs whose signatures agree less than the
   threshold allows (five standard deviations below it) are out.  Large buckets
   are dealt out as pairs of blocks, so no task holds one whole.  What leaves
   this step are the members with a candidate there, not the pairs.
4. Those members come to their block pair again with their whole text, and the
   candidates, most similar first, are confirmed on the full shingle sets.  A
   pair that is joined already by links of its block pair is not looked at, so
   a block pair gives fewer links than it has members.
5. Links become components by alternating large-star and small-star steps.

Defined results: words are runs of non-space after A-Z is lower-cased; a text
with fewer words than a shingle is one shingle; without words the set is empty
and links with nothing; rows with null ``doc_id`` are left out of the links, each
returned with a null component and null ``kept``; rows repeated under one ``doc_id`` are one
document, described by the text whose set has the least hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, key_text, lower_ascii, mix, runs_of, slabs, written

WORDS = 5
BANDS, ROWS = 32, 6
#: classes compared with one another in one task
BLOCK = 512


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, end to end and sorted; their offsets."""
    n = len(offsets) - 1
    data = lower_ascii(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    a, b = runs_of(~space, offsets)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = Rolling(data).span(a, b) + (b - a).astype(np.uint64)
    text = np.searchsorted(offsets, a, "right") - 1
    count = np.bincount(text, minlength=n)
    start = np.cumsum(count) - count
    size = np.minimum(count, words)  # words in a shingle of the text
    first = np.arange(len(word)) - start[text] <= (count - size)[text]  # words that start a shingle
    first = np.flatnonzero(first)
    owner = text[first]
    out = size[owner].astype(np.uint64)
    for k in range(words):
        more = k < size[owner]
        out = np.where(more, mix(out * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(first + k, len(word) - 1)]), out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])]
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(n + 1))


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift functions x -> (a x + b) >> 32 with odd a, fixed by rule."""
    a = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    return a, mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))


def signatures(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """uint32 minima, one row per non-empty set."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.empty((len(full), n), np.uint32)
    if len(full):
        a, b = hash_functions(n)
        starts = bounds[:-1][full]
        for k in range(n):
            out[:, k] = np.minimum.reduceat(((hashes * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()),
                  ("signature", pa.binary())])


def _describe(words: int, n: int):
    """One row per document: set size, 128-bit hash of the set, signature (the
    low byte of each minimum)."""

    def run(batches):
        for rows, data, offsets in slabs(batches, limit=2 << 20):
            hashes, bounds = shingles(data, offsets, words)
            size = np.diff(bounds)
            sig = signatures(hashes, bounds, n).astype(np.uint8)
            blob, at, full = sig.tobytes(), 0, size > 0
            set1, set2, packed = [], [], []
            for t in range(len(size)):
                digest = xxhash.xxh3_128_digest(hashes[bounds[t]:bounds[t + 1]].tobytes())
                set1.append(int.from_bytes(digest[:8], "little", signed=True))
                set2.append(int.from_bytes(digest[8:], "little", signed=True))
                packed.append(blob[at * n:(at + 1) * n] if full[t] else None)
                at += int(full[t])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(size), pa.array(set1, pa.int64()), pa.array(set2, pa.int64()),
                 pa.array(packed, pa.binary())], schema=SETS)

    return run


def _band_rows(bands: int, rows: int):
    """(band, bucket, rep): a bucket is the band's bytes of the signature."""
    schema = pa.schema([("bucket", pa.int64()), ("rep", pa.int64())])
    spread = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                sig = _matrix(part.column(1), bands * rows)
                keys = _band_keys(sig, bands, rows)
                bucket = mix(keys ^ spread[None, :])
                rep = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.ravel().view(np.int64)), pa.array(np.repeat(rep, bands))], schema=schema)

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bytes of each band as one number (at most 8 rows a band)."""
    wide = np.zeros((len(sig), bands, 8), np.uint8)
    wide[:, :, :rows] = sig.reshape(len(sig), bands, rows)
    return wide.view(np.uint64)[:, :, 0]


def _block_pairs(batches):
    """The rows of each (bucket, i, j) of a stream sorted by them."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.concat_batches([left, batch])
        key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        for s, e in zip(edges[:-1], edges[1:]):
            yield batch.slice(int(s), int(e - s))
        left = batch.slice(int(edges[-1]))
    if left is not None:
        yield left


class Comparison:
    """Candidates of a block pair: members (as row numbers) that take their
    first common band here, agree in enough minima and are near in size."""

    def __init__(self, bands: int, rows: int, least_agree: int, least_share: float):
        self.bands, self.rows, self.least_agree, self.least_share = bands, rows, least_agree, least_share
        self.spread = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def candidates(self, group: pa.RecordBatch):
        """(x, y, agreeing minima) arrays."""
        bucket, i, j = (group.column(k)[0].as_py() for k in range(3))
        block, size = group.column(3).to_numpy(), group.column(5).to_numpy()
        sig = _matrix(group.column(6), self.bands * self.rows)
        keys = _band_keys(sig, self.bands, self.rows)
        here = int(np.argmax(mix(keys[0] ^ self.spread) == np.uint64(bucket & (2**64 - 1))))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = [(np.zeros(0, np.int64),) * 3]
        for x in left:
            y = right[right > x] if i == j else right
            y = y[np.minimum(size[x], size[y]) >= self.least_share * np.maximum(size[x], size[y])]
            if here and len(y):
                y = y[~(keys[y, :here] == keys[x, :here]).any(1)]
            if len(y):
                agree = (sig[y] == sig[x]).sum(1)
                good = agree >= self.least_agree
                out.append((np.full(int(good.sum()), x), y[good], agree[good]))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


MEMBER_TYPE = "bucket long, i int, j int, block int, rep long"


def _with_candidates(comparison: Comparison):
    """The members of each block pair that have a candidate there."""
    schema = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()),
                        ("rep", pa.int64())])

    def run(batches):
        found = []
        for group in _block_pairs(batches):
            if group.num_rows > 1:
                x, y, _ = comparison.candidates(group)
                if len(x):
                    found.append(group.select(range(5)).take(pa.array(np.union1d(x, y))))
            if len(found) >= 500:
                yield pa.concat_batches(found).cast(schema)
                found = []
        if found:
            yield pa.concat_batches(found).cast(schema)

    return run


def _links(comparison: Comparison, words: int, percent: int):
    """Links (a, b) of each block pair that join what was not joined there yet."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for group in _block_pairs(batches):
            if group.num_rows < 2:
                continue
            sets = []
            for _, data, offsets in slabs(iter([group])):
                hashes, bounds = shingles(data, offsets, words)
                sets += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            x, y, agree = comparison.candidates(group)
            rep, parent, a, b = group.column(4).to_numpy(), list(range(group.num_rows)), [], []

            def root(k):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for k in np.argsort(-agree, kind="stable"):
                p, q = root(int(x[k])), root(int(y[k]))
                if p == q:
                    continue
                one, two = sets[x[k]], sets[y[k]]
                both = len(one) + len(two) - len(np.union1d(one, two))
                if both and 100 * both >= percent * (len(one) + len(two) - both):
                    parent[p] = q
                    a.append(rep[x[k]])
                    b.append(rep[y[k]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def links(docs: DataFrame, classes: DataFrame, percent: int, words: int = WORDS,
          bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Links (a, b) among the classes, enough to join all that are joined by
    similarities of ``percent`` and more.  ``classes`` has rep, n_shingles,
    signature; ``docs`` the texts."""
    n, similarity = bands * rows, percent / 100
    spread = (similarity * (1 - similarity) / n) ** 0.5
    comparison = Comparison(bands, rows, max(1, int(np.floor(n * (similarity - 5 * spread)))), similarity)
    keyed = classes.select("rep", "signature").mapInArrow(_band_rows(bands, rows), "bucket long, rep long")
    members = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(members, "bucket"), "bands")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = shared.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # every pair of blocks with this one
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         "block", "rep")
    pair = ["bucket", "i", "j"]
    described = classes.select("rep", "n_shingles", "signature")

    def met(rows_of_pairs, extra=()):
        return rows_of_pairs.select(*pair, "block", "rep", "n_shingles", "signature", *extra) \
            .repartition(*pair).sortWithinPartitions(*pair)

    involved = written(met(dealt.join(described, "rep")).mapInArrow(_with_candidates(comparison), MEMBER_TYPE), "involved")
    # both sides grow with the documents, so the join is never planned as a broadcast
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")
    with_text = texts.join(involved.join(described, "rep").hint("merge"), "rep")
    return met(with_text, ["text"]).mapInArrow(_links(comparison, words, percent), "a long, b long")


def connected_components(found: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for the nodes of ``found``
    (links a, b), by alternating large-star and small-star until nothing changes."""
    edges = written(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), "edges")
    state = None
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u and u itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(documents: DataFrame, percent: int = 85, words: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest document with the same set),
    component_id (smallest document reachable over links of ``percent`` and
    more), kept (the component's representative)."""
    docs = key_text(documents)
    everything = written(docs.mapInArrow(
        _describe(words, bands * rows),
        "doc_id long, n_shingles long, set1 long, set2 long, signature binary"), "sets")
    described = everything.where("doc_id is not null")
    sets = ["set1", "set2", "n_shingles"]
    classes = written(described.where("n_shingles > 0").groupBy(*sets).agg(
        F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    found = written(connected_components(links(docs, classes, percent, words, bands, rows)), "components")

    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        *sets, F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    # one row per id; of different texts under one id the one with the least set hash
    one = described.groupBy("doc_id").agg(F.min(F.struct(*sets)).alias("s")).select("doc_id", "s.*")
    out = one.join(named, sets, "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
    none = F.lit(None).cast("long")
    out = out.unionByName(everything.where("doc_id is null").select(
        "doc_id", "n_shingles", none.alias("class_id"), none.alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(documents: DataFrame, percent: int = 80, words: int = WORDS,
                bands: int = 38, rows: int = 5) -> DataFrame:
    """``documents`` (all columns) with one document of each near-duplicate group:
    the smallest ``doc_id``.  Rows without id or without words stay."""
    gone = near_duplicates(documents, percent, words, bands, rows).where("not kept").select(
        F.col("doc_id").alias("__gone"))
    return documents.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT u AS node, u AS met FROM edge
  UNION SELECT reach.node, edge.v FROM reach JOIN edge ON edge.u = reach.met),
least_met AS (SELECT node, min(met) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_met ON node = d.doc_id
"""
