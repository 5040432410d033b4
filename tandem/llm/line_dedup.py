"""Line dedup through a sharded minimal perfect hash.

1. Every document sends its distinct line keys as 128-bit hashes; a grouped
   aggregate (partial sums before the shuffle) keeps those of two or more
   documents, with their count and smallest ``doc_id``.
2. The keys are dealt to shards of bounded size.  Each shard builds a minimal
   perfect hash (levels of bit arrays; a key takes the first level where no
   other key of the shard meets it) that indexes three flat arrays:
   fingerprint, document count and smallest document.
3. Documents send (key, document, line) probes to the shards.  A shard's
   arrays are read once, then its probes stream past them: no join of lines.
   Probes are salted, so a line held by a third of all rows is probed in many
   tasks.
4. Line numbers to drop return to their documents.

Defined results: null or empty text is one empty line; a key shorter than
``min_chars`` is never dropped; a row with null ``doc_id`` is kept whole and
takes no part; rows with one ``doc_id`` count as one document when documents are
counted, but each row loses its own lines only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, key_text, mix, parts_for, written

#: white space stripped from both ends of a line (fixed values of the contract)
SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 50_000
PROBES_PER_TASK = 250_000
GAMMA = 1.6


def _keys(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def _lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[bytes], bytes]]:
    ids = batch.column(0).to_pylist()
    data, offsets = buffers(batch.column(1))
    whole = data.tobytes()
    for i, doc in enumerate(ids):
        text = whole[offsets[i]:offsets[i + 1]]
        yield doc, text.lower().split(b"\n"), text  # bytes.lower() is A-Z only


def _hash_lines(every_line: bool, min_chars: int):
    """Rows (h1, h2, doc_id) with each distinct key once, or (h1, h2, doc_id, line, row) with
    each line; documents come as doc_id, text, row."""
    fields = [("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())]
    if every_line:
        fields += [("line", pa.int32()), ("row", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            digests, docs, numbers, rows = [], [], [], []
            row_of = batch.column(2).to_pylist()
            for at, (doc, lines, _) in enumerate(_lines_of(batch)):
                if doc is None:
                    continue
                seen = set()
                for n, line in enumerate(lines):
                    key = _keys(line, min_chars)
                    if key is None or (not every_line and key in seen):
                        continue
                    if not every_line:
                        seen.add(key)
                    digests.append(xxhash.xxh3_128_digest(key))
                    docs.append(doc)
                    numbers.append(n)
                    rows.append(row_of[at])
                if len(docs) >= 200_000:
                    yield _probe_batch(schema, digests, docs, numbers, rows)
                    digests, docs, numbers, rows = [], [], [], []
            yield _probe_batch(schema, digests, docs, numbers, rows)

    return run


def _probe_batch(schema, digests, docs, numbers, rows) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    cols = [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
            pa.array(docs, pa.int64())]
    if len(schema) == 5:
        cols += [pa.array(numbers, pa.int32()), pa.array(rows, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


# ------------------------------------------------------- minimal perfect hash

def _slot(h1: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_mph(h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels) for distinct 64-bit keys."""
    sizes, bits, left = [], [], h1
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        slot = _slot(left, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[slot]]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


def mph_index(h1: np.ndarray, sizes: np.ndarray, bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index of each key, -1 where no level claims it.  A key outside the set
    may get any index: the fingerprint decides."""
    out = np.full(len(h1), -1, np.int64)
    todo, base = np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        if not len(todo):
            break
        at = base + _slot(h1[todo], level, int(size))
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + int(size)
    return out


def seeded(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit value of both halves of a key; seed 0 is the first half."""
    return (h1.view(np.uint64) + np.uint64(seed) * mix(h2.view(np.uint64))).view(np.int64)


SHARD_TYPE = "shard int, sizes binary, bits binary, prints binary, n_docs binary, first_doc binary"


def _build_shard(key, table):
    """One shard: at most a few times SHARD_KEYS distinct keys."""
    order = np.lexsort((table["h2"].to_numpy(), table["h1"].to_numpy()))
    h1, h2, n, first = (table[c].to_numpy()[order] for c in ("h1", "h2", "n_docs", "first_doc"))
    # keys are told apart by all 128 bits: the next seed where two get one 64-bit value
    seed = next(k for k in range(64) if len(np.unique(seeded(h1, h2, k))) == len(h1))
    keys = seeded(h1, h2, seed)
    sizes, bits = build_mph(keys)
    rank = np.cumsum(bits) - 1
    at = mph_index(keys, sizes, bits, rank)
    sizes = np.r_[np.int64(seed), sizes]  # stored in front of the level sizes
    place = np.empty(len(h1), np.int64)
    place[at] = np.arange(len(h1))
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "sizes": [sizes.tobytes()],
        "bits": [np.packbits(bits).tobytes()], "prints": [h2[place].tobytes()],
        "n_docs": [n[place].tobytes()], "first_doc": [first[place].tobytes()]})


def _probe(batches):
    """Stream of rows sorted by (shard, salt, arrays first): a shard's arrays,
    then its probes.  Gives the lines to drop."""
    schema = pa.schema([("row", pa.int64()), ("line", pa.int32())])
    at, arrays = None, None
    for batch in batches:
        shard = batch.column(0).to_numpy()
        salt = batch.column(1).to_numpy()
        group = shard.astype(np.int64) * (1 << 32) + salt
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for a, b in zip(cuts, [*cuts[1:], len(group)]):
            rows = batch.slice(int(a), int(b - a))
            if group[a] != at:
                at, arrays = group[a], None
            if rows.column(5)[0].is_valid:
                sizes, bits, prints, first = (rows.column(k)[0].as_py() for k in (6, 7, 8, 9))
                seed, sizes = np.frombuffer(sizes, np.int64)[0], np.frombuffer(sizes, np.int64)[1:]
                bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool)
                arrays = (int(seed), sizes, bits, np.cumsum(bits) - 1, np.frombuffer(prints, np.int64),
                          np.frombuffer(first, np.int64))
                rows = rows.slice(1)
            if arrays is None or not rows.num_rows:
                continue
            seed, sizes, bits, rank, prints, first = arrays
            h1, h2, doc = (rows.column(k).to_numpy() for k in (2, 3, 4))
            idx = mph_index(seeded(h1, h2, seed), sizes, bits, rank)
            hit = (idx >= 0) & (prints[idx] == h2) & (first[idx] != doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.column(11).to_numpy()[hit]),
                 pa.array(rows.column(10).to_numpy(zero_copy_only=False)[hit].astype(np.int32))],
                schema=schema)


def repeated_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """h1, h2, n_docs, first_doc of the line keys in two or more documents."""
    hashed = docs.mapInArrow(_hash_lines(False, min_chars), "h1 long, h2 long, doc_id long")
    return (hashed.groupBy("h1", "h2")
            .agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"),
                 F.max("doc_id").alias("last_doc"))
            .where("first_doc <> last_doc").drop("last_doc"))


def line_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """The sharded arrays (one row a shard) and the number of shards."""
    shards = parts_for(keys.count(), SHARD_KEYS)
    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_build_shard, SHARD_TYPE), shards


def with_salts(index: DataFrame, lines: int, shards: int) -> DataFrame:
    """shard, salts: parts of about ``PROBES_PER_TASK`` probes.  Probes of repeated keys are counted by
    the index; all other lines fall evenly on the shards.  So the copies of a shard's arrays
    follow its own probes, and all copies together the number of lines."""
    probes = F.col("hits") + F.lit(lines / shards)
    return index.select("shard", "hits").withColumn("salts", F.ceil(probes / PROBES_PER_TASK).cast("int")).drop("hits")


def lines_to_drop(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(row, line): every line that the contract removes.  ``docs`` has doc_id, text, row."""
    keys = written(repeated_keys(docs, min_chars), "line-keys")
    index, shards = line_index(keys)
    index = written(index, "line-index")
    probes = docs.mapInArrow(_hash_lines(True, min_chars), "h1 long, h2 long, doc_id long, line int, row long")
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    hits = keys.groupBy(F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n_docs").alias("hits"))
    salts = written(with_salts(hits, lines, shards), "salts")
    none = [F.lit(None).cast("binary").alias(c) for c in ("sizes", "bits", "prints", "first_doc")]
    left = probes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(salts, "shard").select(
        "shard", F.pmod(F.xxhash64("row", "line"), F.col("salts")).cast("int").alias("salt"), "h1", "h2", "doc_id",
        F.lit(None).cast("int").alias("arrays"), *none, "line", "row")
    right = index.join(salts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"),
        F.lit(0).cast("long").alias("doc_id"), F.lit(1).alias("arrays"),
        "sizes", "bits", "prints", "first_doc", F.lit(0).alias("line"), F.lit(0).cast("long").alias("row"))
    met = right.unionByName(left).repartition("shard", "salt") \
        .sortWithinPartitions("shard", "salt", F.col("arrays").desc_nulls_last())
    return met.mapInArrow(_probe, "row long, line int")


def _keep(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()),
                        ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        drops = batch.column(2)
        data, offsets = buffers(batch.column(1))
        whole, valid = data.tobytes(), batch.column(1).is_valid().to_pylist()
        texts, n_lines, n_dropped, sha = [], [], [], []
        for i in range(batch.num_rows):
            text = whole[offsets[i]:offsets[i + 1]]
            count, gone = text.count(b"\n") + 1, 0
            if drops[i].is_valid:
                out = set(drops[i].as_py())
                gone = len(out)
                text = b"\n".join(x for n, x in enumerate(text.split(b"\n")) if n not in out)
            texts.append(text.decode() if valid[i] else None)
            n_lines.append(count)
            n_dropped.append(gone)
            sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines), pa.array(n_dropped),
             pa.array(sha)], schema=schema)


def numbered(documents: DataFrame) -> DataFrame:
    """The rows with a ``row`` number each, written once: lines go from a row, whatever its id."""
    return written(documents.withColumn("row", F.monotonically_increasing_id()), "numbered")


def dedup_lines(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped, kept_sha256 per document."""
    docs = numbered(key_text(documents))
    drops = lines_to_drop(docs, min_chars).groupBy("row").agg(F.collect_set("line").alias("drops"))
    return docs.join(drops, "row", "left").select("doc_id", "text", "drops").mapInArrow(
        _keep, "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string")


def _rewrite(columns: list[str]):
    """Rows with their drops last: the text without them, and its new length."""
    text, length = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def run(batches):
        for batch in batches:
            drops, out = batch.column(len(columns)), batch.select(range(len(columns)))
            if drops.null_count < batch.num_rows:
                texts = out.column(text).to_pylist()
                for k in range(batch.num_rows):
                    if drops[k].is_valid and texts[k] is not None:
                        gone = set(drops[k].as_py())
                        texts[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in gone)
                out = out.set_column(text, out.schema.field(text), pa.array(texts, out.schema.field(text).type))
                if length >= 0:
                    sizes = pa.array([None if t is None else len(t) for t in texts], out.schema.field(length).type)
                    out = out.set_column(length, out.schema.field(length), sizes)
            yield out

    return run


def drop_lines(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """``documents`` with all columns, repeated lines gone from ``text``; ``n_chars``,
    where there is one, follows."""
    rows = written(documents.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    docs = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("__row").alias("row"))
    drops = lines_to_drop(docs, min_chars).groupBy(F.col("row").alias("__row")).agg(F.collect_set("line").alias("__drops"))
    met = rows.join(drops, "__row", "left")
    return met.select(*documents.columns, "__drops").mapInArrow(_rewrite(documents.columns), documents.schema)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (
  SELECT doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.n, k.line, (h.key IS NOT NULL AND h.first_doc <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
