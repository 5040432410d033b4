"""Exact repeated-window removal by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as the threshold (``depth`` = 200 bytes), by
passes that go from the most significant digit on and split groups of suffixes
that agree so far.  A group of one is finished: nothing repeats there.  A group
that still has several members at full depth is a repeated window.

Sorting every position would shuffle many times the text, so a pass works on
*anchors*.  The anchor of a window is the place of its smallest ``GRAM``-byte
hash (leftmost on ties), which depends on the window's bytes alone: equal
windows have equal anchors at equal offsets.  One anchor stands for the run of
windows that chose it, about a hundred.

* Pass 1, digit = the anchor's gram (``GRAM`` bytes): anchors with a unique gram
  are finished.
* Pass 2, digit = the whole reach of the anchor (the bytes of all its windows):
  anchors that share it have all their windows repeated; they stay as one
  representative.
* Further passes, up to depth = 200, for grams with several different reaches.
  A group of few representatives is finished in one task: their windows are
  told apart by all 200 bytes.  A larger group is split by a longer digit: the
  windows are cut in halves by their offset from the anchor, and the digit is
  the bytes that all windows of a half have in common (124 bytes, 162, and so
  on); groups of one are finished, and large groups go on to the next pass.

The repeated windows of one anchor cover one interval of bytes, since windows
of one anchor overlap.  Intervals go back to their documents and are merged.

A document is cut in pieces of ``PIECE`` window starts (with ``depth`` - 1 more
bytes), so a very long text is handled in bounded memory; windows never cross
documents.  Hashes have 64 bits for grams and 128 for reaches and windows.

Defined results: null or empty text has no bytes; rows with null ``doc_id`` are
kept whole and take no part; ``doc_id`` names a document once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, buffers, key_text, mix, ranges, slabs, written

DEPTH = 200
GRAM = 48
#: window starts handled together
PIECE = 1 << 20
PLACE_BITS = 23
#: a group of more representatives is split by a longer digit.  A task takes a group of
#: this size in about 100 MB (153 windows each, 60 bytes a window); more passes cost more
MANY = 8192


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, depth: int):
    """(bytes, offsets, text of each piece, place in its text)."""
    size = np.diff(offsets)
    if len(size) and size.max() > PIECE + depth:
        for t in range(len(size)):
            for a in range(0, max(int(size[t]) - depth + 1, 0), PIECE):
                b = min(a + PIECE + depth - 1, int(size[t]))
                yield data[offsets[t] + a:offsets[t] + b], np.array([0, b - a]), np.array([t]), a
    else:
        yield data, offsets, np.arange(len(size)), 0


def anchors_of(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM):
    """Per run of windows with one anchor: (text, anchor, first window, last
    window) as places in the buffer, and the rolling hashes."""
    rolling = Rolling(data)
    n, width = len(data), depth - gram + 1
    assert n < 1 << PLACE_BITS
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none, none, rolling
    # the leading bits of the hash, then the place: the smallest is the leftmost minimum
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = _window_min((rolling.grams(gram) & ~place) | np.arange(n - gram + 1, dtype=np.uint64), width)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n - depth + 1]
    ok = offsets[1:][text] - np.arange(n - depth + 1) >= depth
    windows = np.flatnonzero(ok)
    if not len(windows):
        return none, none, none, none, rolling
    at = (least[windows] & place).astype(np.int64)
    text = text[windows]
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (windows[1:] != windows[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(windows)] - 1
    return text[first], at[first], windows[first], windows[last], rolling


ANCHOR = pa.schema([("gram", pa.int64()), ("reach", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
                    ("before", pa.int16()), ("after", pa.int16())])


def _anchors(depth: int, gram: int):
    """Rows (gram, reach, doc_id, at, before, after): the anchor's windows start
    from at - before to at - after."""

    def run(batches):
        for rows, data, offsets in slabs(batches):
            docs = rows.column(0).to_numpy(zero_copy_only=False)
            for part, bounds, texts, shift in _pieces(data, offsets, depth):
                text, at, first, last, rolling = anchors_of(part, bounds, depth, gram)
                before, after = (at - first).astype(np.int16), (at - last).astype(np.int16)
                g = rolling.span(at, at + gram)
                reach = rolling.span(first, last + depth) ^ mix(
                    (before.astype(np.uint64) << np.uint64(16)) + after.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(reach.view(np.int64)), pa.array(docs[texts[text]]),
                     pa.array(at - bounds[text] + shift), pa.array(before), pa.array(after)], schema=ANCHOR)

    return run


def _grams(depth: int, gram: int):
    """The gram of every anchor."""
    schema = pa.schema([("gram", pa.int64())])

    def run(batches):
        for _, data, offsets in slabs(batches):
            for part, bounds, _, _ in _pieces(data, offsets, depth):
                _, at, _, _, rolling = anchors_of(part, bounds, depth, gram)
                yield pa.RecordBatch.from_arrays([pa.array(rolling.span(at, at + gram).view(np.int64))], schema=schema)

    return run


ANCHOR_TYPE = "gram long, reach long, doc_id long, at long, before short, after short"
CONTEXT_TYPE = "group long, gram long, reach long, before short, after short, bytes binary"
CONTEXT = pa.schema([("group", pa.int64()), ("gram", pa.int64()), ("reach", pa.int64()), ("before", pa.int16()),
                     ("after", pa.int16()), ("bytes", pa.binary())])


def _contexts(batches):
    """One row per representative with the bytes of all its windows; its group
    is its gram."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        whole = data.tobytes()
        wanted = batch.column(1)
        inner = wanted.flatten()
        at, before, after, gram, reach, depth = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(6))
        bounds = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        start = offsets[text] + at - before
        end = offsets[text] + at - after + depth
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram), pa.array(gram), pa.array(reach), pa.array(before), pa.array(after),
             pa.array([whole[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())], schema=CONTEXT)


def _split(depth: int, gram: int, level: int):
    """Each context once per offset range of this level that its windows meet,
    grouped by the bytes that all windows of the range have in common."""
    width = range_width(depth, gram, level)
    salt = mix(np.arange(1, 2 + (depth - gram) // width, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                rows = batch.slice(first, 2000)
                before, after = (rows.column(k).to_numpy().astype(np.int64) for k in (3, 4))
                data, bounds = buffers_of_binary(rows.column(5))
                count = before // width - after // width + 1
                row = np.repeat(np.arange(rows.num_rows), count)
                part = ranges(after // width, count)
                low = part * width
                high = np.minimum(low + width - 1, depth - gram)
                own_high, own_low = np.minimum(before[row], high), np.maximum(after[row], low)
                zero = bounds[:-1][row] + before[row]  # the anchor
                group = Rolling(data).span(zero - low, zero - high + depth) ^ salt[part]
                whole = data.tobytes()
                pieces = [whole[a:b] for a, b in zip((zero - own_high).tolist(), (zero - own_low + depth).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.view(np.int64)), rows.column(1).take(pa.array(row)),
                     rows.column(2).take(pa.array(row)), pa.array(own_high.astype(np.int16)),
                     pa.array(own_low.astype(np.int16)), pa.array(pieces, pa.binary())], schema=CONTEXT)

    return run


def range_width(depth: int, gram: int, level: int) -> int:
    """Offsets in a range of a level: all at level 0, halved at each next one."""
    return -(-(depth - gram + 1) // (1 << level))


def _window_keys(rows: pa.RecordBatch, depth: int):
    """(row, offset, key1, key2) of every window of the contexts."""
    before, after = (rows.column(k).to_numpy().astype(np.int64) for k in (3, 4))
    data, bounds = buffers_of_binary(rows.column(5))
    count = before - after + 1
    row = np.repeat(np.arange(rows.num_rows), count)
    start = ranges(bounds[:-1], count)
    one, two = Rolling(data, 0), Rolling(data, 1)
    offset = (before[row] - (start - bounds[:-1][row])).astype(np.int16)
    salt = mix(offset.astype(np.uint64) + np.uint64(1))
    return (row, offset, (one.span(start, start + depth) ^ salt).view(np.int64),
            two.span(start, start + depth).view(np.int64))


def buffers_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cut(rows: pa.RecordBatch, limit: int = 1 << 20):
    """Runs of rows of about ``limit`` bytes that do not split a group."""
    group = rows.column(0).to_numpy()
    _, bounds = buffers_of_binary(rows.column(5))
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    first = 0
    while first < len(edges) - 1:
        last = first + 1
        while last < len(edges) - 1 and bounds[edges[last + 1]] - bounds[edges[first]] <= limit:
            last += 1
        yield rows.slice(int(edges[first]), int(edges[last] - edges[first]))
        first = last


def _repeated(rows: pa.RecordBatch, depth: int, schema: pa.Schema) -> pa.RecordBatch:
    """gram, reach, high, low: the largest and smallest offset of the repeated
    windows of each context; all contexts of a group are here."""
    row, offset, key1, key2 = _window_keys(rows, depth)
    order = np.lexsort((key2, key1))
    a, b = key1[order], key2[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = np.r_[False, same] | np.r_[same, False]
    row, offset = row[twice], offset[twice]
    high = np.full(rows.num_rows, -1, np.int16)
    low = np.full(rows.num_rows, np.iinfo(np.int16).max, np.int16)
    np.maximum.at(high, row, offset)
    np.minimum.at(low, row, offset)
    hit = np.flatnonzero(high >= 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.column(1).to_numpy()[hit]), pa.array(rows.column(2).to_numpy()[hit]),
         pa.array(high[hit]), pa.array(low[hit])], schema=schema)


REACH_TYPE = "gram long, reach long, high short, low short"
REACH = pa.schema([("gram", pa.int64()), ("reach", pa.int64()), ("high", pa.int16()), ("low", pa.int16())])


def _few(depth: int):
    """Stream of contexts sorted by group: windows compared within each group."""

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None:
                batch = pa.concat_batches([left, batch])
            group = batch.column(0).to_numpy()
            last = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on
            left = batch.slice(last)
            for rows in _cut(batch.slice(0, last)):
                yield _repeated(rows, depth, REACH)
        if left is not None:
            for rows in _cut(left):
                yield _repeated(rows, depth, REACH)

    return run


def finish(contexts: DataFrame, depth: int, gram: int, many: int) -> DataFrame:
    """gram, reach, high, low of the contexts (with ``n``, the size of their group)
    that have repeated windows."""
    columns = [c.split()[0] for c in CONTEXT_TYPE.split(", ")]
    few = contexts.where(F.col("n") <= many).select(columns)
    done = few.repartition("group").sortWithinPartitions("group").mapInArrow(_few(depth), REACH_TYPE)
    large = contexts.where(F.col("n") > many).select(columns)
    level = 0
    while not large.isEmpty():
        level += 1
        split = written(large.mapInArrow(_split(depth, gram, level), CONTEXT_TYPE), "digits")
        sizes = split.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        alive = written(split.join(sizes, "group"), "groups")
        if range_width(depth, gram, level) == 1:  # a group is one repeated window
            return done.unionByName(alive.select("gram", "reach", F.col("before").alias("high"),
                                                 F.col("after").alias("low")))
        few = alive.where(F.col("n") <= many).select(columns)
        done = done.unionByName(few.repartition("group").sortWithinPartitions("group")
                                .mapInArrow(_few(depth), REACH_TYPE))
        large = alive.where(F.col("n") > many).select(columns)
    return done


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """doc_id, start, end (byte places): covered by repeated windows; spans of one
    document may overlap."""
    docs = docs.where("doc_id is not null")
    # pass 1: grams.  The anchors are found twice, which costs less than keeping them all
    grams = docs.mapInArrow(_grams(depth, gram), "gram long").groupBy("gram").agg(F.count("*").alias("n")) \
        .where("n > 1").select("gram")
    anchors = written(docs.mapInArrow(_anchors(depth, gram), ANCHOR_TYPE).join(grams, "gram", "left_semi"), "anchors")

    # pass 2: reaches
    reaches = written(anchors.groupBy("gram", "reach").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "before", "after")).alias("first")), "reaches")
    alive = written(reaches.join(reaches.groupBy("gram").agg(F.count("*").alias("kinds")), "gram"), "alive")

    whole = alive.where("kinds = 1").select(
        "gram", "reach", F.col("first.before").alias("high"), F.col("first.after").alias("low"))

    # further passes: the windows of the representatives
    wanted = alive.where("kinds > 1").select(
        F.col("first.doc_id").alias("doc_id"),
        F.struct("first.at", "first.before", "first.after", "gram", "reach", F.lit(depth).alias("depth")).alias("w")) \
        .groupBy("doc_id").agg(F.collect_list("w").alias("w"))
    contexts = docs.join(wanted, "doc_id").select("text", "w").mapInArrow(_contexts, CONTEXT_TYPE)
    kinds = reaches.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("gram", "group")
    contexts = written(contexts.join(kinds, "group"), "contexts")
    again = finish(contexts, depth, gram, many).groupBy("gram", "reach").agg(
        F.max("high").alias("high"), F.min("low").alias("low"))
    # a reach met twice has all its windows repeated, whatever the other reaches are
    met = alive.where("kinds > 1").select("gram", "reach", "n", "first.before", "first.after") \
        .join(again, ["gram", "reach"], "left") \
        .select("gram", "reach", F.when(F.col("n") > 1, F.col("before")).otherwise(F.col("high")).alias("high"),
                F.when(F.col("n") > 1, F.col("after")).otherwise(F.col("low")).alias("low")) \
        .where("high is not null")
    covered = whole.unionByName(met)
    return anchors.join(covered, ["gram", "reach"]).select(
        "doc_id", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + depth).alias("end"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """doc_id, spans: maximal runs as an array of (start, end), in order."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")) \
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _remove(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()),
                        ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for rows, data, offsets in slabs(batches):
        whole = data.tobytes()
        kept, size, gone, runs, sha = [], [], [], [], []
        for t, spans in enumerate(rows.column(2).to_pylist()):
            text = whole[offsets[t]:offsets[t + 1]]
            spans = spans or []
            out, at = [], 0
            for s in spans:
                out.append(text[at:s["start"]])
                at = s["end"]
            out.append(text[at:])
            rest = b"".join(out)
            kept.append(rest)
            size.append(len(text))
            gone.append(len(text) - len(rest))
            runs.append(len(spans))
            sha.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(runs, pa.int64()), pa.array(sha, pa.string())], schema=schema)


def remove_repeats(documents: DataFrame, depth: int = DEPTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    # spans belong to a row, whatever its id: rows are numbered once, in a written table
    docs = written(key_text(documents).withColumn("row", F.monotonically_increasing_id()), "numbered")
    numbered = docs.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")
    spans = merge_spans(repeated_spans(numbered, depth, gram, many)).withColumnRenamed("doc_id", "row")
    return docs.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS key
  FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
twice AS (SELECT key FROM win GROUP BY key HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win WHERE key IN (SELECT key FROM twice)),
marked AS (
  SELECT doc_id, i, CASE WHEN i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) + 200 THEN 1 ELSE 0 END AS new FROM hit),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT d.doc_id, d.h, s.a, s.b,
         coalesce(lead(s.a) OVER (PARTITION BY d.doc_id ORDER BY s.a), length(d.h) // 2) AS next_a,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY s.a) AS n
  FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id)
SELECT doc_id, max(length(h) // 2) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed,
       count(a) AS n_spans,
       sha256(from_hex(string_agg(CASE WHEN a IS NULL THEN h
         ELSE (CASE WHEN n = 1 THEN substr(h, 1, 2 * a) ELSE '' END) || substr(h, 2 * b + 1, 2 * (next_a - b)) END,
         '' ORDER BY n))) AS kept_sha256
FROM gaps GROUP BY doc_id
"""
