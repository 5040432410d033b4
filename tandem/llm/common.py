"""Helpers shared by the operators: written intermediates, text buffers and
vectorised rolling hashes over UTF-8 bytes.

Every document is handled as its whole UTF-8 text.  ``slabs`` only cuts a
batch of rows into runs of a few MB, so a task's memory depends on its longest
document and not on how many rows Spark sends at once.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLAB_BYTES = 2 << 20
#: odd multipliers of the polynomial hashes and their inverses modulo 2**64
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session;
    a temporary one only in local mode where the setting is unset (tests)."""
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh path of the shared folder and read it back:
    cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_text(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, whatever other columns the table has."""
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def held_out(modulus: int, remainder: int, key: str = "doc_id"):
    return (F.crc32(F.col(key).cast("string")) % modulus) == remainder


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slabs(batches: Iterator[pa.RecordBatch], column: str = "text",
          limit: int = SLAB_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, text bytes, text offsets) for runs of rows of about ``limit`` bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (batch.slice(first, last - first), data[offsets[first]:offsets[last]],
                   offsets[first:last + 1] - offsets[first])
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, by doubling."""
    out = np.ones(n + 1, np.uint64)
    have = 1
    while have <= n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n + 1 - have)
        out[have:have + take] = out[:take] * step
        have += take
    return out


class Rolling:
    """Polynomial hash of any byte span of one buffer: ``span(i, j)``.

    Equal spans have equal values wherever they stand; the multiplier is odd,
    so its powers can be divided out modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        n = len(data)
        terms = byte_table(which)[data]
        terms *= powers(max(n - 1, 0), base)[:n]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.prefix[1:])
        self.inverse = powers(n, pow(base, -1, 1 << 64))

    def span(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.prefix[j] - self.prefix[i]) * self.inverse[i])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n bytes from every position that has n bytes after it."""
        return mix((self.prefix[n:] - self.prefix[:-n]) * self.inverse[:len(self.prefix) - n])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; runs end with their text."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i] .. starts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))
