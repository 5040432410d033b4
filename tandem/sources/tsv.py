"""Tab-separated text input ``WKT \\t start \\t end`` -> spatio-temporal frame.

The reader is ``spark.read.text`` (any Hadoop file system path; splittable),
and every field is parsed by native column expressions: no Python per line.
Times are read as wall-clock ``yyyy-MM-dd HH:mm:ss`` without a zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.time import TIME_FORMAT, from_epoch_us_ntz, parse_time, try_parse_time
from ..functions.wkt import with_wkt_geometry
from ..operators.filters import PROBLEMS, row_problems
from ..session import shared_dir, stored

#: value of the partition column ``problem`` for rows without one
VALID = "valid"


def parse_lines(lines: DataFrame, text_col: str = "value", fmt: str = TIME_FORMAT, strict: bool = True) -> DataFrame:
    """Lines -> ``kind, pts, parts, shells, minx, miny, maxx, maxy, start_us, end_us``
    (other columns of ``lines`` are kept, e.g. an id).  Text that is no time fails the
    job, or is NULL without ``strict``."""
    fields = F.split(F.col(text_col), "\t")
    keep = [c for c in lines.columns if c != text_col]
    time = parse_time if strict else try_parse_time
    split = lines.select(*keep, F.get(fields, 0).alias("_wkt"),
                         time(F.trim(F.get(fields, 1)), fmt).alias("start_us"),
                         time(F.trim(F.get(fields, 2)), fmt).alias("end_us"))
    out = with_wkt_geometry(split, "_wkt")
    return out.select(*keep, "kind", "pts", "parts", "shells", "minx", "miny", "maxx", "maxy", "start_us", "end_us")


def read_wkt_tsv(spark: SparkSession, path: str, fmt: str = TIME_FORMAT,
                 id_col: str | None = "id") -> DataFrame:
    """Read text files and parse them.  With ``id_col`` the lines have no id of their own: they
    are numbered, parsed and written once to the session's shared folder, and the frame
    reads what was written.  So a retried task or a changed input split sees the same
    ids, and no text is parsed twice."""
    lines = spark.read.text(path)
    if not id_col:
        return parse_lines(lines, "value", fmt)
    return stored(parse_lines(lines.withColumn(id_col, F.monotonically_increasing_id()), "value", fmt), "wkt-tsv-rows")


@dataclass
class Loaded:
    """What ``load_wkt_tsv`` made of its lines."""

    rows: DataFrame       # the valid rows, a geometry frame
    rejected: DataFrame   # id, line, problem
    counts: dict[str, int]  # rows per problem, and under VALID
    path: str


def load_wkt_tsv(spark: SparkSession, source: str | DataFrame, path: str | None = None, fmt: str = TIME_FORMAT,
                 id_col: str | None = None) -> Loaded:
    """S1 with V1 in the same pass: lines are numbered (unless ``id_col`` names their id), parsed, judged
    and written once under ``path`` (default: a fresh shared folder), partitioned by
    ``problem``.  Valid rows and rejected lines are then partitions of one table, so reading one side lists
    no file of the other; the counts are metrics observed while writing, not a scan.

    ``source`` is a path of text files or a frame with a column ``value``.  A line with too few fields, or whose times can't be
    read, has the problem ``null time``; a null line ``malformed geometry``; of several problems the first in
    the order of ``PROBLEMS`` counts.  A rejected row keeps its whole line."""
    lines = spark.read.text(source) if isinstance(source, str) else source
    numbered = lines.select(F.monotonically_increasing_id().alias("id") if id_col is None
                            else F.col(id_col).cast("bigint").alias("id"), "value", F.col("value").alias("line"))
    parsed = parse_lines(numbered, "value", fmt, strict=False)
    judged = parsed.withColumn("problem", F.coalesce(row_problems(parsed), F.lit(VALID)))
    judged = judged.withColumn("line", F.when(F.col("problem") != VALID, F.col("line")))
    seen = Observation()
    path = path or shared_dir(spark, "wkt-tsv-load")
    judged.observe(seen, *[F.count_if(F.col("problem") == p).alias(p) for p in (VALID, *PROBLEMS)]) \
        .write.partitionBy("problem").parquet(path)
    counts = {name: int(n) for name, n in seen.get.items()}
    table = spark.read.schema(judged.schema).parquet(path)
    return Loaded(table.where(F.col("problem") == VALID).drop("line", "problem"),
                  table.where(F.col("problem") != VALID).select("id", "line", "problem"), counts, path)


def write_wkt_tsv(df: DataFrame, path: str, fmt: str = TIME_FORMAT, mode: str = "error") -> None:
    """Inverse of ``read_wkt_tsv`` for geometry frames."""
    from ..functions.wkt import to_wkt
    ts = "yyyy-MM-dd HH:mm:ss" if fmt == TIME_FORMAT else fmt

    def fmt_time(c):
        return F.date_format(from_epoch_us_ntz(F.col(c)), ts)

    line = F.concat_ws("\t", to_wkt("kind", "pts", "parts", "shells"), fmt_time("start_us"), fmt_time("end_us"))
    df.select(line.alias("value")).write.mode(mode).text(path)
