"""Benchmark decontamination with a distributed positional inverted index.

1. Test items become windows of ``window`` words (a shorter item is one window).
2. The index stores a posting (term, document, position) for every training
   token whose term some test item uses.
3. Terms are ranked by their number of postings.  A window's search starts from
   the offset-adjusted list of its rarest term - every posting gives a start of
   the window in a document - and intersects it with the lists of its next
   rarest terms.  A window with a term that the training text lacks is done.
4. What is left is confirmed word by word against the whole document.

Everything is DataFrame code.  Joins carry no hint: Catalyst broadcasts the
test side where its size allows it and shuffles it otherwise.

Rows are numbered and written first: postings and candidates go by the row's
number, so each row is decided by its own text, whatever its id.

Defined results: null or empty text has no words; items repeated under one id
count once; an item without id or words is no item; a document without id, or
with the id of another, is searched like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_text, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what separates words (fixed value of the contract)
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
ROW = "__row"
#: terms of a window whose lists are intersected before the exact check
PROBES = 3


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def numbered(documents: DataFrame) -> DataFrame:
    """The rows as they are and ``ROW``, written, so that every reader sees the same numbers."""
    return written(documents.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """win (its words joined by a space), terms, items (ids as strings)."""
    read = items.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = read.select("item", F.explode(F.transform(F.sequence(F.lit(0), last),
                                                    lambda i: F.slice("w", i + 1, window))).alias("terms"))
    return (cut.groupBy("terms").agg(F.collect_set("item").alias("items"))
            .select(F.concat_ws(" ", "terms").alias("win"), "terms", "items"))


def build_index(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings term, doc_id, pos of every training token in ``vocabulary`` (term)."""
    tokens = documents.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return tokens.join(vocabulary.select("term").distinct(), "term")


def rarest_terms(windows: DataFrame, index: DataFrame, probes: int = PROBES) -> DataFrame:
    """win, term, off, rank: the rarest terms of each window that can occur at all."""
    seen = index.groupBy("term").agg(F.count("*").alias("n"))
    placed = windows.select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    counted = placed.join(seen, "term")
    here = Window.partitionBy("win")
    ranked = counted.withColumn("found", F.count("*").over(here)).where("found = size") \
        .withColumn("rank", F.row_number().over(here.orderBy("n", "off")))
    return ranked.where(F.col("rank") <= probes).select("win", "term", "off", "rank")


def intersect(index: DataFrame, probes: DataFrame, n_probes: int = PROBES) -> DataFrame:
    """win, doc_id, start where the lists of all probes meet, from the rarest."""
    first = probes.where("rank = 1")
    starts = index.join(first, "term").select("win", "doc_id", (F.col("pos") - F.col("off")).alias("start")) \
        .where("start >= 0")
    for rank in range(2, n_probes + 1):
        nxt = probes.where(F.col("rank") == rank)
        lists = index.join(nxt.select("term").distinct(), "term", "left_semi")
        due = starts.join(nxt.select("win", "term", "off"), "win", "left")
        met = due.alias("a").join(
            lists.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("pos").alias("p")),
            (F.col("term") == F.col("t")) & (F.col("doc_id") == F.col("d"))
            & (F.col("start") + F.col("off") == F.col("p")), "left")
        # a window of fewer terms has no probe of this rank: it passes
        starts = met.where("term is null or p is not null").select("win", "doc_id", "start")
    return starts


def places_due(rows: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``ROW``, due: array of (start, terms, items) where all probes of a window meet, for the
    rows (of ``numbered``) that have any."""
    docs = rows.select(F.col(ROW).alias("doc_id"), "text")
    windows = written(item_windows(items, window), "windows")
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    index = written(build_index(docs, vocabulary), "postings")
    probes = written(rarest_terms(windows, index), "probes")
    starts = intersect(index, probes).join(windows, "win").select(
        "doc_id", F.struct("start", "terms", "items").alias("at"))
    return starts.groupBy(F.col("doc_id").alias(ROW)).agg(F.collect_set("at").alias("due"))


def confirmed(met: DataFrame) -> DataFrame:
    """``met`` (text, due) with w (its words), n_words and hits: the due places where the words stand."""
    same = F.filter("due", lambda c: F.slice("w", c.start + 1, F.size(c.terms)) == c.terms)
    return met.withColumn("w", words(F.col("text"))).select(
        *[c for c in met.columns if c != "due"], "w", F.size("w").alias("n_words"),
        F.coalesce(same, F.expr("array()")).alias("hits"))


def find_occurrences(rows: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``ROW``, doc_id, text, w (its words), n_words, hits: array of (start, terms,
    items), confirmed, for each row of ``rows`` (of ``numbered``)."""
    due = places_due(rows, items, window)
    return confirmed(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text").join(due, ROW, "left"))


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (start, length): one row
    per document, contaminated or not."""
    found = find_occurrences(numbered(key_text(documents)), items, window)
    spans = F.transform("hits", lambda h: F.struct(h.start.alias("start"), F.size(h.terms).alias("length")))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(
        h.start, h.start + F.size(h.terms) - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                        F.size(covered).cast("long").alias("n_hit"), ids.alias("items"),
                        F.array_sort(F.array_distinct(spans)).alias("spans"))


def drop_contaminated(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` (all columns) without the rows that hold a window of an item.

    Only rows with a due place are read for words, and only ids meet all rows: the lists of
    ids are written first, so their size is known and the texts need not be shuffled."""
    rows = numbered(documents)
    due = written(places_due(rows, items, window), "due")
    met = rows.select(ROW, "text").join(due.select(ROW), ROW, "left_semi").join(due, ROW)
    gone = written(confirmed(met).where(F.size("hits") > 0).select(ROW), "gone")
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def proximity_matches(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """item, doc_id, near: postings of an item's rarest term that have every other
    term of the item at most ``within`` positions away, in any order.

    ``items`` has item and terms (distinct).  Positions are cut in bins of
    ``within``, so a posting meets only its own and the two neighbouring bins."""
    terms = items.select("item", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    seen = index.groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item").orderBy("n", "term")
    ranked = terms.join(seen, "term").withColumn("rank", F.row_number().over(order))
    anchor = index.join(ranked.where("rank = 1").select("item", "size", "term"), "term") \
        .select("item", "size", "doc_id", F.col("pos").alias("near"))
    cell = F.floor(F.col("near") / within)
    anchor = anchor.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    others = index.join(ranked.where("rank > 1").select("item", "term"), "term") \
        .withColumn("cell", F.floor(F.col("pos") / within))
    met = anchor.join(others, ["item", "doc_id", "cell"], "left") \
        .withColumn("ok", F.abs(F.col("pos") - F.col("near")) <= within)
    return (met.groupBy("item", "doc_id", "near", "size")
            .agg(F.count_distinct(F.when(F.col("ok"), F.col("term"))).alias("others"))
            .where(F.col("others") == F.col("size") - 1).select("item", "doc_id", "near"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    marked = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i + 1, i + 10), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT p.doc_id, p.i, s.n, win.item
  FROM pos p JOIN sizes s ON p.i + s.n <= len(p.w)
  JOIN win ON win.n = s.n AND win.win = array_to_string(list_slice(p.w, p.i + 1, p.i + s.n), ' ')),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
       coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""
