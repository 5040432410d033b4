"""Line dedup, repeated windows, near duplicates and decontamination against
brute force, with nulls, empties, ties, long texts and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import (brute_components, brute_contamination, brute_lines, brute_repeats, sha, tables)
from tandem.llm import decontam, line_dedup, minhash, suffix_dedup
from tandem.llm.queries import QUERIES

RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "Ru", "sé") for b in ("x", "yy", "zan", "tor")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    shared, line = prose(60), "A very common line, met by all."
    base = prose(120)
    docs = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, "one two"), (7, "One  two"),
            (8, " \n\t "), (9, line), (10, f"x\n{line}\n  {line.lower()} \ny"), (11, f"{line}\n{prose(30)}"),
            (12, prose(40) + " " + shared + " " + prose(9)), (13, shared), (14, prose(5) + "\n" + shared),
            (15, "ab " * 400), (16, "z" * 700), (17, prose(4000)), (18, "é" * 150 + prose(3)), (19, "é" * 150)]
    words = base.split()
    for k in range(20, 40):  # near copies of growing distance
        w = list(words)
        for _ in range((k - 18) // 3):
            w[RNG.randrange(len(w))] = f"new{k}"
        docs.append((k, " ".join(w)))
    docs += [(k, f"{line}\n{prose(25)}") for k in range(40, 60)]
    return docs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs = corpus()
    items = [(1, " ".join(docs[0][1].split()[3:30])), (2, "one, TWO!"), (3, None), (4, ""), (None, "x y z"),
             (5, " ".join(docs[16][1].split()[100:110])), (5, "not there at all"), (6, "never seen words here")]
    return tables(spark, tmp_path_factory.mktemp("sf"), docs, items=items), docs, items


def test_lines(spark, folder):
    path, docs, _ = folder
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op9_line_dedup"](spark, path).collect()}
    assert got == {d: (n, x, sha(t)) for d, (n, x, t) in brute_lines(docs).items()}


def test_repeats(spark, folder):
    path, docs, _ = folder
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op4_suffix_dedup"](spark, path).collect()}
    assert got == {d: (n, x, s, sha(t)) for d, (n, x, s, t) in brute_repeats(docs).items()}


def test_repeats_of_frequent_grams(spark, folder):
    """With one representative allowed per task, groups are split down to single windows: same result."""
    path, docs, _ = folder
    got = suffix_dedup.remove_repeats(spark.read.parquet(f"{path}/documents.parquet"), many=1)
    want = brute_repeats(docs)
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got.collect()} == {d: v[1:3] for d, v in want.items()}


def test_anchors_of_pieces_cover_every_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    data = np.frombuffer(prose(600, random.Random(2)).encode(), np.uint8)
    seen = []
    for part, bounds, texts, shift in suffix_dedup._pieces(data, np.array([0, len(data)]), 200):
        _, at, first, last, _ = suffix_dedup.anchors_of(part, bounds, 200, 48)
        for p, a, b in zip(at, first, last):
            assert a <= p <= a + 152 and b <= p <= b + 152
            seen += range(a + shift, b + shift + 1)
    assert sorted(seen) == list(range(len(data) - 199))


def test_near_duplicates(spark, folder):
    path, docs, _ = folder
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op1_minhash"](spark, path).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute_components(docs).items()}


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (50, 50)]
    found = minhash.connected_components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


def test_contamination(spark, folder):
    path, docs, items = folder
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in QUERIES["op5_decontamination"](spark, path).collect()}
    want = brute_contamination(docs, [x for x in items if x[0] is not None])
    assert got == {d: (n, h, len(i), sha(",".join(i)), h > 0) for d, (n, h, i) in want.items()}


def test_rows_are_dropped_by_their_own_text(spark, tmp_path):
    """A hit row takes no clean row of its id, null or repeated, along."""
    leak, clean = prose(9) + " the test item of ten words in all is here ok", "nothing to see " * 20
    rows = [(None, leak), (None, clean), (None, None), (7, clean), (7, leak), (7, leak), (8, leak), (9, clean)]
    path = tables(spark, tmp_path, rows, items=[(1, "the test item of ten words in all is here")])
    docs, items = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = decontam.drop_contaminated(docs, items)
    assert kept.schema == docs.schema
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        (str(d), str(t)) for d, t in rows if t != leak)
    found = decontam.decontaminate(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in found) == sorted((str(d), 10 if t == leak else 0) for d, t in rows)


def test_candidates_of_rows_without_id_stay_apart(spark, tmp_path):
    """Postings and candidates have a key per row, so rows without id are no hot key and meet only themselves."""
    item = "the test item of ten words in all is here"
    path = tables(spark, tmp_path, [(None, item)] * 30, items=[(1, item)])
    docs, items = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = decontam.numbered(docs)
    windows = decontam.item_windows(items)
    index = decontam.build_index(rows.select(rows[decontam.ROW].alias("doc_id"), "text"),
                                 windows.selectExpr("explode(terms) term"))
    assert decontam.intersect(index, decontam.rarest_terms(windows, index)).count() == 30


def test_contamination_is_native(spark, folder):
    plan = QUERIES["op5_decontamination"](spark, folder[0])._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "b x x x x x a"), (3, "c a x b")], "doc_id long, text string")
    items = spark.createDataFrame([("i", ["a", "b"])], "item string, terms array<string>")
    index = decontam.build_index(docs, items.selectExpr("explode(terms) term"))
    got = {(r.item, r.doc_id) for r in decontam.proximity_matches(index, items, 2).collect()}
    assert got == {("i", 1), ("i", 3)}


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000))
    sizes, bits = line_dedup.build_mph(keys)
    at = line_dedup.mph_index(keys, sizes, bits, np.cumsum(bits) - 1)
    assert sorted(at) == list(range(len(keys)))


@pytest.mark.parametrize("name", ["op1_minhash", "op4_suffix_dedup", "op5_decontamination", "op9_line_dedup"])
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, tables(spark, tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op1_minhash", "op4_suffix_dedup", "op5_decontamination", "op9_line_dedup"])
def test_null_ids_and_repeated_rows(spark, tmp_path, name):
    text = "the same line of text in every row of it\n" + "word " * 60
    path = tables(spark, tmp_path, [(None, text), (7, text), (7, text), (8, text)], items=[(1, "word " * 12)])
    rows = QUERIES[name](spark, path).collect()
    assert {r.doc_id for r in rows} >= {7, 8}
    if name == "op9_line_dedup":
        assert {r.doc_id: r.n_dropped for r in rows} == {None: 0, 7: 0, 8: 2}
    if name == "op1_minhash":
        n = len(set(zip(*[text.split()[i:] for i in range(5)])))
        assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows) == [
            (0, n, None, None), (7, n, 7, True), (8, n, 7, False)]
    if name == "op5_decontamination":
        assert all(r.n_hit == 60 for r in rows)


def test_rows_of_one_id_keep_their_own_text(spark, tmp_path):
    """Different texts under one id: what goes from one row never goes from another."""
    line, block = "A very common line, met by all.", prose(80)
    rows = [(1, f"{line}\nfirst own line of it"), (2, f"beta\n{line}"), (2, "gamma own line\ndelta own line number two\nepsilon own line"),
            (3, block), (4, f"{prose(9)} {block}"), (4, prose(90))]
    docs = spark.read.parquet(tables(spark, tmp_path, rows) + "/documents.parquet")
    lines = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert lines == sorted([*rows[:1], (2, "beta"), *rows[2:]])
    assert sorted((r.doc_id, r.text) for r in line_dedup.drop_lines(docs).collect()) == lines
    kept = sorted((r.doc_id, r.n_bytes - r.n_removed, r.kept.decode()) for r in suffix_dedup.remove_repeats(docs).collect())
    left = {t for _, _, t in kept}
    assert rows[5][1] in left and all(t in left for _, t in rows[:3]) and (3, 0, "") in kept


def test_keys_that_share_64_bits_stay_apart():
    import pyarrow as pa
    h1 = np.array([5, 5, 9, 5], np.int64)
    h2 = np.array([1, 2, 3, 4], np.int64)
    shard = line_dedup._build_shard([pa.scalar(0, pa.int32())], pa.table({
        "h1": h1, "h2": h2, "n_docs": np.full(4, 2), "first_doc": np.array([10, 20, 30, 40])})).to_pylist()[0]
    seed, sizes = np.frombuffer(shard["sizes"], np.int64)[0], np.frombuffer(shard["sizes"], np.int64)[1:]
    bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    at = line_dedup.mph_index(line_dedup.seeded(h1, h2, int(seed)), sizes, bits, np.cumsum(bits) - 1)
    assert np.frombuffer(shard["first_doc"], np.int64)[at].tolist() == [10, 20, 30, 40]
    assert np.frombuffer(shard["prints"], np.int64)[at].tolist() == h2.tolist()


def test_copies_of_the_arrays_follow_the_probes(spark):
    """Twice the lines and shards, one hot key: copies grow with the lines, not with lines x shards."""
    def copies(lines, shards, hot):
        hits = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.when(F.col("id") == 0, hot).otherwise(10).alias("hits"))
        return line_dedup.with_salts(hits, lines, shards).agg(F.sum("salts")).first()[0]
    small, large = copies(10 ** 9, 1000, 4 * 10 ** 8), copies(2 * 10 ** 9, 2000, 8 * 10 ** 8)
    assert large <= 2.1 * small and large <= 2.8 * 10 ** 9 / line_dedup.PROBES_PER_TASK + 2000
