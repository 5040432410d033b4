"""The pipeline against its stages in brute force."""

import corpus_pipeline
from helpers import brute_components, brute_contamination, brute_lines, documents, tables
from tandem.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    good = {r.doc_id for r in QUERIES["op6_quality"](spark, SF001).collect() if r.predicted == 1}
    docs = [(r.doc_id, r.text) for r in rows if r.doc_id in good]
    docs = [(d, t) for d, (_, _, t) in brute_lines(docs).items()]
    groups = brute_components(docs, 80)
    docs = [(d, t) for d, t in docs if groups[d][1] == d]
    hit = brute_contamination(docs, items)
    docs = {d: t for d, t in docs if hit[d][1] == 0}
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {r.doc_id: r.text for r in got} == docs
    assert all(r.round_trip and r.n_chars == len(r.text) for r in got)
    lang = {r.doc_id: (r.lang, r.source) for r in rows}
    assert all((r.lang, r.source) == lang[r.doc_id] for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    same = "a line that is in two of the documents"
    rows = [(1, "first text\n" + same), (2, "second text\n" + same), (3, None), (4, ""), (None, "no id"),
            (5, "x " * 3000), (6, "x " * 3000)]
    path = tables(spark, tmp_path, rows, items=[(1, "not in any text")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "encoding":
            assert out.schema.names == docs.schema.names
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "line_dedup":
            assert got == {**dict(rows), 2: "second text", 6: ""}
        if name == "near_duplicates":
            assert set(got) == {1, 2, 3, 4, 5, None} or set(got) == {1, 2, 3, 4, 5, 6, None}
        if name == "encoding":
            assert set(got) == set(dict(rows))
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).collect() == []
