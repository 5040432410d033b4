"""Embedding whitening and near-dedup against numpy on whole tables, with awkward rows."""

import numpy as np
import pytest
from conftest import SF001
from helpers import tables
from tandem.llm import embedding_dedup, whitening
from tandem.llm.queries import QUERIES

RNG = np.random.default_rng(3)


def brute_whitening(vectors, most=8):
    x = np.floor(np.array(vectors, np.float64) * 1024) + 100000
    values, columns = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    order = np.argsort(-values)[:most]
    n, total = len(x), [int(s) for s in x.sum(0)]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x]
    return values[order], (x - x.mean(0)) @ columns[:, order] / np.sqrt(values[order]), deviation, values.sum()


def check_whitening(got, ids, vectors, most=8):
    values, white, deviation, trace = brute_whitening(vectors, most)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(ids) * len(values)
    signs = np.sign([by[ids[0], c + 1].whitened * white[0, c] for c in range(len(values))])
    for k, i in enumerate(ids):
        for c in range(len(values)):
            r = by[i, c + 1]
            assert r.n == len(ids) and r.deviation == deviation[k] == int(r.deviation_exact)
            assert r.whitened == pytest.approx(signs[c] * white[k, c], abs=1e-8)
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-9)
            assert 0 <= r.identity_error <= 1e-9


def test_whitening_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    got = QUERIES["op12_whitening"](spark, SF001).collect()
    check_whitening(got, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_of_awkward_rows(spark, tmp_path):
    good = [(k, [float(a) for a in RNG.normal(size=5)]) for k in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 1.0, 1.0, 1.0, 1.0]),
           (104, []), (105, [1.0, 2.0]), (106, [1e30, 1.0, 1.0, 1.0, 1.0])]
    zero = (200, [0.0] * 5)
    path = tables(spark, tmp_path / "a", vectors=good + bad + [zero, zero])
    got = QUERIES["op12_whitening"](spark, path).collect()
    assert {r.vec_id for r in got} == {k for k, _ in good} | {200}
    assert max(r.component for r in got) == 5
    floats = [[float(np.float32(c)) for c in v] for _, v in [*good, zero, zero]]
    values, white, _, _ = brute_whitening(floats)
    one = {r.component: abs(r.whitened) for r in got if r.vec_id == 0}
    assert [one[c + 1] for c in range(5)] == pytest.approx(np.abs(white[0]).tolist(), abs=1e-8)
    for name, rows in (("empty", []), ("one", good[:1]), ("equal", [zero, zero]), ("bad", bad[:5])):
        assert QUERIES["op12_whitening"](spark, tables(spark, tmp_path / name, vectors=rows)).collect() == []


@pytest.mark.parametrize("dim", [1, 2, 9, 64])
def test_components_of_every_shape(dim):
    base = RNG.normal(size=(dim, dim))
    for V in (np.eye(dim), base @ base.T, np.diag(np.arange(dim) // 3 + 1.0), np.outer(base[0], base[0])):
        values, columns = whitening.principal(V)
        truth = np.sort(np.linalg.eigvalsh(V))[::-1]
        truth = truth[truth > 1e-10 * truth[0]][:8]
        assert values == pytest.approx(truth, rel=1e-9)
        assert np.abs(columns.T @ columns - np.eye(len(values))).max() < 1e-12
        assert np.abs(V @ columns - columns * values).max() < 1e-12 * max(1, np.abs(V).sum())
        for shift in (-1.0, truth[0] / 3 + 0.01, truth[0] * 2):
            assert whitening.below(V, shift) == (np.linalg.eigvalsh(V) < shift).sum()


def test_deviations_are_exact_beyond_a_long():
    x = np.array([[10 ** 6, 3], [0, -5]], np.int64)
    n = 10 ** 9
    assert whitening.deviations(x, n, [5, 7]) == [(n * 10 ** 6 - 5) ** 2 + (3 * n - 7) ** 2, 25 + (5 * n + 7) ** 2]


def brute_near(rows, cosine=0.98):
    """[(vec_id, n_links, component_id)] in the order of rows (vec_id, v, label)."""
    def usable(v, label):
        return (label is not None and v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and any(v))
    unit = [np.array(v) / np.linalg.norm(v) if usable(v, label) else None for _, v, label in rows]
    linked = [[j for j, w in enumerate(unit) if j != i and w is not None and rows[j][2] == rows[i][2] and u @ w >= cosine]
              if u is not None else [] for i, u in enumerate(unit)]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        met, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in linked[k] if j not in met and not met.add(j)]
        ids = [rows[j][0] for j in met if rows[j][0] is not None]
        out.append((vec_id, len(linked[i]), min(ids) if ids else None))
    return out


def near_rows():
    rows, group, chain = [], RNG.normal(size=6), RNG.normal(size=6)
    for k in range(120):  # near copies, a chain whose ends are far apart, scaled copies, noise
        rows.append((k, (group + RNG.normal(size=6) * 0.05).tolist(), 1))
        rows.append((1000 + k, (chain := chain + RNG.normal(size=6) * 0.08).tolist(), k % 2))
        rows.append((2000 + k, RNG.normal(size=6).tolist(), k % 3))
    rows += [(5000 + k, (group * (k + 1)).tolist(), 1) for k in range(5)]
    rows += [(3000 - k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 7) for k in range(30)]  # copies
    rows += [(4000, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None), (4001, None, 7), (4002, [0.0] * 6, 7), (4003, [1.0, None, 3.0, 4.0, 5.0, 6.0], 7),
             (4004, [1.0, 2.0], 7), (4005, [float("nan")] * 6, 7), (4006, [], 7), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.5], 7),
             (None, [9.0, -2.0, 3.0, 4.0, 5.0, 6.5], 7), (3, [-1.0, 2.0, -3.0, 4.0, -5.0, 6.0], 9), (3, [1.0, 2.0, -3.0, 4.0, -5.0, 6.0], 9)]
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_near_vectors(spark, tmp_path, block):
    rows = near_rows()
    path = tables(spark, tmp_path, vectors=rows)
    if block == embedding_dedup.BLOCK:
        got = QUERIES["op13_embedding_dedup"](spark, path).collect()
    else:  # many blocks, so nodes are sent as guests
        got = embedding_dedup.near_vectors(spark.read.parquet(f"{path}/embeddings.parquet"), block=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute_near(rows), key=key)
    assert all(r.kept == (None if r.vec_id is None or r.component_id is None else r.vec_id == r.component_id) for r in got)


def test_near_vectors_of_nothing(spark, tmp_path):
    assert QUERIES["op13_embedding_dedup"](spark, tables(spark, tmp_path / "a")).collect() == []
    got = QUERIES["op13_embedding_dedup"](spark, tables(spark, tmp_path / "b", vectors=[(1, None, 2), (2, [0.0], 2)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]
