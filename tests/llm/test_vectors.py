"""Top-k search and whitening against brute force."""

import math
import random

import numpy as np
import pytest

from cuewise.llm import top_k, whitening
from cuewise.llm.vectors import by_length

SCHEMA = "vec_id long, embedding array<float>, label int, x double, row long, n int, score long, salt string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None, None, None) for i, v in rows], SCHEMA)


def expected_top(rows, every, k):
    """The contract's rows by sorting all candidates of each query."""
    fine = [(n, i, [math.floor(256 * float(np.float32(c))) for c in v]) for n, (i, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, q in fine:
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j is None, j or 0, m) for m, j, c in fine if m != n and len(c) == len(q))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(scored)]
    return sorted(out, key=str)


def edge_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # one vector, many rows
    rows += [(150, rows[0][1]), (150, rows[0][1]), (50, rows[9][1])]  # repeated ids
    rows += [(300, None), (350, []), (400, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (500, [float("inf")] * 6)]
    rows += [(None, rows[1][1]), (None, [9.0] * 6), (550, [0.5, 0.25]), (551, [0.5, 0.5]), (600, [1.0])]
    return rows


@pytest.mark.parametrize(("size", "regions"), [(8192, 256), (16, 7)])
def test_top_k_is_exact(spark, monkeypatch, size, regions):
    monkeypatch.setattr(top_k, "ROWS", size)
    monkeypatch.setattr(top_k, "REGIONS", regions)
    monkeypatch.setattr(top_k, "QUERIES", 4 if size == 16 else top_k.QUERIES)
    rows = edge_rows()
    got = top_k.top_k(frame(spark, rows).repartition(3), every=10, k=5)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == expected_top(rows, 10, 5)


def test_top_k_of_nothing(spark):
    assert top_k.top_k(frame(spark, [])).count() == 0
    assert top_k.top_k(frame(spark, [(50, None), (51, [])])).count() == 0


def test_products_beyond_doubles_are_exact():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**30, 0.0], [-(2.0**30), 0.0]])
    assert top_k.products(q, x).tolist() == [[2**60 + 3, 2**63 - 1, -(2**63)]]


def test_balls_prune_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (64, 16))
    x = np.floor(centres[rng.integers(0, 64, 6000)] + rng.normal(0, 8, (6000, 16)))
    q = np.floor(centres[:20] + rng.normal(0, 8, (20, 16)))
    tree, keys = top_k.BallTree(x), np.arange(6000)
    assert all(b - a <= top_k.LEAF for a, b in tree.spans[-1]) and sorted(tree.order) == list(range(6000))
    for (ca, ra), spans in zip(tree.balls, tree.spans, strict=True):
        for c, r, (a, b) in zip(ca, ra, spans, strict=True):
            assert (top_k.upper_bounds(q, c[None], np.array([r]))[:, 0] >= (q @ x[tree.order[a:b]].T).max(1)).all()
    best = top_k.Best(20, 5, np.full(20, top_k.LEAST), np.full(20, top_k.LAST))
    made = top_k.search(tree, x, keys, keys, q, np.full(20, -2), best)
    want = -np.sort(-(q @ x.T), axis=1)[:, :5]
    assert (best.score == want).all() and made < 20 * 6000 * 0.6
    # A known kth score spares more.
    again = top_k.Best(20, 5, best.score[:, -1].copy(), best.key[:, -1].copy())
    assert top_k.search(tree, x, keys, keys, q, np.full(20, -2), again) <= made and (again.score[:, :4] == want[:, :4]).all()


def test_lengths_of_sliced_lists():
    import pyarrow as pa

    column = pa.array([[1.0], [1.0, 2.0], None, [None, 1.0], [3.0, 4.0], []]).slice(1)
    assert [(r.tolist(), m.tolist()) for r, m in by_length(column)] == [([0, 3], [[1.0, 2.0], [3.0, 4.0]])]


def whitened_rows(df):
    return {(r["vec_id"], r["component"]): r for r in df.collect()}


def test_whitening_is_that_of_the_covariance(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in r["embedding"]] for r in vectors.orderBy("vec_id").collect()], dtype=object)
    ids = [r["vec_id"] for r in vectors.orderBy("vec_id").collect()]
    n, sums = len(x), x.sum(0)
    centred = (x - sums / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitened_rows(whitening.whiten(vectors.repartition(7)))
    assert len(got) == 8 * n
    for c in range(8):
        want = centred @ axes[:, c] / math.sqrt(values[c])
        own = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert np.abs(own * np.sign(own @ want) - want).max() < 1e-8
        assert got[ids[0], c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    for i, row in zip(ids, x, strict=True):
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        assert got[i, 1]["deviation"] == exact == int(got[i, 1]["deviation_exact"]) and got[i, 1]["n"] == n
    assert 0 < got[ids[0], 1]["identity_error"] < 1e-9


def test_merging_loses_nothing():
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 300, (400, 12)) + np.arange(12) * 50).astype(np.int64) + 100_000
    cuts = [0, 1, 4, 90, 95, 250, 400]
    parts = [whitening.Summary.of(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    left = parts[0]
    for p in parts[1:]:
        left = left.merged(p)
    pairs = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3])).merged(parts[4].merged(parts[5]))
    whole = whitening.Summary.of(x)
    for s in (left, pairs):
        assert s.n == 400 and s.sums == x.sum(0).tolist() and np.allclose(s.s, whole.s, rtol=1e-11)
        assert np.allclose(np.abs((s.vt * whole.vt).sum(1)), 1)


def test_whitening_of_odd_rows(spark):
    rows = [(i, [random.Random(i).random() for _ in range(3)]) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [1.0, 2.0]), (105, [1e38, 0.0, 0.0])]
    same = [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]
    got = whitening.whiten(frame(spark, rows + odd + same)).collect()
    assert len(got) == 3 * 33 and {r["n"] for r in got} == {33} and sum(r["vec_id"] == 5 for r in got) == 9
    assert {r["vec_id"] for r in got} == {*range(30), None} and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[(1, [0.5, 1.0])], [(i, [0.25, 0.5, 0.75]) for i in range(9)]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == len(rows) * len(rows[0][1])
    assert {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in got} == {(0.0, 0.0, 0, 0.0)}


def test_whitening_of_a_line(spark):
    got = whitened_rows(whitening.whiten(frame(spark, [(i, [i / 4, i / 2]) for i in range(5)])))
    assert abs(got[0, 1]["whitened"]) == pytest.approx(math.sqrt(2)) and got[0, 1]["explained"] == pytest.approx(1)
    assert got[0, 2]["whitened"] == 0 and got[0, 2]["explained"] == 0 and got[0, 1]["identity_error"] < 1e-12


def test_whitening_of_nothing(spark):
    empty = whitening.whiten(frame(spark, []))
    assert empty.count() == 0 and empty.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_deviations_beyond_a_long(spark):
    rows = [(i, [1e15 * (-1) ** i, 1.0]) for i in range(4)]
    got = whitened_rows(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got[0, 1]["deviation"] is None
    assert int(got[0, 1]["deviation_exact"]) == (4 * 1024 * 10**15) ** 2 < 10**38
