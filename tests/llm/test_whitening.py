"""Whitening against a dense solver, exact values, and odd inputs."""

import math
import random

import numpy as np
import pytest

from driftmap.llm import whitening as s

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def dense(vectors, k=8):
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, sums, strict=True)] for r in x])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, sums, strict=True)) for r in x]
    return n, deviation, e[order], centred @ axes[:, order] / np.sqrt(np.maximum(e[order], 1e-300)), e[order] / e.sum()


def compared(rows, vectors, ids, k=8):
    n, deviation, e, white, explained = dense(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * min(k, len(e))
    for c in range(len(e)):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        assert np.allclose(mine, white[:, c], atol=1e-8) or np.allclose(mine, -white[:, c], atol=1e-8)
    for i, d in zip(ids, deviation, strict=True):
        assert got[i, 1].deviation == d and got[i, 1].n == n
    for r in rows:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len({r.identity_error for r in rows}) == 1


def test_matches_dense_solver(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((500, 20)) * np.linspace(3, 0.1, 20) @ np.linalg.qr(rng.standard_normal((20, 20)))[0]).tolist()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(6)
    compared(s.whiten(df).collect(), vectors, range(500))
    compared(s.whiten(df, components=3).collect(), vectors, range(500), 3)


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    compared(s.op11_lanczos_whitening(spark, "/root/testdata/sf0.001").collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_bad_rows_go_and_copies_count(spark):
    rng = random.Random(2)
    good = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    good += [good[0]] * 30 + [[1e9, 0.0, 0.0, 1.0, 2.0]]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [1.0, math.inf, 0.0, 0.0, 0.0], [math.nan] * 5, [1.0, 2.0], [3e30, 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(1000 + i, v, 0) for i, v in enumerate(bad)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as ids", "3 as x", "4 as component").repartition(5)
    got = s.whiten(df).collect()
    assert {r.vec_id for r in got} == set(range(71))
    want = dense(good)[1]
    assert [next(r.deviation for r in got if r.vec_id == i) for i in (0, 40, 70)] == [d if d < 1 << 63 else None for d in (want[0], want[40], want[70])]


def test_deviations_are_exact_or_null():
    x = np.array([[1 << 38, 5], [-(1 << 38), 7], [3, 4], [100, 100]])
    centre = s.Centre(4, tuple(int(c) for c in x.sum(0)))
    want = [sum((4 * int(a) - b) ** 2 for a, b in zip(r, centre.sums, strict=True)) for r in x]
    assert s._deviations(x, centre).to_pylist() == [d if d < 1 << 63 else None for d in want]
    assert None in s._deviations(x, centre).to_pylist() and s._deviations(x, centre).to_pylist()[2] is not None


@pytest.mark.parametrize("kind", ["equal deviations", "dependent", "few rows", "spread"])
def test_bidiagonalise(kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12))
    if kind == "equal deviations":
        x = np.linalg.qr(x)[0] * np.array([5, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1, 1.0])
        x = x @ np.linalg.qr(rng.standard_normal((12, 12)))[0]
    elif kind == "dependent":
        x[:, 6:] = x[:, :6] @ rng.standard_normal((6, 6))
    elif kind == "few rows":
        x = x[:4]
    else:
        x = x * 10.0 ** -np.arange(12)
    b, v = s.bidiagonalise(lambda q: (x.T @ (x @ q), float((x @ q) @ (x @ q))), 12)
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-12)
    assert np.count_nonzero(np.triu(b, 2)) == np.count_nonzero(np.tril(b, -1)) == 0
    want = np.zeros(12)
    got = np.linalg.svd(x, compute_uv=False)
    want[: len(got)] = got
    assert np.allclose(np.linalg.svd(b, compute_uv=False), want, atol=1e-9 * want[0])


def test_without_variance_nothing_comes(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, [(1, None, 0)]):
        df = s.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == []
        assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def test_fewer_components_than_asked_for(spark):
    vectors = [[float(i), 2.0 * i, 1.0] for i in range(20)]
    got = s.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-9
