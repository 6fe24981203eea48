"""Median eigenvalues, the noise that follows from them, and fills by powers between 0 and 1, against dense solutions."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.operators import graph, spectrum
from driftmap.plans import registry
from driftmap.plans.fixtures import Views

TABLES = "/root/testdata/sf0.001"


def lattice(spark, rows, columns, mixing=0.9):
    at = [(i, j) for i in range(rows) for j in range(columns)]
    links = [(f"n{i}_{j}", f"n{a}_{b}") for i, j in at for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < rows and 0 <= b < columns]
    nodes = spark.createDataFrame([(f"n{i}_{j}",) for i, j in at], "geo string")
    return graph.laplacian_edges(nodes, spark.createDataFrame(links, "src string, dst string"), mixing)


def dense(q):
    rows = q.collect()
    names = {n: k for k, n in enumerate(sorted({r.i for r in rows}))}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names[r.i], names[r.j]] += r.value
    return m, names


@pytest.mark.parametrize(("rows", "columns"), [(20, 20), (9, 11)])
def test_median_of_a_lattice(spark, rows, columns):
    """400 nodes are probed by signs; the matrix of 99 is small enough for the driver."""
    q = lattice(spark, rows, columns)
    want = np.median(np.linalg.eigvalsh(dense(q)[0]))
    assert spectrum.median_eigenvalue(q) == pytest.approx(want, rel=0.01)


def test_median_of_weighted_links_and_lonely_nodes(spark):
    """Components of their own, one of them a single node, and a matrix without rows."""
    rng = np.random.default_rng(5)
    links = [(f"a{k}", f"a{(k + s) % 60}", float(rng.integers(1, 9))) for k in range(60) for s in (1, 7)] + [("b0", "b1", 2.0)]
    q = graph.links_to_laplacian(spark.createDataFrame(links, "i string, j string, weight double"))
    q = q.withColumn("value", F.col("value").cast("double")).unionByName(spark.createDataFrame([("c", "c", 3.5)], "i string, j string, value double"))
    assert spectrum.median_eigenvalue(q) == pytest.approx(np.median(np.linalg.eigvalsh(dense(q)[0])), rel=0.01)
    assert spectrum.median_eigenvalue(q.filter("i = 'c'")) == pytest.approx(3.5)
    assert spectrum.median_eigenvalue(q.limit(0)) is None
    assert spectrum.noise_shift(q.limit(0)) == 0


def test_steps_end_where_nothing_is_left(spark):
    """A multiple of the identity has one eigenvalue; each probe ends after one step."""
    q = spark.range(500).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.5).alias("value"))
    assert spectrum.median_eigenvalue(q) == pytest.approx(2.5)


@pytest.mark.parametrize("e", [0.3, 0.75])
def test_fill_by_a_power_below_one(spark, e):
    q = lattice(spark, 3, 3)
    m, names = dense(q)
    on = np.array([n == "n0_2" for n in names])
    known = spark.createDataFrame([(1, n, int(on[k])) for n, k in names.items()], "key int, node string, presence int")
    got = {r.node: r.x for r in graph.harmonic_fill(q, known, e, tolerance=1e-12, accuracy=1e-4).collect()}
    values, vectors = np.linalg.eigh(m)
    power = (vectors * values**e) @ vectors.T
    x = np.linalg.solve(power[np.ix_(~on, ~on)], -power[np.ix_(~on, on)].sum(1))
    assert np.abs(x - [got[n] for n, k in names.items() if not on[k]]).max() < 1e-3


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_fill_with_noise_is_the_direct_solution(spark):
    got = {(r.key, r.node): r.x for r in registry.QUERIES["harmonic_fill_with_noise"](spark, TABLES).collect()}
    v = Views(spark, TABLES)
    m, names = dense(graph.laplacian_edges(v.region, v.edges, 0.9))
    m = m + np.median(np.linalg.eigvalsh(m)) / 5 * np.eye(len(m))
    rows = [(r.year_idx, r.geo, r.presence or 0) for r in v.presence.collect()]
    assert {(y, n) for y, n, _ in rows} == set(got)
    for year in {y for y, _, _ in rows}:
        there = {n: p for y, n, p in rows if y == year}
        free, ones = ([names[n] for n in there if (there[n] == 1) == on] for on in (False, True))
        x = np.linalg.solve(m[np.ix_(free, free)], -m[np.ix_(free, ones)].sum(1)) if ones else np.zeros(len(free))
        # the noise is within 1 % of that of the dense eigenvalues
        assert all(abs(got[year, n] - want) < 0.005 for n, want in zip((n for n in there if there[n] != 1), x, strict=True))
