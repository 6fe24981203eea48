"""The region effect against dense solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.operators import graph, model, region_effect


def lattice(spark, n):
    names = [f"n{i}{j}" for i in range(n) for j in range(n)]
    links = [(f"n{i}{j}", f"n{a}{b}") for i in range(n) for j in range(n) for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < n and 0 <= b < n]
    q = graph.laplacian_edges(spark.createDataFrame([(x,) for x in names], "geo string"), spark.createDataFrame(links, "src string, dst string"), 0.9)
    dense = np.zeros((n * n, n * n))
    for r in q.collect():
        dense[names.index(r.i), names.index(r.j)] += r.value
    return q, dense, names


def test_solve_graph(spark):
    q, dense, names = lattice(spark, 3)
    rng = np.random.default_rng(1)
    b = rng.standard_normal((3, 9))
    b[2] = 0
    rows = [(k, n, float(v)) for k in range(3) for n, v in zip(names, b[k], strict=True)]
    got = {(r.key, r.node): r.x for r in region_effect.solve_graph(q, spark.createDataFrame(rows, "key int, node string, v double"), tolerance=1e-18).collect()}
    want = np.linalg.solve(dense, b.T).T
    assert max(abs(got[k, n] - want[k, i]) for k in range(3) for i, n in enumerate(names)) < 1e-7
    with pytest.raises(ValueError, match="after 2 rounds"):
        region_effect.solve_graph(q, spark.createDataFrame(rows, "key int, node string, v double"), rounds=2)


def test_fit_is_the_dense_maximum(spark):
    """25 regions, some without rows and one with a third of them, against Newton steps on all unknowns."""
    q, dense, names = lattice(spark, 5)
    rng = np.random.default_rng(2)
    g = np.concatenate([rng.integers(3, 25, 600), np.full(300, 7)])
    t, land = rng.normal(0, 1, 900), rng.integers(1, 3, 900)
    p = 1 / (1 + np.exp(-(-0.5 + t + 0.7 * (land == 2) + np.sin(g / 9))))
    y = (rng.random(900) < p).astype(float)
    rows = [(names[a], float(b), int(c), int(d)) for a, b, c, d in zip(g, t, land, y, strict=True)] + [(names[0], None, 1, 1), (names[1], 0.0, 1, None)]
    df = spark.createDataFrame(rows, "geo string, t double, land int, presence int").repartition(4)
    coefficients, spatial = region_effect.fit_region_effect(df, q, ["t"], ["land"], tau=2.0, ridge=0.5)
    x = np.stack([np.ones(900), t, land == 1, land == 2], 1)
    z = np.eye(25)[g]
    full, weight = np.hstack([x, z]), np.zeros((29, 29))
    weight[1:4, 1:4], weight[4:, 4:] = 0.5 * np.eye(3), 2.0 * dense
    theta = np.zeros(29)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-full @ theta))
        theta += np.linalg.solve(full.T @ (full * (mu * (1 - mu))[:, None]) + weight, full.T @ (y - mu) - weight @ theta)
    assert [r.term for r in coefficients.collect()] == ["intercept", "t", "land=1", "land=2"]
    assert np.allclose([r.coefficient for r in coefficients.collect()], theta[:4], atol=1e-6)
    effect = {r.geo: r.spatial for r in spatial.collect()}
    assert max(abs(effect[n] - theta[4 + i]) for i, n in enumerate(names)) < 1e-6
    joined = model.spatial_effect_join(df.select("geo", F.lit(2000).alias("year"), "t"), spatial, ("geo",))
    assert joined.filter("spatial is null").count() == 0
    with pytest.raises(ValueError, match="lacks regions"):
        region_effect.fit_region_effect(df, q.filter("i <> 'n12' and j <> 'n12'"), ["t"])
