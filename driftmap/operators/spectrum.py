"""The median eigenvalue of a sparse symmetric matrix kept as an edge table, by Lanczos quadrature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.operators.lineage import cut, drop

#: Squared length, as a share of the product's, under which a Lanczos vector counts as nothing.
NOTHING = 1e-12


def _signs(nodes: DataFrame, n: int, count: int) -> DataFrame:
    """probe, node, v: starting vectors of length 1 with signs by hash."""
    signs = nodes.withColumn("probe", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return signs.select("probe", "node", ((F.pmod(F.xxhash64("node", "probe"), F.lit(2)) * 2 - 1) / n**0.5).alias("v"))


def _with_product(q: DataFrame, state: DataFrame) -> DataFrame:
    """state's probe, node, v, old with w = Q v, by one aggregate, as a table."""
    zero = F.lit(0.0)
    product = q.join(state, q["j"] == state["node"]).select("probe", F.col("i").alias("node"), zero.alias("v"), zero.alias("old"), (F.col("value") * F.col("v")).alias("w"))
    both = product.unionByName(state.select("probe", "node", "v", "old", zero.alias("w")))
    return cut(both.groupBy("probe", "node").agg(*(F.sum(c).alias(c) for c in ("v", "old", "w"))))


def _coefficients(q: DataFrame, probes: DataFrame, steps: int) -> dict[int, tuple[list[float], list[float]]]:
    """probe -> diagonal and off-diagonal of its Lanczos matrix.

    A step is one join by node and one aggregate; six sums of products for each probe come to the driver.
    """
    found: dict[int, tuple[list[float], list[float]]] = {}
    names = (("w", "w"), ("w", "v"), ("w", "old"), ("v", "v"), ("v", "old"), ("old", "old"))
    sums = [F.sum(F.col(c) * F.col(d)).alias(c[0] + d[0]) for c, d in names]
    step = (F.col("w") - F.col("a") * F.col("v") - F.col("b") * F.col("old")) / F.col("size")
    state, turns = _with_product(q, probes.withColumn("old", F.lit(0.0))), []
    for done in range(steps):
        if done:
            turn = q.sparkSession.createDataFrame(turns, "probe int, a double, b double, size double")
            old, state = state, _with_product(q, state.join(turn, "probe").select("probe", "node", step.alias("v"), F.col("v").alias("old")))
            drop(old)
        turns = []
        for r in state.groupBy("probe").agg(*sums).collect():
            diagonal, off = found.setdefault(r["probe"], ([], []))
            a, b = r["wv"], off[-1] if off else 0.0
            left = r["ww"] + a * a * r["vv"] + b * b * r["oo"] - 2 * a * r["wv"] - 2 * b * r["wo"] + 2 * a * b * r["vo"]
            diagonal.append(a)
            off.append(left**0.5 if left > NOTHING * r["ww"] else 0.0)
            if off[-1]:  # a probe without a next vector ends here
                turns.append((r["probe"], a, b, off[-1]))
        if not turns:
            break
    drop(state)
    return found


def _median(coefficients: dict[int, tuple[list[float], list[float]]]) -> float:
    """Where the mean of the probes' spectral distributions reaches one half."""
    points = []
    for diagonal, off in coefficients.values():
        side = np.array(off[: len(diagonal) - 1])
        at, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(side, 1) + np.diag(side, -1))
        weight = vectors[0] ** 2
        points.append((at, np.cumsum(weight) - weight / 2))
    low, high = min(at[0] for at, _ in points), max(at[-1] for at, _ in points)
    for _ in range(60):
        middle = (low + high) / 2
        share = np.mean([np.interp(middle, at, below, left=0.0, right=1.0) for at, below in points])
        low, high = (middle, high) if share < 0.5 else (low, middle)
    return float((low + high) / 2)


def _dense_median(q: DataFrame) -> float:
    rows = q.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    names = {n: k for k, n in enumerate({r["i"] for r in rows})}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names[r["i"]], names[r["j"]]] = r["value"]
    return float(np.median(np.linalg.eigvalsh(m)))


def median_eigenvalue(q: DataFrame, steps: int = 24, entries: int = 50_000, least: int = 4) -> float | None:
    """The median eigenvalue of a symmetric matrix i, j, value, of which each node has an entry as i; None without rows.

    A matrix of at most the given entries, zeros counted, is solved on the driver. Of a
    larger one, starting vectors are signs by the nodes' hashes, so that reruns agree, as many
    as have the given entries together, at least the least. Each gives a distribution of
    eigenvalues by Gauss quadrature, joined between its points; their mean is taken. The share
    of eigenvalues below the result is off one half by about 1 / (2 * sqrt(entries)).
    """
    q = cut(q.select("i", "j", "value"))
    nodes = q.select(F.col("i").alias("node")).distinct()
    n = nodes.count()
    if not n:
        found = None
    elif n * n <= entries:
        found = _dense_median(q)
    else:
        found = _median(_coefficients(q, _signs(nodes, n, max(least, -(-entries // n))), steps))
    drop(q)
    return found


def noise_shift(q: DataFrame, share: float = 5.0) -> float:
    """What stabilises a fill by Q: the median eigenvalue over the given number; 0 for an empty Q."""
    return (median_eigenvalue(q) or 0.0) / share
