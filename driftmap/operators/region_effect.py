"""Presence model with a region effect that is smooth over a graph: penalised logistic regression by Newton steps.

The effect u of regions has the penalty tau/2 u'Qu, coefficients a ridge. A step's equations
are M du + C db = g and C' du + A db = h with M = tau Q + D: D and C are sums by region, A and
h sums over all rows, as small as the number of terms. Conjugate gradients on the edge table
solve M for g and the columns of C together; what is left is a small dense system.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.operators.lineage import cut, drop

STEPS = 50


def solve_graph(q: DataFrame, b: DataFrame, rounds: int = 1000, tolerance: float = 1e-12) -> DataFrame:
    """key, node, x of Q x = b for every key; Q (i, j, value) symmetric and positive definite, b: key, node, v.

    Conjugate gradients, preconditioned by the diagonal, all keys together: a join with the
    edges and two sums a round, until every key's squared residual is under tolerance times
    that of b. A ValueError is raised if that takes more than the given rounds.
    """
    diagonal = q.filter("i = j").groupBy(F.col("i").alias("node")).agg((1 / F.sum("value")).alias("d"))
    state = cut(b.join(diagonal, "node").select("key", "node", F.lit(0.0).alias("x"), F.col("v").alias("r"), (F.col("v") * F.col("d")).alias("p"), "d"))
    size = cut(state.groupBy("key").agg(F.sum(F.col("r") * F.col("r")).alias("bb")).filter("bb > 0"))
    left, done = (1.0 if size.head(1) else 0.0), 0
    while left >= tolerance:
        if done == rounds:
            raise ValueError(f"a squared residual of {left} times the right-hand side is left after {rounds} rounds")
        done += 1
        ap = q.join(state.select("key", F.col("node").alias("j"), "p"), "j").groupBy("key", F.col("i").alias("node")).agg(F.sum(F.col("value") * F.col("p")).alias("ap"))
        s = state.join(ap, ["key", "node"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
        product = lambda a, b, c: F.sum(F.col(a) * F.col(b) * F.col(c))
        sums = s.groupBy("key").agg(product("r", "d", "r").alias("rz"), F.sum(F.col("p") * F.col("ap")).alias("pap"), product("r", "d", "ap").alias("rap"), product("ap", "d", "ap").alias("aap"))
        step = F.when(F.col("pap") > 0, F.col("rz") / F.col("pap")).otherwise(0.0)
        after = F.greatest(F.col("rz") - 2 * step * F.col("rap") + step * step * F.col("aap"), F.lit(0.0))  # of the residual to come
        turn = F.when(F.col("rz") > 0, after / F.col("rz")).otherwise(0.0)
        r = F.col("r") - step * F.col("ap")
        moved = s.join(sums, "key").select("key", "node", (F.col("x") + step * F.col("p")).alias("x"), r.alias("r"), (r * F.col("d") + turn * F.col("p")).alias("p"), "d")
        old, state = state, cut(moved)
        drop(old)
        left = state.groupBy("key").agg(F.sum(F.col("r") * F.col("r")).alias("rr")).join(size, "key").agg(F.max(F.col("rr") / F.col("bb"))).first()[0] or 0.0
    drop(size)
    return state.select("key", "node", "x")


def _sums(batches: Iterator[pa.RecordBatch], beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each region of a batch its weight, score and weighted terms; in a row without region the log-likelihood, scores of terms and their weighted products."""
    k = len(beta)
    for b in batches:
        x = b.column("x").flatten().to_numpy().reshape(-1, k)
        y, u = (b.column(c).to_numpy() for c in ("y", "u"))
        eta = x @ beta + u
        mu = 1 / (1 + np.exp(-eta))
        w, r = mu * (1 - mu), y - mu
        codes = b.column("geo").dictionary_encode()
        at, n = codes.indices.to_numpy(), len(codes.dictionary)
        each = np.stack([np.bincount(at, v, n) for v in (w, r, *(w * c for c in x.T))], 1)
        whole = np.concatenate([[(y * eta - np.logaddexp(0, eta)).sum()], r @ x, (x.T @ (w[:, None] * x)).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([*codes.dictionary.to_pylist(), None], pa.string()), pa.array([*each.tolist(), whole.tolist()], pa.list_(pa.float64()))], ["geo", "v"]
        )


def _design(df: DataFrame, fixed: Sequence[str], binned: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """geo, y, x of rows with a response and all terms, and the terms; the levels of a binned column are as many as its bins."""
    known = df.filter("presence is not null and geo is not null").dropna(subset=[*fixed, *binned])
    terms, cols = ["intercept", *fixed], [F.lit(1.0), *(F.col(c).cast("double") for c in fixed)]
    for c in binned:
        for level in sorted(r[0] for r in known.select(F.col(c).cast("string")).distinct().collect()):
            terms.append(f"{c}={level}")
            cols.append((F.col(c).cast("string") == level).cast("double"))
    return known.select("geo", F.col("presence").cast("double").alias("y"), F.array(*cols).alias("x")), terms


def fit_region_effect(df: DataFrame, q: DataFrame, fixed: Sequence[str], binned: Sequence[str] = (), tau: float = 1.0, ridge: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(term, coefficient) and (geo, spatial): the maximum of the log-likelihood less ridge/2 |b|^2 (without the intercept) and tau/2 u'Qu.

    q: i, j, value of a positive definite matrix over the regions, such as laplacian_edges
    with a share below 1; regions of df that it lacks are an error. A region without rows
    gets its effect from its neighbours. Rows without a presence or a term don't train. Newton
    steps are halved until the target grows; a ValueError is raised if STEPS don't do.
    """
    spark = df.sparkSession
    design, terms = _design(df, fixed, binned)
    rows, k = cut(design), len(terms)
    nodes = q.select(F.col("i").alias("geo")).distinct()
    if rows.join(nodes, "geo", "left_anti").head(1):
        raise ValueError("the graph lacks regions of the data")
    beta, u = np.zeros(k), cut(nodes.withColumn("u", F.lit(0.0)))
    penalty = np.array([0.0, *[ridge] * (k - 1)])
    change = moves = before = None
    for _ in range(STEPS):
        summed = rows.join(u, "geo").select("geo", "y", "x", "u").mapInArrow(partial(_sums, beta=beta), "geo string, v array<double>")
        width = 1 + k + k * k
        sums = cut(summed.groupBy("geo").agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(2 + k))).alias("v")).filter("geo is not null"))
        total = np.zeros(width)
        for place, value in summed.filter("geo is null").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col")).collect():
            total[place] = value
        qu = cut(q.join(u.select(F.col("geo").alias("j"), "u"), "j").groupBy(F.col("i").alias("geo")).agg((tau * F.sum(F.col("value") * F.col("u"))).alias("qu")))
        smooth = qu.join(u, "geo").agg(F.sum(F.col("qu") * F.col("u"))).first()[0] or 0.0
        target = total[0] - (penalty * beta**2).sum() / 2 - smooth / 2
        if before is not None and not target >= before - 1e-12 * abs(before):  # half a step back
            change = change / 2
            beta = beta - change
            moves = moves.withColumn("du", F.col("du") / 2)
            last, u = u, cut(u.join(moves, "geo").select("geo", (F.col("u") - F.col("du")).alias("u")))
            drop(last, sums, qu)
            continue
        if change is not None and np.abs(change).max() < 1e-8 and (moves.agg(F.max(F.abs("du"))).first()[0] or 0.0) < 1e-8:
            drop(sums, qu, rows, moves)
            found = spark.createDataFrame([(t, float(b)) for t, b in zip(terms, beta, strict=True)], "term string, coefficient double")
            return found, u.select("geo", F.col("u").alias("spatial"))
        before = target
        own = nodes.join(sums, "geo", "left").join(qu, "geo", "left")
        at = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
        sides = own.select(F.col("geo").alias("node"), F.posexplode(F.array(at(1) - F.coalesce("qu", F.lit(0.0)), *(at(2 + i) for i in range(k)))).alias("key", "v"))
        matrix = cut(q.select("i", "j", (tau * F.col("value")).alias("value")).unionByName(sums.select(F.col("geo").alias("i"), F.col("geo").alias("j"), F.get("v", F.lit(0)).alias("value"))).groupBy("i", "j").agg(F.sum("value").alias("value")))
        x = solve_graph(matrix, sides, tolerance=1e-6)  # steps needn't be exact: the next one mends what is left
        cross = np.zeros((k, k + 1))
        for key, i, value in x.join(sums.select(F.col("geo").alias("node"), F.posexplode(F.slice("v", 3, k)).alias("i", "c")), "node").groupBy("key", "i").agg(F.sum(F.col("x") * F.col("c"))).collect():
            cross[i, key] = value
        schur = total[1 + k :].reshape(k, k) + np.diag(penalty) - cross[:, 1:]
        change = np.linalg.solve(schur, total[1 : 1 + k] - penalty * beta - cross[:, 0])
        beta = beta + change
        share = F.get(F.array(F.lit(1.0), *(F.lit(float(-c)) for c in change)), F.col("key"))
        if moves is not None:
            drop(moves)
        moves = cut(x.groupBy(F.col("node").alias("geo")).agg(F.sum(F.col("x") * share).alias("du")))
        last, u = u, cut(u.join(moves, "geo").select("geo", (F.col("u") + F.col("du")).alias("u")))
        drop(last, sums, qu, matrix, x)
    raise ValueError(f"no maximum after {STEPS} steps")
