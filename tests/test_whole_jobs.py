"""Queries without SQL against direct solutions, over all their years."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.operators import graph
from driftmap.plans import registry
from driftmap.plans.fixtures import Views

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")


def solved(v, rows):
    """{(key, node): x} by a dense solve; rows: key, node, presence."""
    names = {r.geo: k for k, r in enumerate(v.region.collect())}
    m = 0.1 * np.eye(len(names))
    for r in v.edges.collect():
        m[names[r.src], names[r.dst]] -= 0.9
        m[names[r.src], names[r.src]] += 0.9
    by, out = defaultdict(dict), {}
    for key, node, presence in rows:
        by[key][node] = presence
    for key, there in by.items():
        a, b = ([n for n in there if (there[n] == 1) == on] for on in (False, True))
        ia, ib = [names[n] for n in a], [names[n] for n in b]
        x = np.linalg.solve(m[np.ix_(ia, ia)], -m[np.ix_(ia, ib)].sum(1)) if a else []
        out |= {(key, n): float(e) for n, e in zip(a, x, strict=True)} | {(key, n): 1.0 for n in b}
    return out


def close(got, want):
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


@tables
def test_harmonic_fill_query_is_the_direct_solution(spark):
    got = {(r.key, r.node): r.x for r in registry.QUERIES["harmonic_fill"](spark, MORE).collect()}
    v = Views(spark, MORE)
    close(got, solved(v, [(r.year_idx, r.geo, r.presence or 0) for r in v.presence.collect()]))


@tables
def test_proximity_queries_are_direct_solutions(spark):
    got = {(r.year_idx, r.geo): r.y_proximity_exp100 for r in registry.QUERIES["proximity_by_year"](spark, SMALL).collect()}
    drawn = {r.geo: r.y_proximity_exp100 for r in registry.QUERIES["proximity_from_draws"](spark, SMALL).collect()}
    v = Views(spark, SMALL)
    rows = [(r.year_idx, r.geo, r.presence or 0) for r in v.presence.collect()]
    first = min(y for y, _, _ in rows)
    close(got, {(y + 1, n): x for (y, n), x in solved(v, rows).items()} | {(first, n): 0.0 for _, n, _ in rows})
    mean = v.draws.groupBy("geo", "year_idx").agg(F.avg("p_fact").alias("m")).collect()
    last = max(r.year_idx for r in mean)
    on = {r.geo: int(r.m >= 0.5) for r in mean if r.year_idx == last}
    want = {n: x for (_, n), x in solved(v, [(last, n, p) for n, p in on.items()]).items()}
    if not on.get("G1") and not on.get("G2") and "G2" in want:
        want["G1"] = want["G2"]
    close(drawn, want)


@tables
def test_recurrent_prediction_goes_through_all_years(spark):
    got = defaultdict(dict)
    for r in registry.QUERIES["recurrent_prediction"](spark, SMALL).collect():
        got[r.scenario, r.year_idx].setdefault(r.geo, {})[r.draw] = r.p
    v = Views(spark, SMALL)
    panel = {(r.year_idx, r.geo): r for r in v.panel.collect()}
    for scenario, warmer in (("SSP126", 0.0), ("SSP370", 2.0)):
        years = sorted(y for s, y in got if s == scenario)
        assert {(y, n) for y in years for n in got[scenario, y]} == set(panel)
        for before, y in zip(years, years[1:], strict=False):
            x = solved(v, [(0, n, int(np.mean(list(p.values())) >= 0.5)) for n, p in got[scenario, before].items()])
            for n in got[scenario, y].keys() & got[scenario, before].keys():
                r = panel[y, n]
                for d, p in got[scenario, y][n].items():
                    z = (-1.5 + 0.05 * (r.temperature + warmer) + 0.2 * r.precipitation) * (1 + 0.01 * d) + 2 * x[0, n]
                    assert abs(p - 1 / (1 + np.exp(-z))) < 1e-4


def test_an_unfinished_fill_raises(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(12)], "geo string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + s}") for k in range(12) for s in (-1, 1) if 0 <= k + s < 12], "src string, dst string")
    known = nodes.select(F.lit(1).alias("key"), F.col("geo").alias("node"), (F.col("geo") == "n0").cast("int").alias("presence"))
    with pytest.raises(ValueError, match="after 2 rounds"):
        graph.harmonic_fill(graph.laplacian_edges(nodes, edges, 0.9), known, rounds=2)


def test_components_of_a_long_region_map(spark):
    """The queries' map of 10 columns at 2,500 regions, which is over 200 hops long."""
    at = {f"G{k}": (k // 10, k % 10) for k in range(1, 2501) if k % 10 != 3}
    there = {p: n for n, p in at.items()}
    links = [(n, there[i + a, j + b]) for n, (i, j) in at.items() for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (i + a, j + b) in there]
    nodes, edges = spark.createDataFrame([(n,) for n in at], "geo string"), spark.createDataFrame(links, "src string, dst string")
    east = {n for n, (_, j) in at.items() if j > 3}
    assert sorted(r.geo for r in graph.component_of(edges, "G4").collect()) == sorted(east)
    got = {r.geo: (r.component, r.size) for r in graph.connected_components(nodes, edges).collect()}
    assert got == {n: (1, len(east)) if n in east else (2, len(at) - len(east)) for n in at}


def test_fill_by_the_root_of_a_lattice(spark):
    side, on = 3, np.array([k == 2 for k in range(9)])
    at = {k: divmod(k, side) for k in range(side * side)}
    links = [(f"n{a}", f"n{b}") for a in at for b in at if abs(at[a][0] - at[b][0]) + abs(at[a][1] - at[b][1]) == 1]
    q = graph.laplacian_edges(spark.createDataFrame([(f"n{k}",) for k in at], "geo string"), spark.createDataFrame(links, "src string, dst string"), 0.9)
    known = spark.createDataFrame([(1, f"n{k}", int(on[k])) for k in at], "key int, node string, presence int")
    got = {r.node: r.x for r in graph.harmonic_fill(q, known, 0.5, tolerance=1e-12, accuracy=1e-4).collect()}
    m = np.zeros((len(at), len(at)))
    for r in q.collect():
        m[int(r.i[1:]), int(r.j[1:])] += r.value
    values, vectors = np.linalg.eigh(m)
    power = (vectors * np.sqrt(values)) @ vectors.T
    x = np.linalg.solve(power[np.ix_(~on, ~on)], -power[np.ix_(~on, on)].sum(1))
    assert np.abs(x - [got[f"n{k}"] for k in at if not on[k]]).max() < 1e-3
