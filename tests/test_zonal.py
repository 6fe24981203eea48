"""The zonal join by tiles against plain Python, and what its tasks hold."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftmap.operators import grid

SIZE = 0.5
JOBS = {"mean": lambda c, w, by: grid.zonal_weighted_mean(c, w, SIZE, by), "sum": lambda c, w, by: grid.zonal_sum(c, w, by)}


@pytest.fixture(scope="module")
def world(spark):
    """Cells on both sides of zero, some without value, place or region; regions that overlap, lie in several tiles or hold one cell twice."""
    rng = random.Random(5)
    cells = [(r, c, f"d{d}", m, rng.choice([None, rng.random() * 30 - 9])) for r in range(-5, 6) for c in range(-6, 5) for d in range(3) for m in (0, 1) if rng.random() < 0.8]
    cells += [(None, 1, "d0", 0, 4.0), (1, None, "d0", 0, 4.0), (900, 900, "d0", 0, 4.0), (0, 0, None, 0, 3.0), (50, 50, "d0", 0, None), (4, 3, "d1", None, 2.5)]
    cover = [(r, c, r * SIZE + 0.25, f"g{k}", rng.random()) for k in range(9) for r in range(-6, 7) for c in range(-6, 6) if rng.random() < 0.15]
    cover += [cover[0], (50, 50, 25.25, "empty", 1.0), (70, 70, 35.25, "nowhere", 1.0), (0, 0, 0.25, None, 0.5), (0, 0, 0.25, "g0", None), (None, 0, 0.25, "g0", 1.0)]
    return (
        (cells, spark.createDataFrame(cells, "cell_row int, cell_col int, date string, model int, value double").cache()),
        (cover, spark.createDataFrame(cover, "cell_row int, cell_col int, lat double, geo string, frac double").cache()),
    )


@pytest.mark.parametrize("by", [(), ("date",), ("date", "model")])
@pytest.mark.parametrize("job", JOBS)
def test_zonal_is_that_of_all_pairs(world, job, by):
    (cells, c), (cover, w) = world
    area = {r.lat: r.a for r in w.select("lat", grid.cell_area(F.col("lat"), SIZE).alias("a")).collect()}
    top, under = defaultdict(list), defaultdict(list)
    for r, k, date, model, v in cells:
        for wr, wk, lat, geo, frac in cover:
            if (r, k) != (wr, wk) or None in (r, k) or job == "mean" and v is None:
                continue
            key = (geo, *({"date": date, "model": model}[b] for b in by))
            weight = None if frac is None else frac * area[lat] if job == "mean" else frac
            top[key] += [] if None in (weight, v) else [v * weight]
            under[key] += [] if weight is None else [weight]
    want = {k: None if not x else sum(x) / (sum(under[k]) if job == "mean" else 1) for k, x in top.items()}
    got = {tuple(r)[:-1]: r.value for r in JOBS[job](c, w, by).collect()}
    assert got.keys() == want.keys() and {k for k, x in got.items() if x is None} == {k for k, x in want.items() if x is None}
    assert all(want[k] is None or abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("job", JOBS)
def test_cells_are_not_sorted_and_meet_by_tiles(spark, world, job):
    """A task that sorts its cells, or sums rows of places dealt out one by one, holds all of its input."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        (_, c), (_, w) = world
        plan = JOBS[job](c, w, ("date",))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Sort [" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan, plan
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "cell_row" in x or "cell_col" in x], plan
