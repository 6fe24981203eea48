"""Operators on tiny frames worked out by hand, and against NumPy where SQL has no form."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.operators import attribution, binning, climate, graph, grid, landpop, mobility, model, panel, validation
from driftmap.sources import tables


def lattice(spark, n=4):
    nodes = [(f"n{i}{j}",) for i in range(n) for j in range(n)]
    edges = [(f"n{i}{j}", f"n{a}{b}") for i in range(n) for j in range(n) for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < n and 0 <= b < n]
    return spark.createDataFrame(nodes, "geo string"), spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize("exponent", [1, 2])
def test_harmonic_fill_is_numpys(spark, exponent):
    nodes, edges = lattice(spark)
    q = graph.laplacian_edges(nodes, edges, 0.9)
    names = sorted(r.geo for r in nodes.collect())
    m = np.zeros((16, 16))
    for r in q.collect():
        m[names.index(r.i), names.index(r.j)] = r.value
    m = np.linalg.matrix_power(m, exponent) + 0.05 * np.eye(16)
    there = [0, 7]
    away = [k for k in range(16) if k not in there]
    x = np.ones(16)
    x[away] = np.linalg.solve(m[np.ix_(away, away)], -m[np.ix_(away, there)] @ np.ones(2))
    known = spark.createDataFrame([(k, n, int(i in there and k == 1)) for k in (1, 2) for i, n in enumerate(names)], "key int, node string, presence int")
    got = {(r.key, r.node): r.x for r in graph.harmonic_fill(q, known, exponent, 0.05, 30).collect()}
    assert all(abs(got[1, n] - x[i]) < 1e-4 for i, n in enumerate(names))
    assert all(got[2, n] == 0 for n in names)


def test_flux_rows_sum_to_their_share(spark):
    regions = spark.createDataFrame([(f"r{i}", float(i * i % 7), float(i)) for i in range(6)], "geo string, longitude double, latitude double")
    pop = regions.select("geo", F.lit(2000).alias("year"), (F.col("latitude") * 10 + 5).alias("population"))
    flux = mobility.radiation_flux(mobility.pairwise_distance(regions), pop)
    total = sum(r.population for r in pop.collect())
    share = {r.geo: r.population / total for r in pop.collect()}
    for r in flux.groupBy("i").agg(F.sum("prob").alias("p"), F.min("flux").alias("f")).collect():
        assert abs(r.p - (1 - share[r.i])) < 1e-9 and r.f >= 0


def test_zero_population_has_no_flux(spark):
    regions = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 5.0, 0.0)], "geo string, longitude double, latitude double")
    pop = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 1, 9)], "geo string, year int, population int")
    got = {(r.i, r.j): r.flux for r in mobility.radiation_flux(mobility.pairwise_distance(regions), pop).collect()}
    assert got["a", "b"] == 0 and got["c", "a"] == 0


def test_moving_average_needs_whole_windows(spark):
    rows = [("g", 2000, d, None if d == 3 else float(d)) for d in range(1, 8)]
    df = spark.createDataFrame(rows, "geo string, year int, date int, t double")
    assert climate.moving_average_mean(df, "t", 4).first().t_ma_mean == 5.5  # only the window of 4 to 7 is whole
    assert climate.moving_average_mean(df, "t", 30).first().t_ma_mean is None


def test_delta_of_the_same_series_is_the_observed_mean(spark):
    df = spark.createDataFrame([("g", y, 10.0, 2.0, 60.0) for y in range(1996, 2001)], "geo string, year int, t double, p double, h double")
    r = climate.stitch_future(df, df, 1996, 1998, 1999, {"t": "additive", "p": "ratio", "h": "logit"}).first()
    assert (round(r.t, 9), round(r.p, 9), round(r.h, 6)) == (10, 2, 60) and r.year_idx == 1


def test_attribution_is_null_where_the_factual_mean_is_zero(spark):
    df = spark.createDataFrame([("g", 1, 1, 1, 0.0, 0.2), ("g", 1, 1, 2, 0.6, 0.2)], "geo string, region_id int, year_idx int, draw int, p_fact double, p_cf double")
    r = attribution.attribution_by_region(df).first()
    assert abs(r.af_mean - 0.4) < 1e-12 and abs(r.af_pct_upr - 40) < 1e-9


def test_invasion_years(spark):
    rows = [("never", 1, 0), ("never", 2, None), ("left", 1, 1), ("left", 2, 0), ("back", 1, 1), ("back", 2, 0), ("back", 3, 1), ("first", 1, None), ("first", 2, 1), ("first", 3, 1), ("unknown", 1, None)]
    got = {r.geo: r.invasion_year for r in attribution.invasion_year(spark.createDataFrame(rows, "geo string, year int, presence int"), 2024).collect()}
    assert got == {"never": None, "left": 2024, "back": 3, "first": 2, "unknown": None}


def test_bins_clamp_and_close_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    spec = binning.fit_equal_width_bins(df, ["x"], 5)
    new = spark.createDataFrame([(-3.0,), (0.0,), (2.0,), (2.1,), (10.0,), (99.0,), (None,)], "x double")
    assert [r.x_bin for r in binning.assign_bins(new, spec, "x").collect()] == [1, 1, 1, 2, 5, 5, None]
    assert [r.x_bin for r in binning.assign_bins(new, spec, "x", include_lowest=False).collect()] == [None, None, 1, 2, 5, 5, None]
    saved = binning.save_bin_spec(df, ["x"], 5)
    assert saved.first().numbers == [1, 1, 1, 2, 2]


def test_auc_with_ties_and_one_class(spark):
    rows = [(1, 0.9, 1), (1, 0.5, 1), (1, 0.5, 0), (1, 0.1, 0), (2, 0.3, 1), (2, 0.4, 1), (1, 0.7, None)]
    got = {r.fold: r.auc for r in validation.auc(spark.createDataFrame(rows, "fold int, p double, presence int"), ["fold"]).collect()}
    assert got == {1: 0.875, 2: None}


def test_level_shift_is_the_regressions(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=7)
    rows = [("g", 1995 + k, "historical" if k < 4 else "SSP370", float(y[k])) for k in range(7)]
    x = np.stack([np.ones(7), np.arange(7.0), (np.arange(7) >= 4).astype(float)], 1)
    want = np.linalg.lstsq(x, y, rcond=None)[0][2]
    assert abs(landpop.regional_level_shift(spark.createDataFrame(rows, "geo string, year int, scenario string, v double"), ["v"]).first().shift - want) < 1e-9


def test_population_trend_is_the_curve(spark):
    rows = [("g", 2000 + k, float(np.exp(3 + 0.1 * k))) for k in range(6)] + [("few", 2000, 5.0), ("few", 2001, 0.0)]
    df = spark.createDataFrame(rows, "geo string, year int, population double")
    got = landpop.extrapolate_next_year(landpop.fit_population_trend(df), 2006).collect()
    assert [r.geo for r in got] == ["g"] and abs(got[0].population - np.exp(3.6)) < 1e-6


def test_population_trends_are_least_squares(spark):
    """200 random series, some with jumps, copies of years and growth of all kinds, against a search over the slope."""
    rng = np.random.default_rng(4)
    rows, series = [], {}
    for g in range(200):
        years = np.sort(rng.choice(np.arange(1990, 2015), rng.integers(3, 12), replace=False))
        y = np.exp(rng.uniform(0, 12) + rng.normal(0, 0.15) * (years - 2000) + rng.normal(0, rng.choice([0.01, 0.3, 1.0]), len(years)))
        if g % 10 == 0:
            y[len(y) // 2 :] *= 50
        if g % 7 == 0:
            years, y = np.append(years, years[0]), np.append(y, y[0] * 1.1)
        series[f"g{g}"] = years, y
        rows += [(f"g{g}", int(a), float(b)) for a, b in zip(years, y, strict=True)]
    got = {r.geo: r for r in landpop.fit_population_trend(spark.createDataFrame(rows, "geo string, year int, population double").repartition(3)).collect()}
    assert len(got) == 200 and sum(r.converged for r in got.values()) >= 198
    for g, (years, y) in series.items():
        r, x = got[g], years - years.mean()
        if not r.converged:
            assert r.a is None and r.b is None and r.s2 is None
            continue
        assert abs(r.mean_year - years.mean()) < 1e-9 and r.n == len(y)

        def rss(b, x=x, y=y):
            e = np.exp(np.outer(b, x))
            return (y * y).sum() - ((e * y).sum(1) / np.sqrt((e * e).sum(1))) ** 2

        mine = ((y - np.exp(r.a + r.b * x)) ** 2).sum()
        near = rss(r.b + np.linspace(-0.05, 0.05, 201))
        assert mine <= near.min() * (1 + 1e-9) + 1e-9 * (y * y).sum()  # a minimum
        assert abs(r.s2 - mine / max(len(y) - 2, 1)) <= 1e-6 * r.s2 + 1e-12 * (y * y).sum()


def test_trend_of_a_jump_is_found_or_flagged(spark):
    rows = [("jump", 2000 + k, v) for k, v in enumerate([1.0, 1.0, 1.0, 1.0, 1000.0])] + [("last", 2000 + k, v) for k, v in enumerate([5.0, 5.0, 1e-3])]
    got = {r.geo: r for r in landpop.fit_population_trend(spark.createDataFrame(rows, "geo string, year int, population double")).collect()}
    for r in got.values():
        assert r.converged == (r.a is not None)
    r, x, y = got["jump"], np.arange(5) - 2.0, np.array([1, 1, 1, 1, 1000.0])
    mu = np.exp(r.a + r.b * x)
    assert abs((mu * (y - mu)).sum()) < 1e-4 and abs((x * mu * (y - mu)).sum()) < 1e-4
    assert landpop.fit_population_trend(spark.createDataFrame([], "geo string, year int, population double")).collect() == []


def _write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def test_daily_files_of_many_years_in_one_read(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "tas_mean_1995.csv", "X,Location,1995-01-01,1995-01-02\n1,A,1.5,2\n2,\"B, the \"\"b\"\"\",,x\n")
    _write(folder, "tas_mean_1996.csv", '"Location","1996-02-29","1996-01-01"\n"A","3","4"\n')
    _write(folder, "tas_mean_1997.csv", "X1997.01.01,Location\r\n7,C\r\n\r\n")
    got = sorted(map(tuple, tables.read_daily_csv(spark, str(folder)).collect()), key=repr)
    day = datetime.date
    assert got == sorted(
        [("A", day(1995, 1, 1), 1.5, 1995), ("A", day(1995, 1, 2), 2.0, 1995), ('B, the "b"', day(1995, 1, 1), None, 1995), ('B, the "b"', day(1995, 1, 2), None, 1995),
         ("A", day(1996, 2, 29), 3.0, 1996), ("A", day(1996, 1, 1), 4.0, 1996), ("C", day(1997, 1, 1), 7.0, 1997)],
        key=repr,
    )
    _write(tmp_path / "bad", "tas_mean_1995.csv", "A,1\n")
    with pytest.raises(Exception, match="no header in"):
        tables.read_daily_csv(spark, str(tmp_path / "bad")).collect()


def by_hand_levels(p, y, by_quantiles, n_intervals, n_min, min_range):
    """Windows as they are widened one by one."""
    p, y, out = np.array(p), np.array([np.nan if v is None else v for v in y]), []
    breaks = [k / n_intervals for k in range(n_intervals + 1)]
    wide = next(k for k, b in enumerate(breaks) if b >= (0.2 if by_quantiles else 0.05))
    for a, z in zip(breaks[: len(breaks) - wide], breaks[wide:], strict=True):
        low, high = (np.quantile(p, [a, z]) if by_quantiles else (a, z))
        if not by_quantiles:
            a, z = (p <= a).mean(), (p <= z).mean()
        inside = lambda low, high: (p >= low) & (p <= high)
        for done in (lambda low, high: inside(low, high).sum() >= n_min, lambda low, high: high - low >= min_range):
            for _ in range(20_000):
                if done(low, high):
                    break
                low, high = max(0.0, low / 1.05), min(1.0, high * 1.05)
        i = inside(low, high)
        out.append((i.sum(), a, z, low, high, p[i].mean(), np.nanmean(y[i])))
    return out


@pytest.mark.parametrize("by_quantiles, n_intervals, n_min, min_range", [(True, 20, 40, 0.1), (False, 40, 25, 0.05), (True, 10, 150, 0.5), (False, 20, 90, 0.3)])
def test_calibration_levels(spark, by_quantiles, n_intervals, n_min, min_range):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.beta(0.5, 3, 250), np.repeat(0.25, 30), rng.random(20)]).tolist()
    y = [None if k % 9 == 0 else int(rng.random() < v) for k, v in enumerate(p)]
    df = spark.createDataFrame([*zip(p, y, strict=True), (None, 1), (float("nan"), 0)], "p double, presence int").repartition(4).withColumn("late", F.col("presence"))
    got = [tuple(r)[1:8] for r in validation.calibration_levels(df, by_quantiles, n_intervals, n_min, min_range).collect()]
    want = list(dict.fromkeys(by_hand_levels(p, y, by_quantiles, n_intervals, n_min, min_range)))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and np.allclose(np.array(g[1:], float), np.array(w[1:], float), rtol=1e-12, atol=1e-12)
    both = validation.calibration_levels(df, by_quantiles, n_intervals, n_min, min_range, original="late").collect()
    assert all(r.empirical_original == r.empirical and r.reason is None for r in both)


def test_calibration_says_what_it_cannot_do(spark):
    few = spark.createDataFrame([(0.5, 1), (0.25, 0), (0.0, 0)], "p double, presence int")
    assert {r.reason for r in validation.calibration_levels(few, False, 20).collect()} == {"fewer rows than n_min"}
    zeros = spark.createDataFrame([(0.0, 0)] * 9 + [(0.3, 1)], "p double, presence int")
    got = validation.calibration_levels(zeros, True, 10, n_min=2).collect()
    assert [r.reason for r in got][0] == "narrower than min_range" and got[-1].reason is None
    assert validation.calibration_levels(few.filter("false")).collect() == []
    curve = validation.calibration_curve(few, [0.1, 0.9], 0.001, 2).collect()
    assert [(r.level, r.n) for r in curve] == [(0.1, 2), (0.9, 2)]
    assert [(r.p_lower, r.p_upper, r.n) for r in validation.calibration_curve(few, [0.5], 0.1, 9).collect()] == [(0.0, 1.0, 3)]


def test_ranks_within_groups(spark):
    """A group of nine tenths of the rows, ties, null groups and groups of one class."""
    rng = random.Random(6)
    rows = [(1, round(rng.random(), 2), rng.randrange(2)) for _ in range(900)] + [(2, 0.5, 1)] * 40 + [(None, rng.random(), rng.randrange(2)) for _ in range(60)] + [(3, 0.1, None)]
    df = spark.createDataFrame(rows, "fold int, p double, presence int").repartition(5)
    auc = {r.fold: r.auc for r in validation.auc(df, ["fold"]).collect()}
    for f in (1, None):
        one, zero = ([p for g, p, y in rows if g == f and y == k] for k in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero))
        assert abs(auc[f] - want) < 1e-12
    assert auc[2] is None
    roc = {(r.fold, r.threshold): (r.tpr, r.fpr) for r in validation.roc_curve(df, ["fold"]).collect()}
    for f, t in [(1, 0.25), (1, 0.99), (2, 0.5)]:
        want = [(lambda v: sum(p >= t for p in v) / len(v) if v else None)([p for g, p, y in rows if g == f and y == k]) for k in (1, 0)]
        assert roc[f, t] == (pytest.approx(want[0]), want[1] and pytest.approx(want[1]))
    strength = mobility.link_strength_percentile(df.withColumn("w", F.col("p") - 0.5), "w", ["fold"]).collect()
    assert len(strength) == len(rows)
    sizes = [abs(p - 0.5) for g, p, _ in rows if g == 1]
    for r in strength[:50]:
        if r.fold == 1:
            assert abs(r.strength - sum(s <= abs(r.w) for s in sizes) / 900) < 1e-12
    plan = validation.auc(df, ["fold"])._jdf.queryExecution().toString()
    assert "windowspecdefinition(fold" not in plan


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 1), 1) for _ in range(3000)] + [5.0] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(6)
    shares = [0.0, 0.01, 0.2, 0.333, 0.5, 0.59, 0.6, 0.61, 0.99, 1.0]
    assert np.allclose(mobility.quantiles(df, "x", shares), np.quantile(values, shares), atol=1e-12)
    assert mobility.quantiles(df.filter("false"), "x", [0.5]) == [None]
    for n in (1, 2, 7, 70):
        few, many = [float(k * k) for k in range(n)], [k / 20 for k in range(21)]
        assert np.allclose(mobility.quantiles(spark.createDataFrame([(v,) for v in few], "x double"), "x", many), np.quantile(few, many), atol=1e-9)


def test_coverage_of_holes_and_islands(spark):
    p = lambda *v: [{"lon": float(x), "lat": float(y)} for x, y in v]
    square = lambda w, s, e, n: p((w, s), (e, s), (e, n), (w, n))
    shapes = [("hole", [square(0, 0, 4, 4), square(1, 1, 3, 3)[::-1]]), ("parts", [square(0, 0, 1, 1), square(2.5, 2.5, 3.5, 3.5)]), ("slant", [p((0, 0), (4, 1), (4, 3), (0, 4))]), ("back", [p((0.5, 0.5), (0.5, 3.5), (3.5, 0.5))])]
    regions = spark.createDataFrame(shapes, "geo string, geometry array<array<struct<lon: double, lat: double>>>")
    cells = spark.createDataFrame([(r, c, c + 0.5, r + 0.5) for r in range(4) for c in range(4)], "cell_row int, cell_col int, lon double, lat double")
    df = grid.cell_region_coverage(cells, regions, 1.0)
    got = {(r.geo, r.cell_row, r.cell_col): r.frac for r in df.collect()}
    assert "Python" not in df._jdf.queryExecution().toString()

    def inside(rings, x, y):
        return sum((a["lat"] > y) != (b["lat"] > y) and x < a["lon"] + (y - a["lat"]) / (b["lat"] - a["lat"]) * (b["lon"] - a["lon"]) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)) % 2 == 1

    for name, rings in shapes:
        for r in range(4):
            for c in range(4):
                near = sum(inside(rings, c + (i + 0.5) / 40, r + (j + 0.49) / 40) for i in range(40) for j in range(40)) / 1600
                assert abs(got.get((name, r, c), 0.0) - near) < 0.02, (name, r, c)
    assert got["hole", 0, 0] == 1.0 and ("hole", 1, 1) not in got and got["parts", 2, 2] == 0.25


def test_courses_of_scenarios_run_together(spark):
    nodes, edges = lattice(spark, 3)
    q = graph.laplacian_edges(nodes, edges, 0.9)
    names = [r.geo for r in nodes.collect()]
    rng = random.Random(8)
    rows = [(s, g, y, rng.gauss(0, 2)) for s in ("a", "b", "c", "d") for g in names for y in (1, 2, 3)]
    panel = spark.createDataFrame(rows, "scenario string, geo string, year_idx int, t double")
    start = nodes.withColumn("y_proximity_exp100", F.lit(0.25))
    draws = spark.createDataFrame([(t, d, c + d / 10) for d in (1, 2) for t, c in (("intercept", -0.5), ("t", 1.0), ("y_proximity_exp100", 2.0))], "term string, draw int, coefficient double")
    together = model.recurrent_prediction(panel, q, start, draws, ["t"], [1, 2, 3], by=["scenario"])
    got = {(r.scenario, r.geo, r.year_idx, r.draw): r.p for r in together.collect()}
    assert len(got) == 4 * 9 * 3 * 2
    for s in ("a", "d"):
        alone = model.recurrent_prediction(panel.filter(F.col("scenario") == s).drop("scenario"), q, start, draws, ["t"], [1, 2, 3]).collect()
        assert all(abs(got[s, r.geo, r.year_idx, r.draw] - r.p) < 1e-9 for r in alone)


def test_prune_keeps_protected(spark):
    rows = [(float(i), float(i), float(i * 7 % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert panel.prune_correlated(panel.correlation_matrix(df, ["a", "b", "c"]), 0.9, ["b"]) == ["b", "c"]
    assert panel.prune_correlated(panel.correlation_matrix(df, ["a", "b"]), 0.9, ["a", "b"]) == ["a", "b"]


def test_missing_training_column_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="missing columns: b"):
        panel.align_to_training_schema(df, spark.createDataFrame([(1, 2)], "a int, b int").schema)


def test_triangle_coverage_and_point(spark):
    p = lambda x, y: {"lon": x, "lat": y}
    regions = spark.createDataFrame([("t", [[p(0.0, 0.0), p(2.0, 0.0), p(0.0, 2.0)]])], "geo string, geometry array<array<struct<lon: double, lat: double>>>")
    cells = spark.createDataFrame([(0, 0, 0.5, 0.5), (1, 0, 0.5, 1.5), (1, 1, 1.5, 1.5)], "cell_row int, cell_col int, lon double, lat double")
    got = {(r.cell_row, r.cell_col): r.frac for r in grid.cell_region_coverage(cells, regions, 1.0).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 0.5}
    pts = spark.createDataFrame([(1, 0.3, 0.3), (2, 1.9, 1.9), (3, -1.0, 0.0)], "point_id int, lon double, lat double")
    assert [r.point_id for r in grid.point_in_region(pts, regions).collect()] == [1]


def test_components_of_a_chain_and_alone(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("alone",)], "geo string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src string, dst string")
    got = {r.geo: (r.component, r.size) for r in graph.connected_components(nodes, edges).collect()}
    assert got["alone"] == (2, 1) and {got[f"n{i}"] for i in range(9)} == {(1, 9)}


def test_contiguous_folds_cover_all_regions_once(spark):
    nodes, edges = lattice(spark, 6)
    regions = nodes.select("geo", F.substring("geo", 2, 1).cast("double").alias("longitude"), F.substring("geo", 3, 1).cast("double").alias("latitude"))
    seeds = spark.createDataFrame([(1, "n00"), (2, "n55"), (3, "n05")], "seed int, geo string")
    got = validation.contiguous_folds(regions, edges, seeds).collect()
    assert sorted(r.geo for r in got) == sorted(r.geo for r in nodes.collect())
    assert {r.fold for r in got} == {1, 2, 3}


def test_presence_model_learns_a_sign(spark):
    rows = [("g", k, float(k % 10), 1 if k % 10 > 4 else 0, k % 3) for k in range(200)]
    df = spark.createDataFrame(rows, "geo string, year int, x double, presence int, b int")
    got = {r.term: r.coefficient for r in model.fit_presence_model(df, ["x"], ["b"]).collect()}
    assert got["x"] > 0.3 and "b=2" in got


def test_buffer_measures_to_edges(spark):
    """A long edge whose vertices are far away is still near."""
    box = lambda a, b, c, d: [[(a, b), (c, b), (c, d), (a, d)]]
    shapes = [("long", box(8.0, 50.0, 12.0, 50.2)), ("near", box(10.0, 50.4, 10.1, 50.5)), ("far", box(10.0, 51.0, 10.1, 51.1)), ("inside", box(9.9, 50.05, 10.0, 50.1))]
    regions = spark.createDataFrame(shapes, "geo string, geometry array<array<struct<lon: double, lat: double>>>")
    folds = spark.createDataFrame([("long", 1)], "geo string, fold int")
    assert {r.geo for r in validation.buffer_regions(regions, folds, 35.0).collect()} == {"near", "inside"}


def test_geodesic_distances(spark):
    """Known geodesics on WGS84."""
    rows = [(0.0, 0.0, 1.0, 0.0, 111.3195), (0.0, 0.0, 0.0, 1.0, 110.5744), (10.0, 52.0, 10.0, 52.0, 0.0), (2.3522, 48.8566, 13.405, 52.52, 879.70)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, km double")
    for r in df.select("km", mobility.geodesic_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("d")).collect():
        assert abs(r.d - r.km) < 0.1


def test_exact_quantiles(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.random(), 0.5, float(rng.randrange(5))]) for _ in range(3000)]
    got = mobility.quantiles(spark.createDataFrame([(x,) for x in values], "w double").repartition(5), "w", [0.0, 0.2, 0.5, 0.99, 1.0])
    assert np.allclose(got, np.quantile(values, [0.0, 0.2, 0.5, 0.99, 1.0]))
    assert mobility.quantiles(spark.createDataFrame([], "w double"), "w", [0.5]) == [None]
