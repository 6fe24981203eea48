"""Queries of land use and population."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import landpop as o
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query

LAND = ("primary_forested_area", "pasture_land", "urban_land")
_SH = "lg AS (" + " UNION ALL ".join(f"SELECT geo, CASE WHEN scenario = 'historical' THEN 0e0 ELSE 1e0 END AS s, CAST(year AS DOUBLE) AS t, '{c}' AS col, {c} AS v FROM fx_panel_year" for c in LAND) + "), sm AS (SELECT geo, col, regr_sxx(v, s) AS ss, regr_sxx(v, t) AS tt, regr_sxy(s, t) AS st, regr_sxy(v, s) AS sy, regr_sxy(v, t) AS ty FROM lg GROUP BY 1, 2), sh AS (SELECT geo, col, (sy * tt - ty * st) / (ss * tt - st * st) AS shift FROM sm)"
_SC = _SH + ", sc AS (SELECT y.*, " + ", ".join(f"{c} - CASE WHEN scenario = 'historical' THEN 0e0 ELSE (SELECT shift FROM sh WHERE sh.geo = y.geo AND sh.col = '{c}') END AS scaled_{c}" for c in LAND) + " FROM fx_panel_year y)"
_AW = lambda cols, pre, label: "SELECT year, " + ", ".join(f"sum({pre}{c} * area_m2) / sum(area_m2) AS {c}" for c in cols) + f", '{label}' AS series FROM sc JOIN fx_region r ON sc.geo = r.geo GROUP BY 1"
_CAP = "la AS (SELECT geo, CAST(arg_max(population, year) AS DOUBLE) AS last FROM fx_panel_year WHERE year <= 2000 GROUP BY 1), pr AS (SELECT geo, CAST(population AS DOUBLE) AS p FROM fx_panel_year WHERE year = 2001 AND population % 5 <> 0), cp AS (SELECT la.geo, least(greatest(coalesce(p, last), last * 0.85e0), last * 1.15e0) AS population FROM la LEFT JOIN pr ON la.geo = pr.geo)"


def scaled(v: Views):
    return o.remove_level_shift(v.panel_year, o.regional_level_shift(v.panel_year, LAND), LAND)


def _capped(v: Views):
    pred = v.panel_year.filter("year = 2001 and population % 5 <> 0")
    return o.cap_growth(pred, v.panel_year.filter("year <= 2000"))


query("land_use_classes", "SELECT geo, year, (primary_forested_area + CASE WHEN population % 4 = 0 THEN NULL ELSE pasture_land END) / 2 AS croplands, urban_land FROM fx_panel_year", "croplands urban_land")(lambda v: o.land_use_classes(v.panel_year.withColumn("pasture_land", F.expr("case when population % 4 = 0 then null else pasture_land end")), ["primary_forested_area", "pasture_land"], ["urban_land"]))
query("tag_scenario_by_year", "SELECT geo, year, CASE WHEN year <= 1997 THEN 'historical' ELSE 'SSP370' END AS scenario FROM fx_panel_year")(lambda v: o.tag_scenario_by_year(v.panel_year.select("geo", "year"), 1997))
query("regional_level_shift", _SH + "---SELECT geo, col AS column, shift FROM sh", "shift")(lambda v: o.regional_level_shift(v.panel_year, LAND))
query("remove_level_shift", _SC + "---SELECT geo, year, scenario, " + ", ".join(f"scaled_{c}" for c in LAND) + " FROM sc", " ".join(f"scaled_{c}" for c in LAND))(lambda v: scaled(v).select("geo", "year", "scenario", *(f"scaled_{c}" for c in LAND)))
query("keep_scaled_columns", _SC + "---SELECT geo, year, CAST(year - 1996 AS INT) AS year_idx, " + ", ".join(f"scaled_{c} AS {c}" for c in LAND) + " FROM sc WHERE year >= 1997", " ".join(LAND))(lambda v: o.keep_scaled_columns(scaled(v), 1997))
query("area_weighted_year_mean", _SC + "---" + _AW(LAND, "", "raw") + " UNION ALL " + _AW(LAND, "scaled_", "scaled"), " ".join(LAND))(lambda v: o.area_weighted_year_mean(v.panel_year, v.region, LAND, "raw").unionByName(o.area_weighted_year_mean(o.keep_scaled_columns(scaled(v), 1995), v.region, LAND, "scaled")))
#: The least-squares slope as the root of the profile's derivative, by halving an interval: another way than the operator's.
_TREND = """/*recursive*/
ps AS (SELECT geo, year, CAST(population AS DOUBLE) AS y FROM fx_panel_year WHERE population > 0),
md AS (SELECT geo, avg(year) AS mean_year, count(*) AS n FROM ps GROUP BY geo HAVING count(*) >= 3),
da AS (SELECT ps.geo, list(year - mean_year ORDER BY year) AS xs, list(y / 1e6 ORDER BY year) AS ys FROM ps JOIN md ON ps.geo = md.geo GROUP BY ps.geo),
bs(geo, xs, ys, lo, hi, k) AS (SELECT geo, xs, ys, -1e0, 1e0, 0 FROM da UNION ALL
  SELECT geo, xs, ys, CASE WHEN h > 0 THEN mid ELSE lo END, CASE WHEN h > 0 THEN hi ELSE mid END, k + 1 FROM (
    SELECT *, list_sum([xs[i] * ys[i] * exp(mid * xs[i]) FOR i IN range(1, len(xs) + 1)]) * list_sum([exp(2 * mid * x) FOR x IN xs])
              - list_sum([ys[i] * exp(mid * xs[i]) FOR i IN range(1, len(xs) + 1)]) * list_sum([x * exp(2 * mid * x) FOR x IN xs]) AS h
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM bs WHERE k < 70) q) r),
fb AS (SELECT geo, xs, ys, (lo + hi) / 2 AS b FROM bs WHERE k = 70),
fa AS (SELECT geo, xs, ys, b, ln(list_sum([ys[i] * exp(b * xs[i]) FOR i IN range(1, len(xs) + 1)]) / list_sum([exp(2 * b * x) FOR x IN xs])) + ln(1e6) AS a FROM fb),
r8 AS (SELECT geo, a, b, len(xs) AS n, list_sum([exp(2 * (a + b * x)) FOR x IN xs]) AS w0, list_sum([x * exp(2 * (a + b * x)) FOR x IN xs]) AS w1, list_sum([x * x * exp(2 * (a + b * x)) FOR x IN xs]) AS w2,
       list_sum([pow(1e6 * ys[i] - exp(a + b * xs[i]), 2) FOR i IN range(1, len(xs) + 1)]) / greatest(len(xs) - 2, 1) AS s2 FROM fa)"""
_NEXT = """, ft AS (SELECT r8.*, mean_year, 2002 - mean_year AS x FROM r8 JOIN md ON r8.geo = md.geo),
ex AS (SELECT geo, exp(a + b * x) AS population, 1.96e0 * sqrt(s2 * (w2 - 2 * x * w1 + x * x * w0) / (w0 * w2 - w1 * w1)) AS se, a + b * x AS eta FROM ft)---
SELECT geo, CAST(2002 AS INT) AS year, population, exp(eta - se) AS lwr, exp(eta + se) AS upr, true AS is_extrapolated FROM ex"""
query("fit_population_trend", _TREND + "---SELECT r8.geo, r8.a, r8.b, mean_year, r8.n FROM r8 JOIN md ON r8.geo = md.geo", "a b mean_year")(lambda v: o.fit_population_trend(v.panel_year).select("geo", "a", "b", "mean_year", "n"))
query("extrapolate_next_year", _TREND + _NEXT, "population lwr upr", digits=2)(lambda v: o.extrapolate_next_year(o.fit_population_trend(v.panel_year), 2002))
query("cap_growth", _CAP + "---SELECT * FROM cp", "population")(_capped)
query("append_extrapolated", _CAP + "---SELECT geo, year, CAST(population AS DOUBLE) AS population, false AS is_extrapolated FROM fx_panel_year WHERE year <= 2000 UNION ALL SELECT geo, 2001, population, true FROM cp", "population")(lambda v: o.append_extrapolated(v.panel_year.filter("year <= 2000"), _capped(v), 2001))
query("population_density", "SELECT y.geo, year, population, area_m2 / 1e6 AS area, population / (area_m2 / 1e6) AS population_density FROM fx_panel_year y LEFT JOIN fx_region r ON y.geo = r.geo", "area population_density")(lambda v: o.population_density(v.panel_year.select("geo", "year", "population"), v.region))
query("population_map_table", "d AS (SELECT y.geo, avg(population / (area_m2 / 1e6)) AS density FROM fx_panel_year y JOIN fx_region r ON y.geo = r.geo GROUP BY 1)---SELECT geo, density, CASE WHEN density > 0 THEN ln(density) END AS log_density FROM d", "density log_density")(lambda v: o.population_map_table(o.population_density(v.panel_year, v.region)))
query("land_use_map_table", "SELECT geo, " + ", ".join(f"avg({c}) AS {c}" for c in LAND) + " FROM fx_panel_year GROUP BY 1", " ".join(LAND))(lambda v: o.land_use_map_table(v.panel_year, LAND))
