"""Queries of climate covariates and their alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import climate as c
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query

VARS = ("temperature", "precipitation", "relative_humidity")
RULES = {"temperature": "additive", "precipitation": "ratio", "relative_humidity": "logit"}
_MEANS = ", ".join(f"avg({v}) AS {v}" for v in VARS)
_ENS = f"en AS (SELECT geo, year, {_MEANS}, count(DISTINCT model) AS n_models FROM fx_model_year GROUP BY 1, 2)"
_BASE = "ob AS (SELECT geo, " + ", ".join(f"avg({v}) AS {v}_obs" for v in VARS) + " FROM fx_climate_year WHERE year BETWEEN 1996 AND 1998 GROUP BY 1), rf AS (SELECT geo, " + ", ".join(f"avg({v}) AS {v}_ref" for v in VARS) + " FROM en WHERE year BETWEEN 1996 AND 1998 GROUP BY 1), bl AS (SELECT ob.*, " + ", ".join(f"{v}_ref" for v in VARS) + " FROM ob LEFT JOIN rf ON ob.geo = rf.geo)"
_LG = lambda x: f"ln(least(greatest({x} / 1e2, 1e-4), 1 - 1e-4) / (1 - least(greatest({x} / 1e2, 1e-4), 1 - 1e-4)))"
_LOGIT = f"1e2 / (1 + exp(-({_LG('relative_humidity_obs')} + {_LG('relative_humidity')} - {_LG('relative_humidity_ref')})))"
_JOINED = "jn AS (SELECT en.*, " + ", ".join(f"{v}_obs, {v}_ref" for v in VARS) + " FROM en LEFT JOIN bl ON en.geo = bl.geo WHERE en.year >= 1999)"


def ensemble(v: Views):
    return c.ensemble_mean(v.model_year, VARS)


def _joined(v: Views):
    base = c.overlap_baseline(v.climate_year, ensemble(v), VARS, 1996, 1998)
    return ensemble(v).filter("year >= 1999").join(base, "geo", "left")


_BAD = "CASE WHEN region_id % 9 = 0 THEN 'Cote-d?Or' WHEN region_id % 9 = 1 THEN 'Cotes-d?Armor' ELSE location_na END"
query("fix_location_names", f"SELECT geo, replace(replace({_BAD}, 'Cote-d?Or', 'Cote-d’Or'), 'Cotes-d?Armor', 'Cotes-d’Armor') AS location_na FROM fx_region")(lambda v: c.fix_location_names(v.region.select("geo", F.expr(_BAD).alias("location_na")), "location_na"))
query("location_mismatch_report", f"a AS (SELECT DISTINCT {_BAD} AS location_na FROM fx_region), b AS (SELECT DISTINCT location_na FROM fx_region)---SELECT coalesce(a.location_na, b.location_na) AS location_na, a.location_na IS NOT NULL AS in_data, b.location_na IS NOT NULL AS in_map FROM a FULL JOIN b ON a.location_na = b.location_na WHERE a.location_na IS NULL OR b.location_na IS NULL")(lambda v: c.location_mismatch_report(v.region.select(F.expr(_BAD).alias("location_na")), v.region))
query("annual_mean", "SELECT geo, year, " + ", ".join(f"avg({x}) AS {x}_mean" for x in VARS) + " FROM fx_daily GROUP BY 1, 2", " ".join(f"{x}_mean" for x in VARS))(lambda v: c.annual_mean(v.daily, VARS))
_SEASON = [(s, x, f"avg(CASE WHEN month IN ({', '.join(map(str, m))}) THEN {x} END) AS {x}_{s}_mean") for s, m in c.SEASONS.items() for x in VARS]
query("season_means", "SELECT geo, year, " + ", ".join([f"avg({x}) AS {x}_mean" for x in VARS] + [e for _, _, e in _SEASON]) + " FROM fx_daily GROUP BY 1, 2", " ".join([f"{x}_mean" for x in VARS] + [f"{x}_{s}_mean" for s, x, _ in _SEASON]))(lambda v: c.season_means(v.daily, VARS))
query("moving_average_mean", "m AS (SELECT geo, year, count(temperature) OVER w AS n, avg(temperature) OVER w AS m FROM fx_daily WINDOW w AS (PARTITION BY geo, year ORDER BY date ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING))---SELECT geo, year, avg(CASE WHEN n = 30 THEN m END) AS temperature_ma_mean FROM m GROUP BY 1, 2", "temperature_ma_mean")(lambda v: c.moving_average_mean(v.daily, "temperature"))
query("combine_climate_variables", "SELECT p.geo, p.year, precipitation, temperature, relative_humidity FROM fx_climate_year p LEFT JOIN (SELECT geo, year, temperature FROM fx_climate_year WHERE year > 1995) t ON p.geo = t.geo AND p.year = t.year LEFT JOIN (SELECT geo, year, relative_humidity FROM fx_climate_year WHERE year < 2000) h ON p.geo = h.geo AND p.year = h.year".replace("relative_humidity FROM fx_climate_year p", "h.relative_humidity FROM fx_climate_year p").replace("temperature, h.", "t.temperature, h.").replace("precipitation, t.", "p.precipitation, t."), "precipitation temperature relative_humidity")(lambda v: c.combine_climate_variables(v.climate_year.select("geo", "year", "precipitation"), v.climate_year.filter("year > 1995").select("geo", "year", "temperature"), v.climate_year.filter("year < 2000").select("geo", "year", "relative_humidity")))
query("stack_years", "SELECT geo, year, temperature, CAST(year - 1994 + 0 AS INT) AS year_idx FROM fx_climate_year WHERE year IN (1995, 1997, 2000)", "temperature")(lambda v: c.stack_years([v.climate_year.filter(F.col("year") == y).select("geo", "year", "temperature") for y in (1995, 1997, 2000)], 1995))
query("missing_column_report", "SELECT 'presence' AS column, count(*) AS n_missing FROM fx_panel WHERE presence IS NULL")(lambda v: c.missing_column_report(v.panel))
query("window_years_reindex", "SELECT geo, year, temperature, CAST(year - 1995 AS INT) AS year_idx FROM fx_climate_year WHERE year BETWEEN 1996 AND 1999", "temperature")(lambda v: c.window_years_reindex(v.climate_year.select("geo", "year", "temperature"), 1996, 1999))
query("scenario_difference", "a AS (SELECT geo, avg(temperature) AS temperature FROM fx_climate_year GROUP BY 1), b AS (SELECT geo, avg(temperature) AS pi FROM fx_model_year GROUP BY 1)---SELECT a.geo, temperature, pi AS temperature__pi, temperature - pi AS temperature__diff FROM a JOIN b ON a.geo = b.geo", "temperature temperature__pi temperature__diff")(lambda v: c.scenario_difference(v.climate_year, v.model_year, "temp"))
query("ensemble_mean", _ENS + "---SELECT * FROM en", " ".join(VARS))(ensemble)
query("overlap_baseline", _ENS + ", " + _BASE + "---SELECT * FROM bl", " ".join(f"{x}_obs {x}_ref" for x in VARS))(lambda v: c.overlap_baseline(v.climate_year, ensemble(v), VARS, 1996, 1998))
for _n, _x, _e, _f in (
    ("delta_additive", "temperature", "temperature_obs + (temperature - temperature_ref)", c.delta_additive),
    ("delta_ratio", "precipitation", "precipitation_obs * precipitation / greatest(precipitation_ref, 1e-6)", c.delta_ratio),
    ("delta_logit", "relative_humidity", _LOGIT, lambda o, m, r: c.delta_logit(o, m, r, F.lit(100.0))),
):
    query(_n, _ENS + ", " + _BASE + ", " + _JOINED + f"---SELECT geo, year, {_e} AS aligned FROM jn", "aligned")(lambda v, x=_x, f=_f: _joined(v).select("geo", "year", f(F.col(f"{x}_obs"), F.col(x), F.col(f"{x}_ref")).alias("aligned")))
query("stitch_future", _ENS + ", " + _BASE + ", " + _JOINED + f"---SELECT geo, year, CAST(year - 1998 AS INT) AS year_idx, temperature_obs + (temperature - temperature_ref) AS temperature, precipitation_obs * precipitation / greatest(precipitation_ref, 1e-6) AS precipitation, {_LOGIT} AS relative_humidity FROM jn", " ".join(VARS))(lambda v: c.stitch_future(v.climate_year, ensemble(v), 1996, 1998, 1999, RULES))
query("scenario_year_series", f"SELECT year, {_MEANS}, 'observed' AS scenario FROM fx_climate_year GROUP BY 1 UNION ALL SELECT year, {_MEANS}, 'models' FROM fx_model_year GROUP BY 1", " ".join(VARS))(lambda v: c.scenario_year_series({"observed": v.climate_year, "models": v.model_year}, VARS))
