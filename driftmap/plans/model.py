"""Queries of the presence model, and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftmap.operators import binning, graph, region_effect
from driftmap.operators import model as m
from driftmap.operators.lineage import cut, drop, shared_folder
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query
from driftmap.sources import tables as s

FIXED = ("temperature", "precipitation")
_COEF = {"intercept": -1.5, "temperature": 0.05, "precipitation": 0.2}
_LIN = "-1.5e0 + 5e-2 * temperature + 2e-1 * precipitation"


def _panel(v: Views):
    return v.panel.withColumn("land", F.when(F.col("urban_land") > 0.5, 2).otherwise(1))


def _coefficients(v: Views):
    return v.spark.createDataFrame(list(_COEF.items()), "term string, coefficient double")


def _draws(v: Views, n: int = 8):
    return _coefficients(v).crossJoin(v.spark.range(1, n + 1).select(F.col("id").cast("int").alias("draw"))).withColumn("coefficient", F.col("coefficient") * (1 + F.col("draw") * 0.01))


def _years(v: Views):
    return sorted(r.year_idx for r in v.panel.select("year_idx").distinct().collect())


def _scenario_panel(v: Views):
    """The panel under two scenarios, one of them two degrees warmer."""
    return v.panel.select("*", F.explode(F.array(F.lit("SSP126"), F.lit("SSP370"))).alias("scenario")).withColumn("temperature", F.col("temperature") + F.when(F.col("scenario") == "SSP370", 2.0).otherwise(0.0))


def _effects(v: Views):
    return m.fixed_effect_contribution(m.model_design(v.panel, FIXED, ()), _coefficients(v))


def _bins(v: Views):
    return v.panel.withColumn("temperature_bin", (F.col("population") % 5 + 1).cast("int"))


def _bin_effects(v: Views):
    return v.sql("SELECT CAST(id AS INT) AS bin, id * 1.1e-1 AS mean, id * 1.1e-1 - 5e-2 AS lwr, id * 1.1e-1 + 5e-2 AS upr FROM range(1, 5)")


def _folder(v: Views) -> str:
    return f"{shared_folder(v.spark)}/driftmap-io/{uuid.uuid4().hex}"


query("model_design", "SELECT geo, year, 'intercept' AS term, 1e0 AS value FROM fx_panel UNION ALL SELECT geo, year, 'temperature', temperature FROM fx_panel UNION ALL SELECT geo, year, 'precipitation', precipitation FROM fx_panel UNION ALL SELECT geo, year, 'land=' || CASE WHEN urban_land > 5e-1 THEN 2 ELSE 1 END, 1e0 FROM fx_panel", "value")(lambda v: m.model_design(_panel(v), FIXED, ("land",)))
query("fit_presence_model")(lambda v: m.fit_presence_model(_panel(v), FIXED, ("land",)))
query("fit_region_effect")(lambda v: region_effect.fit_region_effect(_panel(v), graph.laplacian_edges(v.region, v.edges, 0.9), FIXED, ("land",))[1])
query("fixed_effect_contribution", "SELECT geo, year, 'intercept' AS term, 1e0 AS value, -1.5e0 AS coefficient, -1.5e0 AS effect FROM fx_panel UNION ALL SELECT geo, year, 'temperature', temperature, 5e-2, 5e-2 * temperature FROM fx_panel UNION ALL SELECT geo, year, 'precipitation', precipitation, 2e-1, 2e-1 * precipitation FROM fx_panel", "value coefficient effect")(_effects)
query("random_effect_lookup", "SELECT geo, year, CAST(population % 5 + 1 AS INT) AS temperature_bin, CASE WHEN population % 5 < 4 THEN (population % 5 + 1) * 1.1e-1 END AS temperature_effect_mean, CASE WHEN population % 5 < 4 THEN (population % 5 + 1) * 1.1e-1 - 5e-2 END AS temperature_effect_lwr, CASE WHEN population % 5 < 4 THEN (population % 5 + 1) * 1.1e-1 + 5e-2 END AS temperature_effect_upr FROM (SELECT geo, year, CAST(population AS BIGINT) AS population FROM fx_panel) q", "temperature_effect_mean temperature_effect_lwr temperature_effect_upr")(lambda v: m.random_effect_lookup(_bins(v).select("geo", "year", "temperature_bin"), _bin_effects(v), "temperature"))
query("spatial_effect_join", "SELECT p.geo, p.year, population, s.precipitation AS spatial FROM fx_panel p LEFT JOIN (SELECT * FROM fx_climate_year WHERE year < 2000) s ON p.geo = s.geo AND p.year = s.year", "population spatial")(lambda v: m.spatial_effect_join(v.panel.select("geo", "year", "population"), v.climate_year.filter("year < 2000").select("geo", "year", F.col("precipitation").alias("spatial"))))
query("effect_map_table", "SELECT r.geo, CASE WHEN w.geo IS NULL AND NOT coalesce(p.b IN (2, 3), false) THEN p.temperature END AS effect FROM fx_region r LEFT JOIN (SELECT geo, temperature, CAST(population AS BIGINT) % 5 + 1 AS b FROM fx_panel WHERE year = 1998) p ON r.geo = p.geo LEFT JOIN (SELECT geo FROM fx_presence WHERE year = 1997 AND presence = 1) w ON r.geo = w.geo", "effect")(lambda v: m.effect_map_table(_bins(v).select("geo", "year", F.col("temperature_bin").alias("bin"), F.col("temperature").alias("effect")), v.region, v.presence, 1998, (2, 3)))
query("sum_effects_to_probability", f"SELECT geo, year, {_LIN} AS log_odds, 1 / (1 + exp(-({_LIN}))) AS p FROM fx_panel", "log_odds p")(lambda v: m.sum_effects_to_probability(_effects(v)))
query("logit", "SELECT geo, year, draw, ln(p_fact / (1 - p_fact)) AS x FROM fx_draws WHERE p_fact > 1e-3 AND p_fact < 9.99e-1", "x")(lambda v: v.draws.filter("p_fact > 1e-3 and p_fact < 9.99e-1").select("geo", "year", "draw", m.logit(F.col("p_fact")).alias("x")))
query("inverse_logit", "SELECT geo, year, 1 / (1 + exp(-temperature / 10)) AS p FROM fx_panel", "p")(lambda v: v.panel.select("geo", "year", m.inverse_logit(F.col("temperature") / 10).alias("p")))
query("fitted_table", f"SELECT geo, year, presence, CASE WHEN year <= 1999 THEN {_LIN} END AS log_odds, CASE WHEN year <= 1999 THEN 1 / (1 + exp(-({_LIN}))) END AS p FROM fx_panel", "log_odds p")(lambda v: m.fitted_table(v.panel.select("geo", "year", "presence"), m.sum_effects_to_probability(_effects(v).filter("year <= 1999"))))
query("draws_to_long", " UNION ALL ".join(f"SELECT geo, year_idx, CAST({k} AS INT) AS draw, 1 / (1 + exp(-(temperature / 10 + {k} * 1e-2))) AS p FROM fx_panel" for k in (1, 2, 12)), "p")(lambda v: m.draws_to_long(v.panel.select("geo", "year_idx", *((F.col("temperature") / 10 + k * 0.01).alias(f"draw_{k}") for k in (1, 2, 12))), ["geo", "year_idx"]))
query("score_draws", f"SELECT geo, year, CAST(range AS INT) AS draw, 1 / (1 + exp(-({_LIN}) * (1 + range * 1e-2))) AS p FROM fx_panel CROSS JOIN range(1, 9)", "p")(lambda v: m.score_draws(m.model_design(v.panel, FIXED, ()), _draws(v)))
query("recurrent_prediction")(lambda v: m.recurrent_prediction(_scenario_panel(v), graph.laplacian_edges(v.region, v.edges, 0.9), v.region.select("geo", (F.col("region_id") % 10 / 10).alias("y_proximity_exp100")), _draws(v, 3).unionByName(v.spark.createDataFrame([("y_proximity_exp100", d, 2.0) for d in (1, 2, 3)], "term string, draw int, coefficient double").select("term", "coefficient", "draw")), FIXED, _years(v), by=["scenario"]))
_KEYS = "ky AS (SELECT CAST(CAST(population AS BIGINT) % 5 + 1 AS INT) AS bin, avg(temperature) AS bin_mean FROM fx_panel GROUP BY 1)"
query("posterior_effect_curve", _KEYS + "---SELECT 'temperature' AS \"column\", CAST(range AS INT) AS bin, bin_mean, range * 1.1e-1 AS mean, range * 1.1e-1 - 5e-2 AS lwr, range * 1.1e-1 + 5e-2 AS upr FROM range(1, 5) LEFT JOIN ky ON bin = range", "bin_mean mean lwr upr")(lambda v: m.posterior_effect_curve(_bin_effects(v).withColumn("column", F.lit("temperature")), binning.bin_keys(_bins(v), "temperature").select(F.lit("temperature").alias("column"), "bin", "bin_mean")))
query("fixed_effect_table", "SELECT 'Total Flux In' AS label, avg(temperature) AS mean, min(temperature) AS lwr, max(temperature) AS upr FROM fx_panel", "mean lwr upr")(lambda v: m.fixed_effect_table(v.panel.agg(F.avg("temperature").alias("mean"), F.min("temperature").alias("lwr"), F.max("temperature").alias("upr")).withColumn("term", F.explode(F.array(F.lit("intercept"), F.lit("total_flux_in"))))))
query("stdev_of_effect", "SELECT stddev_samp(temperature) AS stdev FROM fx_panel", "stdev")(lambda v: m.stdev_of_effect(v.panel.withColumnRenamed("temperature", "effect")))


def _years_of_days(daily):
    """Each year with its days, as text."""
    return [(r.year, r.d) for r in daily.groupBy("year").agg(F.sort_array(F.collect_set(F.col("date").cast("string"))).alias("d")).orderBy("year").collect()]


def _wide(daily, year: int, days: list[str]):
    return daily.filter(F.col("year") == year).groupBy("geo").pivot("date", days).agg(F.first("temperature")).withColumnRenamed("geo", "Location")


def _by_year(v: Views, one):
    """The union of what one gives for each year: its wide table of all days, the days, and a file of that year."""
    out, daily = None, cut(v.daily)  # every year reads it
    for year, days in _years_of_days(daily):
        found = one(_wide(daily, year, days), days, f"{_folder(v)}/tas_mean_{year}.csv")
        out = found if out is None else out.unionByName(found)
    return out


_LONG = """
ge AS (SELECT DISTINCT geo, year FROM fx_daily), dd AS (SELECT DISTINCT year, date FROM fx_daily),
lo AS (SELECT ge.geo AS location, dd.date, d.temperature AS value FROM ge JOIN dd ON ge.year = dd.year LEFT JOIN fx_daily d ON d.geo = ge.geo AND d.date = dd.date)---
SELECT * FROM lo"""


def _read_csv(v: Views):
    """A wide file for each year, every other one with its days in falling order, in one read."""
    folder, daily = _folder(v), cut(v.daily)
    for year, days in _years_of_days(daily):
        s.write_csv(_wide(daily, year, days[::-1] if year % 2 else days), f"{folder}/tas_mean_{year}.csv")
    drop(daily)
    return s.read_daily_csv(v.spark, f"{folder}/tas_mean_*.csv").select("location", "date", "value")


def _headerless(v: Views):
    def one(wide, days, path):
        s.write_csv(wide, path)
        return s.wide_to_long_daily(s.read_daily_csv_headerless(v.spark, path, ["Location", *days]), days)

    return _by_year(v, one)


def _annual(v: Views):
    out = None
    for year in [r.year for r in v.panel_year.select("year").distinct().orderBy("year").collect()]:
        path = f"{_folder(v)}/population_{year}.csv"
        s.write_csv(v.panel_year.filter(F.col("year") == year).select(F.col("geo").alias("Location"), F.col("population").alias("total population")), path)
        one = s.read_annual_csv(v.spark, path, {"Location": "geo", "total population": "population"}).select("geo", "year", "population")
        out = one if out is None else out.unionByName(one)
    return out


def _scenarios(v: Views, only=None):
    path = _folder(v)
    s.write_panel(v.model_year.withColumn("scenario", F.concat(F.lit("S"), (F.col("year") % 2).cast("string"))), path)
    return s.read_scenario_models(v.spark, path, only).select("geo", "year", F.col("model").cast("int").alias("model"), F.col("scenario").cast("string").alias("scenario"), "temperature")


def _rounded(v: Views):
    path = _folder(v)
    s.write_rounded(v.panel.select("geo", "year", "urban_land"), path, 2)
    return v.spark.read.csv(path, header=True).select("geo", F.col("year").cast("int").alias("year"), F.col("urban_land").cast("double").alias("urban_land"))


def _read_panel(v: Views):
    path = _folder(v)
    v.panel.write.parquet(path)
    return s.read_panel(v.spark, path)


_FILES = "SELECT concat('model', CAST(model AS STRING)) AS folder, concat('tas_', CASE WHEN year % 3 = 0 THEN 'ssp370_' ELSE 'hist_' END, CAST(year AS STRING), '.nc') AS path FROM fx_model_year"
query("read_daily_csv", _LONG, "value")(_read_csv)
query("wide_to_long_daily", _LONG, "value")(lambda v: _by_year(v, lambda wide, days, path: s.wide_to_long_daily(wide, days)))
query("read_daily_csv_headerless", _LONG, "value")(_headerless)
query("read_annual_csv", "SELECT geo, year, CAST(population AS DOUBLE) AS population FROM fx_panel_year", "population")(_annual)
query("read_panel", "SELECT * FROM fx_panel", "temperature precipitation relative_humidity population primary_forested_area pasture_land urban_land")(_read_panel)
query("find_input_by_pattern", _FILES.replace("STRING", "VARCHAR").join(("fl AS (", ")")) + "---SELECT folder, path, CAST(CASE WHEN regexp_matches(path, 'ssp370') THEN 0 ELSE 1 END AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN regexp_matches(path, 'ssp370') THEN 0 ELSE 1 END, path) AS n FROM (SELECT DISTINCT * FROM fl) x) q WHERE n = 1")(lambda v: s.find_input_by_pattern(v.sql(_FILES).distinct(), ["ssp370", "hist"]))
query("read_scenario_models", "SELECT geo, year, model, 'S1' AS scenario, temperature FROM fx_model_year WHERE year % 2 = 1", "temperature")(lambda v: _scenarios(v, ["S1"]))
query("write_panel", "SELECT geo, year, model, 'S' || (year % 2) AS scenario, temperature FROM fx_model_year", "temperature")(_scenarios)
query("write_csv", "SELECT geo, year, population FROM fx_panel_year")(lambda v: (s.write_csv(v.panel_year.select("geo", "year", "population"), p := _folder(v)), v.spark.read.schema("geo string, year int, population bigint").csv(p, header=True))[1])
query("write_rounded", "SELECT geo, year, round(urban_land + 1.7e-9, 2) AS urban_land FROM fx_panel", "urban_land")(lambda v: _rounded(v))
query("select_prediction_table", "SELECT geo, draw, p_fact AS p FROM fx_draws", "p")(lambda v: {"draws": v.draws.withColumnRenamed("p_fact", "p"), "panel": v.panel, "region": v.region}[s.select_prediction_table({"draws": v.draws.withColumnRenamed("p_fact", "p"), "panel": v.panel, "region": v.region})].select("geo", "draw", "p"))
query("pick_prob_column", "SELECT geo, draw, p_fact AS p FROM fx_draws", "p")(lambda v: s.pick_prob_column(v.draws.select("geo", "draw", F.col("p_fact").alias("prob"))))
query("read_region_map", "SELECT geo, location_na, CASE WHEN country_id < 20 THEN longitude END AS longitude FROM fx_region", "longitude")(lambda v: s.read_region_map(v.region.filter("country_id < 20").select("geo", "location_na", "longitude"), v.region.select("geo", "location_na")))
