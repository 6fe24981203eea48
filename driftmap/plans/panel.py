"""Queries of panel assembly and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import panel as p
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query

COVS = ("temperature", "precipitation", "relative_humidity", "population", "primary_forested_area", "pasture_land", "urban_land")


def _climate(v: Views):
    return v.climate_year.filter("year < 2001").select("geo", "year_idx", "temperature", "precipitation")


def _land(v: Views):
    return v.panel_year.filter("population % 6 <> 0").select("geo", "year_idx", "urban_land")


def _panel(v: Views):
    return p.assemble_panel(v.panel_year.select("geo", "year_idx", "population"), [_climate(v), _land(v)])


def _twice(v: Views):
    return v.panel_year.select("geo", "year_idx", "population").unionByName(v.panel_year.filter("year = 1996").select("geo", "year_idx", (F.col("population") + 5).alias("population")))


_PANEL = "pn AS (SELECT y.geo, y.year_idx, population, temperature, precipitation, l.urban_land FROM fx_panel_year y LEFT JOIN (SELECT * FROM fx_climate_year WHERE year < 2001) c ON y.geo = c.geo AND y.year_idx = c.year_idx LEFT JOIN (SELECT geo, year_idx, urban_land FROM fx_panel_year WHERE population % 6 <> 0) l ON y.geo = l.geo AND y.year_idx = l.year_idx)"
_TW = "tw AS (SELECT geo, year_idx, population FROM fx_panel_year UNION ALL SELECT geo, year_idx, population + 5 FROM fx_panel_year WHERE year = 1996)"

query("coerce_keys", "SELECT CAST(geo AS VARCHAR) AS geo, CAST(year_idx AS INT) AS year_idx FROM fx_panel_year")(lambda v: p.coerce_keys(v.panel_year.select("geo", F.col("year_idx").cast("string").alias("year_idx"))))
query("dedup_keep_first", _TW + "---SELECT geo, year_idx, min(population) AS population FROM tw GROUP BY 1, 2")(lambda v: p.dedup_keep_first(_twice(v), ["population"]))
query("assert_unique_key", _TW + "---SELECT geo, year_idx, count(*) AS n FROM tw GROUP BY 1, 2 HAVING count(*) > 1")(lambda v: p.assert_unique_key(_twice(v)))
query("assemble_panel", _PANEL + "---SELECT * FROM pn", "temperature precipitation urban_land")(_panel)
query("unmatched_counts", "SELECT 'climate' AS \"table\", count(*) AS n_unmatched FROM fx_panel_year WHERE year >= 2001 UNION ALL SELECT 'land', count(*) FROM fx_panel_year WHERE population % 6 = 0")(lambda v: p.unmatched_counts(v.panel_year.select("geo", "year_idx"), {"climate": _climate(v), "land": _land(v)}))
query("same_key_set", "SELECT geo, year_idx, 'left' AS side FROM fx_panel_year WHERE population % 6 = 0 AND year < 2001 UNION ALL SELECT geo, year_idx, 'right' FROM fx_panel_year WHERE population % 6 <> 0 AND year = 2001")(lambda v: p.same_key_set(_climate(v), _land(v)))
query("keep_complete_rows", _PANEL + "---SELECT * FROM pn WHERE temperature IS NOT NULL AND precipitation IS NOT NULL AND urban_land IS NOT NULL", "temperature precipitation urban_land")(lambda v: p.keep_complete_rows(_panel(v), ["temperature", "precipitation", "urban_land"]))
query("semi_join_clean", "SELECT * FROM fx_presence WHERE (geo, year_idx) IN (SELECT (geo, year_idx) FROM fx_panel_year WHERE population % 6 <> 0)")(lambda v: p.semi_join_clean(v.presence, _land(v)).select("geo", "year", "year_idx", "presence"))
query("drop_first_year", "SELECT geo, CAST(year_idx - 1 AS INT) AS year_idx, population FROM fx_panel_year WHERE year_idx > 1")(lambda v: p.drop_first_year(v.panel_year.select("geo", "year_idx", "population")))
query("drop_last_year_per_region", "SELECT geo, year_idx, population FROM fx_panel_year y WHERE year_idx < (SELECT max(year_idx) FROM fx_panel_year z WHERE z.geo = y.geo)")(lambda v: p.drop_last_year_per_region(v.panel_year.select("geo", "year_idx", "population")))
query("trim_to_common_years", "SELECT geo, year_idx, population FROM fx_panel_year WHERE year_idx <= 6")(lambda v: p.trim_to_common_years([v.panel_year.select("geo", "year_idx", "population"), _climate(v)])[0])
query("restrict_to_regions", "SELECT geo, year, year_idx, presence FROM fx_presence WHERE geo IN (SELECT geo FROM fx_region WHERE country_id < 10)")(lambda v: p.restrict_to_regions(v.presence, v.region.filter("country_id < 10"))[0].select("geo", "year", "year_idx", "presence"))
query("year_from_index", "SELECT geo, year_idx, CAST(year_idx + 1994 AS INT) AS year FROM fx_panel_year")(lambda v: p.year_from_index(v.panel_year.select("geo", "year_idx"), 1995))
query("stack_train_and_prediction", "SELECT geo, year_idx, presence, CAST(NULL AS BIGINT) AS population, 'train' AS \"set\" FROM fx_presence WHERE year <= 1998 UNION ALL SELECT geo, year_idx, NULL, population, 'prediction' FROM fx_panel_year WHERE year > 1998")(lambda v: p.stack_train_and_prediction(v.presence.filter("year <= 1998").select("geo", "year_idx", "presence"), v.panel_year.filter("year > 1998").select("geo", "year_idx", "population")))
query("drop_columns_if_present", "SELECT geo, year, population FROM fx_panel_year")(lambda v: p.drop_columns_if_present(v.panel_year.select("geo", "year", "population", "n_rows"), ["n_rows", "not_there"]))
query("snake_case_columns", "SELECT geo, location_na, country_id AS country_iso FROM fx_region")(lambda v: p.snake_case_columns(v.region.select("geo", F.col("location_na").alias("LocationNa"), F.col("country_id").alias("Country ISO"))))
query("assign_region_id", "SELECT y.geo, year, CAST(r.n AS INT) AS region_no FROM fx_panel_year y LEFT JOIN (SELECT geo, row_number() OVER (ORDER BY geo) AS n FROM fx_region WHERE country_id < 20) r ON y.geo = r.geo")(lambda v: p.assign_region_id(v.panel_year.select("geo", "year"), v.region.filter("country_id < 20")))
query("align_to_training_schema", "SELECT geo, CAST(year AS INT) AS year, CAST(population AS DOUBLE) AS population, CAST(NULL AS DOUBLE) AS temperature FROM fx_panel_year", "population temperature")(lambda v: p.align_to_training_schema(v.panel_year, v.panel.select("geo", "year", "population", "temperature").schema, fill=True))
query("join_response", "SELECT r.geo, r.year_idx, presence, temperature, precipitation FROM fx_presence r LEFT JOIN (SELECT * FROM fx_climate_year WHERE year < 2001) c ON r.geo = c.geo AND r.year_idx = c.year_idx", "temperature precipitation")(lambda v: p.join_response(v.presence.drop("year"), _climate(v)))
query("densify_panel", "l AS (SELECT geo, year_idx, urban_land FROM fx_panel_year WHERE population % 6 <> 0)---SELECT g.geo, y.year_idx, l.urban_land FROM (SELECT DISTINCT geo FROM l) g CROSS JOIN (SELECT DISTINCT year_idx FROM l) y LEFT JOIN l ON l.geo = g.geo AND l.year_idx = y.year_idx", "urban_land")(lambda v: p.densify_panel(_land(v)))
query("complete_panel_check", _TW + "---SELECT g.geo, y.year_idx, coalesce(n, 0) AS n FROM fx_region g CROSS JOIN (SELECT DISTINCT year_idx FROM tw) y LEFT JOIN (SELECT geo, year_idx, count(*) AS n FROM tw GROUP BY 1, 2) t ON t.geo = g.geo AND t.year_idx = y.year_idx WHERE coalesce(n, 0) <> 1")(lambda v: p.complete_panel_check(_twice(v), v.region))
query("rename_missing_regions", "SELECT CASE WHEN region_id % 5 = 0 AND geo = 'G5' THEN 'G5new' ELSE geo END AS geo, location_na, CASE WHEN region_id % 5 = 0 THEN 'second map' ELSE 'map' END AS source FROM fx_region")(lambda v: p.rename_missing_regions(v.panel_year, v.region.filter("region_id % 5 <> 0").select("geo", "location_na"), v.region.select("geo", "location_na"), {"G5": "G5new"}))
query("filter_bbox", "SELECT geo, longitude, latitude FROM fx_region WHERE longitude BETWEEN 0 AND 20 AND latitude BETWEEN 40 AND 60", "longitude latitude")(lambda v: p.filter_bbox(v.region.select("geo", "longitude", "latitude"), 0, 20, 40, 60))
query("region_mean_over_years", "SELECT geo, " + ", ".join(f"avg({c}) AS {c}" for c in COVS) + ", count(DISTINCT year_idx) AS n_years FROM fx_panel GROUP BY 1", " ".join(COVS))(lambda v: p.region_mean_over_years(v.panel, COVS))
query("parse_year_index_from_dates", "SELECT year AS date_start, geo, CAST(dense_rank() OVER (ORDER BY year) AS INT) AS year_no FROM fx_presence WHERE year >= 1996")(lambda v: p.parse_year_index_from_dates(v.presence.select("geo", F.col("year").alias("date_start")), 1996))
query("correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM fx_panel" for a in COVS[:5] for b in COVS[:5]) + ") q", "r")(lambda v: p.correlation_matrix(v.panel, COVS[:5]))
query("prune_correlated")(lambda v: v.spark.createDataFrame([(c,) for c in p.prune_correlated(p.correlation_matrix(v.panel, COVS), 0.1, ["temperature"])], "kept string"))
query("correlation_with_effect", "SELECT corr(temperature, CAST(presence AS DOUBLE)) AS r, count(*) AS n FROM fx_panel WHERE presence IS NOT NULL", "r")(lambda v: p.correlation_with_effect(v.climate_year.select("geo", "year", F.col("temperature").alias("effect")), v.presence))
