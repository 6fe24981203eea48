"""Queries of grids and points, over cells of half a degree on the lattice of unit squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import grid as g
from driftmap.plans.fixtures import Views
from driftmap.plans.graph import squares
from driftmap.plans.registry import query

_CELL_SQL = "SELECT CAST(2 * grid_row + b AS INT) AS cell_row, CAST(2 * grid_col + a AS INT) AS cell_col, grid_col + 25e-2 + a * 5e-1 AS lon, grid_row + 25e-2 + b * 5e-1 AS lat, d.date, CASE WHEN (region_id + a + b) % 11 = 0 THEN NULL ELSE temperature + a * 1e0 - b * 5e-1 END AS value, d.geo FROM fx_daily d JOIN fx_region r ON d.geo = r.geo CROSS JOIN (SELECT 0 AS a UNION ALL SELECT 1) x CROSS JOIN (SELECT 0 AS b UNION ALL SELECT 1) y"
_CELLS = f"cl AS ({_CELL_SQL})"
_AREA = "(6371.0088e0 * 6371.0088e0 * radians(5e-1) * (sin(radians(lat + 25e-2)) - sin(radians(lat - 25e-2))))"
_DAYS = [f"1996-01-0{d}" for d in range(1, 6)]


def cells(v: Views):
    return v.sql(_CELL_SQL).drop("geo")


def _coverage(v: Views):
    return g.cell_region_coverage(cells(v), squares(v), 0.5)


query("decode_time_axis", "SELECT geo, CAST(date '1995-01-01' + CAST(region_id * 3 AS INT) AS DATE) AS date FROM fx_region")(lambda v: g.decode_time_axis(v.region.select("geo", F.lit("days since 1995-1-1 00:00:00").alias("units"), (F.col("region_id") * 3 + 0.5).alias("time"))).select("geo", "date"))
query("mask_fill_value", "SELECT geo, year, CASE WHEN population % 4 <> 2 THEN CAST(population % 4 AS DOUBLE) END AS value FROM fx_panel_year", "value")(lambda v: g.mask_fill_value(v.panel_year.select("geo", "year", (F.col("population") % 4).cast("double").alias("value"), F.lit(None).cast("double").alias("fill_value"), F.lit(2.0).alias("missing_value")), "value").select("geo", "year", "value"))
query("bounding_box", "SELECT CAST(min(grid_col) AS DOUBLE) AS west, max(grid_col) + 1e0 AS east, CAST(min(grid_row) AS DOUBLE) AS south, max(grid_row) + 1e0 AS north FROM fx_region", "west east south north")(lambda v: g.bounding_box(squares(v)))
query("crop_to_extent", _CELLS + "---SELECT cell_row, cell_col, date, value FROM cl WHERE lon BETWEEN 2 AND 6", "value")(lambda v: g.crop_to_extent(cells(v), squares(v).filter("grid_col between 2 and 5")).select("cell_row", "cell_col", "date", "value"))
query("block_mean", _CELLS + "---SELECT CAST(floor(cell_row / 2) AS INT) AS cell_row, CAST(floor(cell_col / 2) AS INT) AS cell_col, date, avg(value) AS value FROM cl GROUP BY 1, 2, 3", "value")(lambda v: g.block_mean(cells(v)))
query("cell_area", _CELLS + f"---SELECT DISTINCT cell_row, {_AREA} AS area FROM cl", "area")(lambda v: cells(v).select("cell_row", g.cell_area(F.col("lat"), 0.5).alias("area")).distinct())
query("cell_region_coverage", _CELLS + "---SELECT DISTINCT cell_row, cell_col, lat, geo, 1e0 AS frac FROM cl", "lat frac")(_coverage)
query("zonal_weighted_mean", _CELLS + f"---SELECT geo, date, sum(value * {_AREA}) / sum({_AREA}) AS value FROM cl WHERE value IS NOT NULL GROUP BY 1, 2", "value")(lambda v: g.zonal_weighted_mean(cells(v), _coverage(v), 0.5))
query("zonal_sum", _CELLS + "---SELECT geo, date, sum(value) AS value FROM cl GROUP BY 1, 2", "value")(lambda v: g.zonal_sum(cells(v), _coverage(v)))
query("split_by_year", "SELECT geo, date, temperature, CAST(year AS INT) AS year FROM fx_daily WHERE year IN (1996, 1998)", "temperature")(lambda v: g.split_by_year(v.daily.select("geo", "date", "temperature"), [1996, 1998]))
query("pivot_region_by_day", "SELECT geo, " + ", ".join(f"max(CASE WHEN date = DATE '{d}' THEN temperature END) AS \"{d}\"" for d in _DAYS) + " FROM fx_daily GROUP BY geo", " ".join(f'"{d}"' for d in _DAYS))(lambda v: g.pivot_region_by_day(v.daily.select("geo", F.col("date").cast("string").alias("date"), F.col("temperature").alias("value")), _DAYS))
query("points_on_grid", "SELECT CAST(j * 7 + i + 1 AS INT) AS point_id, i * w / 6e0 AS lon, j * h / 4e0 AS lat FROM (SELECT range AS i FROM range(0, 7)) a CROSS JOIN (SELECT range AS j FROM range(0, 5)) b CROSS JOIN (SELECT max(grid_col) + 1e0 AS w, max(grid_row) + 1e0 AS h FROM fx_region) c", "lon lat")(lambda v: g.points_on_grid(squares(v), 7, 5))
_PT = "pt AS (SELECT geo AS point_id, CAST(region_id * 13 % 97 AS DOUBLE) / 9.71e0 AS lon, CAST(region_id * 29 % 89 AS DOUBLE) / 8.93e0 AS lat FROM fx_region), pr AS (SELECT point_id, lon, lat, r.geo FROM pt JOIN fx_region r ON grid_col = floor(lon) AND grid_row = floor(lat))"
_pts = lambda v: v.sql("SELECT geo AS point_id, CAST(region_id * 13 % 97 AS DOUBLE) / 9.71e0 AS lon, CAST(region_id * 29 % 89 AS DOUBLE) / 8.93e0 AS lat FROM fx_region")
query("point_in_region", _PT + "---SELECT * FROM pr", "lon lat")(lambda v: g.point_in_region(_pts(v), squares(v)))
query("fill_empty_regions", _PT + ", mt AS (SELECT * FROM fx_region WHERE geo NOT IN (SELECT geo FROM pr))---SELECT point_id, lon, lat, geo, false AS extra FROM pr UNION ALL SELECT geo || ':' || k, grid_col + a, grid_row + b, geo, true FROM mt CROSS JOIN (VALUES (0, 5e-1, 5e-1), (1, 25e-2, 25e-2), (2, 25e-2, 75e-2), (3, 75e-2, 25e-2), (4, 75e-2, 75e-2)) t(k, a, b)", "lon lat")(lambda v: g.fill_empty_regions(g.point_in_region(_pts(v), squares(v)), squares(v)))
