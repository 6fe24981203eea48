"""Queries of binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import binning as b
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query

BINS = 15
GROUPS = {"precipitation": [(2, 4), (9, 11)]}


def _train(v: Views):
    return v.panel.filter("year <= 1998")


_R = "rg AS (SELECT min(precipitation) AS lo, max(precipitation) AS hi FROM fx_panel WHERE year <= 1998), ub AS (SELECT CAST(range AS INT) AS k FROM range(1, 16))"
_BIN = "CAST(1 + " + " + ".join(f"CAST(least(greatest(precipitation, lo), hi) > lo + (hi - lo) * {k} / 15 AS INT)" for k in range(1, 15)) + " AS INT)"
_RAW = _R + f", rw AS (SELECT p.*, {_BIN} AS raw FROM fx_panel p CROSS JOIN rg)"
_MAP = _RAW + ", fu AS (SELECT DISTINCT raw AS t FROM rw WHERE year <= 1998), rm AS (SELECT k AS bin, arg_min(t, abs(k - t) * 100 + t) AS t FROM ub CROSS JOIN fu GROUP BY 1), cm AS (SELECT *, CAST(dense_rank() OVER (ORDER BY t) AS INT) AS bin_no FROM rm), mg AS (SELECT *, CAST(dense_rank() OVER (ORDER BY CASE WHEN bin_no BETWEEN 2 AND 4 THEN 2 WHEN bin_no BETWEEN 9 AND 11 THEN 9 ELSE bin_no END) AS INT) AS merged_no FROM cm), ap AS (SELECT rw.*, merged_no AS precipitation_bin FROM rw JOIN mg ON rw.raw = mg.bin)"
_KEYS = _MAP + ", ky AS (SELECT precipitation_bin AS bin, min(precipitation) AS bin_min, max(precipitation) AS bin_max, avg(precipitation) AS bin_mean, count(*) AS n FROM ap WHERE year <= 1998 GROUP BY 1)"


def _spec(v: Views):
    return b.save_bin_spec(_train(v), ["precipitation"], BINS, GROUPS)


def _applied(v: Views):
    return b.apply_bin_spec(v.panel, _spec(v), ["precipitation"])


def _raw(v: Views):
    return b.assign_bins(v.panel, b.fit_equal_width_bins(_train(v), ["precipitation"], BINS), "precipitation")


def _map(v: Views):
    return b.bin_map(_train(v), b.fit_equal_width_bins(_train(v), ["precipitation"], BINS), "precipitation", BINS, GROUPS["precipitation"])


query("fit_equal_width_bins", _R + "---SELECT 'precipitation' AS \"column\", CAST(range AS INT) AS k, lo + (hi - lo) * range / 15 AS edge FROM rg CROSS JOIN range(0, 16)", "edge")(lambda v: b.fit_equal_width_bins(_train(v), ["precipitation"], BINS).select("column", F.posexplode("breaks").alias("k", "edge")))
query("assign_bins", _RAW + "---SELECT geo, year, raw AS precipitation_bin FROM rw")(lambda v: _raw(v).select("geo", "year", "precipitation_bin"))
query("empty_bin_remap", _MAP + '---SELECT bin, t AS "to" FROM rm')(lambda v: b.empty_bin_remap(b.assign_bins(_train(v), b.fit_equal_width_bins(_train(v), ["precipitation"], BINS), "precipitation"), "precipitation", BINS))
query("compress_bins", _MAP + '---SELECT bin, t AS "to", bin_no FROM cm')(lambda v: _map(v).drop("merged_no"))
query("merge_bins", _MAP + '---SELECT bin, t AS "to", bin_no, merged_no FROM mg')(_map)
query("merge_spec_table", "SELECT 'precipitation' AS \"column\", lo, hi, (SELECT count(precipitation) FROM fx_panel) AS n FROM (SELECT CAST(2 AS INT) AS lo, CAST(4 AS INT) AS hi UNION ALL SELECT 9, 11) q")(lambda v: b.merge_spec_table(v.panel, GROUPS))
query("bin_keys", _KEYS + "---SELECT bin, bin_min, bin_max, bin_mean, n FROM ky", "bin_min bin_max bin_mean")(lambda v: b.bin_keys(_applied(v).filter("year <= 1998"), "precipitation").drop("range"))
query("attach_bins", _KEYS + "---SELECT geo, year, precipitation_bin, bin_mean AS precipitation_bin_mean FROM ap LEFT JOIN ky ON precipitation_bin = bin WHERE year > 1998", "precipitation_bin_mean")(lambda v: b.attach_bins(_train(v), v.panel.filter("year > 1998"), _spec(v), "precipitation")[1].select("geo", "year", "precipitation_bin", "precipitation_bin_mean"))
query("write_back_bins", _MAP + "---SELECT geo, year_idx, precipitation_bin AS precipitation FROM ap")(lambda v: b.write_back_bins(v.panel.select("geo", "year_idx", "precipitation"), _applied(v).select("geo", "year_idx", F.col("precipitation_bin").alias("precipitation")), ["precipitation"]))
query("bin_all_columns", "r2 AS (SELECT min(temperature) AS a, max(temperature) AS z, min(urban_land) AS c, max(urban_land) AS d FROM fx_panel), " + "w2 AS (SELECT geo, year, CAST(1 + " + " + ".join(f"CAST(temperature > a + (z - a) * {k} / 6 AS INT)" for k in range(1, 6)) + " AS INT) AS t, CAST(1 + " + " + ".join(f"CAST(urban_land > c + (d - c) * {k} / 6 AS INT)" for k in range(1, 6)) + " AS INT) AS u FROM fx_panel CROSS JOIN r2)---SELECT geo, year, CAST((SELECT count(DISTINCT q.t) FROM w2 q WHERE q.t <= w2.t) AS INT) AS temperature_bin, CAST((SELECT count(DISTINCT q.u) FROM w2 q WHERE q.u <= w2.u) AS INT) AS urban_land_bin FROM w2")(lambda v: b.bin_all_columns(v.panel, ["temperature", "urban_land"], 6).select("geo", "year", "temperature_bin", "urban_land_bin"))
query("apply_bin_spec", _MAP + "---SELECT geo, year, precipitation_bin FROM ap")(lambda v: _applied(v).select("geo", "year", "precipitation_bin"))
query("save_bin_spec", _MAP + "---SELECT 'precipitation' AS \"column\", CAST(k - 1 AS INT) AS k, merged_no AS number FROM ub JOIN mg ON k = bin")(lambda v: _spec(v).select("column", F.posexplode("numbers").alias("k", "number")))
query("proximity_bins_reserved", "x AS (SELECT geo, year, temperature, lag(presence) OVER (PARTITION BY geo ORDER BY year) AS prev FROM fx_panel), r3 AS (SELECT min(temperature) AS a, max(temperature) AS z FROM x WHERE coalesce(prev, 0) <> 1), w3 AS (SELECT geo, year, CASE WHEN prev = 1 THEN 1 ELSE 2 + " + " + ".join(f"CAST(temperature > a + (z - a) * {k} / 10 AS INT)" for k in range(1, 10)) + " END AS raw FROM x CROSS JOIN r3)---SELECT geo, year, CAST(dense_rank() OVER (ORDER BY raw) AS INT) AS temperature_bin FROM w3")(lambda v: b.proximity_bins_reserved(v.sql("SELECT geo, year, temperature, lag(presence) OVER (PARTITION BY geo ORDER BY year) AS prev FROM fx_panel"), "temperature", "prev", 10).select("geo", "year", "temperature_bin"))
query("bin_presence_rate", _MAP + "---SELECT precipitation_bin AS bin, avg(presence) AS rate, count(presence) AS n FROM ap GROUP BY 1", "rate")(lambda v: b.bin_presence_rate(_applied(v), "precipitation"))
query("bin_density", _KEYS + "---SELECT bin, CASE WHEN bin_max > bin_min THEN n / (bin_max - bin_min) END AS density FROM ky", "density")(lambda v: b.bin_density(b.bin_keys(_applied(v).filter("year <= 1998"), "precipitation")).select("bin", "density"))
_X = "c2 AS (SELECT CAST(population % 4 + 1 AS INT) AS a, CAST(year % 3 + 1 AS INT) AS b, CASE WHEN population % 11 = 0 THEN NULL WHEN population % 7 < 3 THEN 1 ELSE 0 END AS presence FROM fx_panel_year WHERE NOT (population % 4 = 2 AND year % 3 = 1))"
_x = lambda v: v.sql("SELECT CAST(population % 4 + 1 AS INT) AS a, CAST(year % 3 + 1 AS INT) AS b, CASE WHEN population % 11 = 0 THEN NULL WHEN population % 7 < 3 THEN 1 ELSE 0 END AS presence FROM fx_panel_year WHERE NOT (population % 4 = 2 AND year % 3 = 1)")
query("cross_bins", _X + "---SELECT x.a, y.b, CAST((SELECT count(*) FROM c2 WHERE c2.a = x.a AND c2.b = y.b) AS BIGINT) AS n, x.a || 'x' || y.b AS label, CAST(row_number() OVER (ORDER BY x.a, y.b) AS INT) AS cross_no FROM (SELECT DISTINCT a FROM c2) x CROSS JOIN (SELECT DISTINCT b FROM c2) y")(lambda v: b.cross_bins(_x(v), "a", "b"))
query("cross_bins_collapsed", _X + "---SELECT CASE WHEN a = 1 THEN '1x-' ELSE a || 'x' || b END AS label, avg(presence) AS rate, count(*) AS n, CAST(dense_rank() OVER (ORDER BY CASE WHEN a = 1 THEN '1x-' ELSE a || 'x' || b END) AS INT) AS cross_no FROM c2 GROUP BY 1", "rate")(lambda v: b.cross_bins_collapsed(_x(v), "a", "b"))
