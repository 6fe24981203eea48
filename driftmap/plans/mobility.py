"""Queries of mobility and its networks."""

from __future__ import annotations

from driftmap.operators import mobility as m
from driftmap.operators import radiation
from driftmap.operators.lineage import cut
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query

YEARS = tuple(range(1995, 2002))
DISTANCES = """
ra AS (SELECT geo, radians(longitude) AS x, atan((1 - 1 / 2.98257223563e2) * tan(radians(latitude))) AS y FROM fx_region),
an AS (SELECT a.geo AS i, b.geo AS j, (a.y + b.y) / 2 AS p, (b.y - a.y) / 2 AS q,
       2 * asin(sqrt(least(pow(sin((b.y - a.y) / 2), 2) + cos(a.y) * cos(b.y) * pow(sin((b.x - a.x) / 2), 2), 1e0))) AS s
       FROM ra a JOIN ra b ON a.geo <> b.geo),
di AS (SELECT i, j, CASE WHEN s = 0 THEN 0e0 ELSE 6.378137e3 * (s - (1 / 2.98257223563e2) / 2 * ((s - sin(s)) * pow(sin(p) * cos(q), 2) / pow(cos(s / 2), 2)
       + (s + sin(s)) * pow(cos(p) * sin(q), 2) / pow(sin(s / 2), 2))) END AS dist FROM an)"""
_F = DISTANCES + ", tt AS (SELECT year, CAST(sum(population) AS DOUBLE) AS total FROM fx_panel_year GROUP BY 1), ps AS (SELECT di.*, b.year, CAST(a.population AS DOUBLE) AS m, CAST(b.population AS DOUBLE) AS n, total FROM di JOIN fx_panel_year b ON b.geo = j JOIN fx_panel_year a ON a.geo = i AND a.year = b.year JOIN tt ON tt.year = b.year), ss AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY year, i ORDER BY round(dist, 9), j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS s FROM ps), fl AS (SELECT year, i, j, dist, m * n / ((m + s) * (m + n + s)) AS prob, m * n / ((m + s) * (m + n + s)) / (1 - m / total) AS prob_rescaled, 0.9e0 * m * (m * n / ((m + s) * (m + n + s))) AS flux FROM ss)"
_T = _F + ", fo AS (SELECT year, i AS geo, sum(flux) AS total_flux_out FROM fl GROUP BY 1, 2), fi AS (SELECT year, j AS geo, sum(flux) AS total_flux_in FROM fl GROUP BY 1, 2), ft AS (SELECT fo.year, fo.geo, total_flux_out, total_flux_in, total_flux_out - total_flux_in AS net_flux_out FROM fo JOIN fi ON fo.year = fi.year AND fo.geo = fi.geo)"
_U = _F + ", un AS (SELECT year, least(i, j) AS i, greatest(i, j) AS j, max(flux) AS flux FROM fl GROUP BY 1, 2, 3)"
_TOP = "tp AS (SELECT geo, total_flux_in FROM ft WHERE year = 1995 ORDER BY total_flux_in DESC, geo LIMIT 10)"
_W = "wd AS (SELECT geo, " + ", ".join(f"max(CASE WHEN year = {y} THEN total_flux_in END) AS y{y}" for y in YEARS) + " FROM ft WHERE geo IN (SELECT geo FROM tp) GROUP BY 1)"


def links(v: Views, **more):
    """One link for each pair of regions and year."""
    return radiation.region_links(v.region, v.panel_year, **more)


def _quantiles(v: Views, *shares: float):
    return radiation.link_quantiles(v.region, v.panel_year, shares)


def totals(v: Views):
    return radiation.region_flux_totals(v.region, v.panel_year)


def _strongest(v: Views, q: float):
    (limit,) = _quantiles(v, q)
    return m.filter_links_quantile(links(v, above=limit), "flux", q, limit=limit)


def _top_and_wide(v: Views):
    t = cut(totals(v))
    return m.pivot_years_wide(t, m.top_k_regions(t, 1995), YEARS)


def _scaled(v: Views):
    t = cut(totals(v).select("year", "geo", "total_flux_in"))
    return m.scale_by_max(t, m.fit_scale(t.filter("year <= 1998"), "total_flux_in"), "total_flux_in")


query("pairwise_distance", DISTANCES + "---SELECT * FROM di", "dist")(lambda v: radiation.region_distances(v.region))
query("duplicate_centroid_check", DISTANCES + "---SELECT * FROM di WHERE dist = 0 OR dist IS NULL", "dist")(lambda v: m.duplicate_centroids(v.region))
query("radiation_flux", _F + "---SELECT year, i, j, flux FROM fl", "flux", digits=3)(lambda v: radiation.region_flux(v.region, v.panel_year, ["flux"]))
query("radiation_prob_rescaled", _F + "---SELECT year, i, j, prob, prob_rescaled FROM fl", "prob prob_rescaled")(lambda v: radiation.region_flux(v.region, v.panel_year, ["prob", "prob_rescaled"]))
query("flux_totals", _T + "---SELECT * FROM ft", "total_flux_out total_flux_in net_flux_out", digits=3)(totals)
query("mobility_by_year", _T + "---SELECT year, geo, net_flux_out, total_flux_in FROM ft", "net_flux_out total_flux_in", digits=3)(lambda v: totals(v).select("year", "geo", "net_flux_out", "total_flux_in"))
query("flux_matrix_to_edges", _U + "---SELECT * FROM un", "flux", digits=3)(links)
query("filter_links_quantile", _U + "---SELECT * FROM un WHERE flux > (SELECT quantile_cont(flux, 0.99) FROM un)", "flux", digits=3)(lambda v: _strongest(v, 0.99))
query("link_strength_percentile", _U + "---SELECT year, i, j, flux, cume_dist() OVER (PARTITION BY year ORDER BY round(flux, 6)) AS strength FROM un", "flux strength", digits=3)(lambda v: radiation.region_link_strength(v.region, v.panel_year, 6))
query("link_strength_class", _U + "---SELECT year, i, j, flux, CAST(1 + (flux > quantile_cont(flux, 0.2) OVER ())::INT + (flux > quantile_cont(flux, 0.4) OVER ())::INT + (flux > quantile_cont(flux, 0.6) OVER ())::INT + (flux > quantile_cont(flux, 0.8) OVER ())::INT AS INT) AS class FROM un", "flux", digits=3)(lambda v: m.link_strength_class(links(v), "flux", limits=_quantiles(v, 0.2, 0.4, 0.6, 0.8)))
query("net_flux_nodes", _T + "---SELECT year, geo, abs(net_flux_out) AS weight FROM ft", "weight", digits=3)(lambda v: m.net_flux_nodes(totals(v)))
query("subset_links_by_map", _U + "---SELECT * FROM un WHERE i IN (SELECT geo FROM fx_region WHERE region_id % 3 = 0) AND j IN (SELECT geo FROM fx_region WHERE region_id % 3 = 0)", "flux", digits=3)(lambda v: links(v, ends=v.region.filter("region_id % 3 = 0")))
query("top_k_regions", _T + ", " + _TOP + "---SELECT * FROM tp", "total_flux_in", digits=3)(lambda v: m.top_k_regions(radiation.region_flux_totals(v.region, v.panel_year.filter("year = 1995")), 1995))
query("pivot_years_wide", _T + ", " + _TOP + ", " + _W + "---SELECT * FROM wd", " ".join(f"y{y}" for y in YEARS), digits=3)(_top_and_wide)
query("unpivot_years_long", _T + ", " + _TOP + ", " + _W + "---SELECT geo, year, value FROM (" + " UNION ALL ".join(f"SELECT geo, {y} AS year, y{y} / 1e3 AS value FROM wd" for y in range(1996, 2001)) + ") q WHERE geo NOT IN ('G1', 'G2')", "value", digits=3)(lambda v: m.unpivot_years_long(_top_and_wide(v), ["G1", "G2"], 1e3, 1996, 2000))
query("scale_by_max", _T + "---SELECT year, geo, total_flux_in / (SELECT max(total_flux_in) FROM ft WHERE year <= 1998) AS total_flux_in FROM ft", "total_flux_in")(_scaled)
