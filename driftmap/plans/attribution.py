"""Queries of attribution, risk and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.operators import attribution as a
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query

PERIODS = (("early", 1995, 1997), ("late", 1999, 2001))
_PERIOD = "CASE WHEN year BETWEEN 1995 AND 1997 THEN 'early' WHEN year BETWEEN 1999 AND 2001 THEN 'late' END"
_Q = lambda v, n: f"avg({v}) AS {n}_mean, quantile_cont({v}, 0.025) AS {n}_lwr, quantile_cont({v}, 0.975) AS {n}_upr"
_DRAWS = "p AS (SELECT geo, region_id, year, year_idx, draw, least(greatest(p_fact * 1.2e0 - 1e-1, 0e0), 1e0) AS p_fact, least(greatest(p_cf * 1.2e0 - 1e-1, 0e0), 1e0) AS p_cf FROM fx_draws)"
_REGION = _DRAWS + ", e AS (SELECT draw, region_id, geo, avg(p_fact) AS ef, avg(p_cf) AS ec FROM p GROUP BY 1, 2, 3), f AS (SELECT *, CASE WHEN ef > 0 THEN ef - ec END AS af FROM e), att AS (SELECT region_id, geo, avg(af) AS af_mean, quantile_cont(af, 0.5) AS af_med, quantile_cont(af, 0.025) AS af_lwr, quantile_cont(af, 0.975) AS af_upr FROM f GROUP BY 1, 2)"


def paired(v: Views) -> DataFrame:
    wide = lambda c: F.col(c) * 1.2 - 0.1  # noqa: E731  some probabilities fall outside, for the clamp
    fact = v.draws.select("geo", "region_id", "year", "year_idx", "draw", wide("p_fact").alias("p"))
    return a.pair_draws(fact, v.draws.select("geo", "region_id", "year_idx", "draw", wide("p_cf").alias("p")))


def _scenarios(v: Views) -> DataFrame:
    one = v.draws.select("geo", "year_idx", "draw", F.col("p_fact").alias("p"))
    ctl = v.draws.filter("region_id % 7 <> 0").select("geo", "year_idx", "draw", F.col("p_cf").alias("p"))
    two = one.withColumn("p", F.col("p") * 0.5)
    return a.make_future_scenario(one, ctl, "SSP370", 1995).unionByName(a.make_future_scenario(two, ctl, "SSP126", 1995))


def _hazard(v: Views) -> DataFrame:
    return a.hazard_ratio(v.climate_year, v.climate_year.withColumn("temperature", F.col("temperature") * 0.9137), 1996)


_SCEN = "s AS (SELECT d.geo, d.year_idx, d.draw, d.p_fact, c.p_cf, CAST(d.year_idx + 1994 AS INT) AS year, 'SSP370' AS scenario FROM fx_draws d LEFT JOIN (SELECT * FROM fx_draws WHERE region_id % 7 <> 0) c ON d.geo = c.geo AND d.year_idx = c.year_idx AND d.draw = c.draw UNION ALL SELECT d.geo, d.year_idx, d.draw, d.p_fact * 5e-1, c.p_cf, CAST(d.year_idx + 1994 AS INT), 'SSP126' FROM fx_draws d LEFT JOIN (SELECT * FROM fx_draws WHERE region_id % 7 <> 0) c ON d.geo = c.geo AND d.year_idx = c.year_idx AND d.draw = c.draw)"
_HAZ = "h AS (SELECT geo, year, temperature AS t_fact, temperature * 0.9137e0 AS t_cf, pow(1.55e0, temperature - temperature * 0.9137e0) AS hazard_ratio, (temperature - temperature * 0.9137e0) * ln(1.55e0) AS log_hr FROM fx_climate_year WHERE year >= 1996)"

query("pair_draws", _DRAWS + "---SELECT * FROM p", "p_fact p_cf")(paired)
query("make_future_scenario", _SCEN + "---SELECT geo, draw, year_idx, p_fact, year, p_cf, scenario FROM s", "p_fact p_cf")(_scenarios)
query("attribution_by_region", _REGION + "---SELECT *, 1e2 * af_mean AS af_pct_mean, 1e2 * af_lwr AS af_pct_lwr, 1e2 * af_upr AS af_pct_upr FROM att", "af_mean af_med af_lwr af_upr af_pct_mean af_pct_lwr af_pct_upr")(lambda v: a.attribution_by_region(paired(v)))
query("period_label", f"SELECT * FROM (SELECT geo, year, {_PERIOD} AS period, CAST(CASE WHEN year < 1998 THEN 1 ELSE 2 END AS INT) AS period_rank FROM fx_panel_year) q WHERE period IS NOT NULL")(lambda v: a.period_label(v.panel_year.select("geo", "year"), PERIODS))
query("factual_probability_by_period", _DRAWS + f", m AS (SELECT draw, geo, {_PERIOD} AS period, avg(p_fact) AS p FROM p GROUP BY 1, 2, 3)---SELECT geo, period, {_Q('p', 'p')} FROM m WHERE period IS NOT NULL GROUP BY 1, 2", "p_mean p_lwr p_upr")(lambda v: a.factual_by_period(paired(v), PERIODS))
query("attribution_by_period", _SCEN + f", m AS (SELECT draw, geo, {_PERIOD} AS period, scenario, avg(p_fact) AS ef, avg(p_cf) AS ec FROM s GROUP BY 1, 2, 3, 4), f AS (SELECT *, CASE WHEN ef > 0 THEN ef - ec END AS af FROM m WHERE period IS NOT NULL)---SELECT geo, period, scenario, {_Q('af', 'af')}, quantile_cont(af, 0.5) AS af_med FROM f GROUP BY 1, 2, 3", "af_mean af_lwr af_upr af_med")(lambda v: a.attribution_by_period(_scenarios(v), PERIODS))
query("attribution_by_year_area_weighted", _DRAWS + f", m AS (SELECT draw, year, sum(p_fact * area_m2) / sum(area_m2) - sum(p_cf * area_m2) / sum(area_m2) AS af, count(DISTINCT p.geo) AS n FROM p JOIN fx_region r ON p.geo = r.geo GROUP BY 1, 2)---SELECT year, {_Q('af', 'af')}, max(n) AS n_regions FROM m GROUP BY 1", "af_mean af_lwr af_upr")(lambda v: a.attribution_by_year_area_weighted(paired(v), v.region))
for _name, _expr, _f in (
    ("population_at_risk_threshold", "CASE WHEN p_fact >= 5e-1 AND p_cf < 5e-1 THEN population ELSE 0 END", a.population_at_risk_threshold),
    ("population_at_risk_factual", "population * p_fact", a.population_at_risk_factual),
    ("population_at_risk_attributable", "population * greatest(p_fact - p_cf, 0e0)", a.population_at_risk_attributable),
):
    query(_name, _DRAWS + f", m AS (SELECT draw, p.year, CAST(sum({_expr}) AS DOUBLE) AS n FROM p JOIN fx_panel_year y ON p.geo = y.geo AND p.year = y.year GROUP BY 1, 2)---SELECT year, {_Q('n', 'pop')} FROM m GROUP BY 1", "pop_mean pop_lwr pop_upr", digits=2)(lambda v, f=_f: f(paired(v), v.panel_year))

_OBS = "o AS (SELECT r.year, CAST(sum(CASE WHEN presence = 1 THEN population ELSE 0 END) AS BIGINT) AS pop_observed FROM fx_presence r JOIN fx_panel_year y ON r.geo = y.geo AND r.year = y.year GROUP BY 1)"
query("observed_population_exposed", _OBS + "---SELECT * FROM o")(lambda v: a.observed_population_exposed(v.presence, v.panel_year))
query("combine_risk_series", _DRAWS + ", " + _OBS + f", m AS (SELECT draw, p.year, sum(population * p_fact) AS n FROM p JOIN fx_panel_year y ON p.geo = y.geo AND p.year = y.year GROUP BY 1, 2), r AS (SELECT year, {_Q('n', 'pop')} FROM m GROUP BY 1)---SELECT r.year, pop_mean / 1e6 AS pop_mean_m, pop_lwr / 1e6 AS pop_lwr_m, pop_upr / 1e6 AS pop_upr_m, pop_observed / 1e6 AS pop_observed_m FROM r LEFT JOIN o ON r.year = o.year", "pop_mean_m pop_lwr_m pop_upr_m pop_observed_m")(lambda v: a.combine_risk_series(a.population_at_risk_factual(paired(v), v.panel_year), a.observed_population_exposed(v.presence, v.panel_year)))
query("invaded_region_table", _REGION + "---SELECT att.geo, location_na AS region, country_id AS country, round(1e2 * af_mean, 2) AS attributable_pct_mean, round(1e2 * af_lwr, 2) AS attributable_pct_lwr, round(1e2 * af_upr, 2) AS attributable_pct_upr FROM att JOIN fx_region r ON att.geo = r.geo WHERE att.geo IN (SELECT geo FROM fx_presence WHERE year = 2001 AND presence = 1)", "attributable_pct_mean attributable_pct_lwr attributable_pct_upr")(lambda v: a.invaded_region_table(a.attribution_by_region(paired(v)), v.presence.filter("year = 2001"), v.region))
query("area_weighted_temperature", "SELECT year, sum(temperature * area_m2) / sum(area_m2) AS temperature FROM fx_climate_year c JOIN fx_region r ON c.geo = r.geo GROUP BY 1", "temperature")(lambda v: a.area_weighted_series(v.climate_year, v.region, "temperature", "temperature"))
_DT = "w AS (SELECT year, sum(temperature * area_m2) / sum(area_m2) AS t FROM fx_climate_year c JOIN fx_region r ON c.geo = r.geo GROUP BY 1)"
query("temperature_delta", _DT + "---SELECT year, t AS t_ssp, t * 9e-1 - 1e0 AS t_ctl, t - (t * 9e-1 - 1e0) AS delta_temp FROM w", "t_ssp t_ctl delta_temp")(lambda v: a.temperature_delta(s := a.area_weighted_series(v.climate_year, v.region, "temperature", "temperature"), s.withColumn("temperature", F.col("temperature") * 0.9 - 1)))
query("response_regression", "f AS (SELECT CAST(year % 2 AS INT) AS series, regr_slope(precipitation, temperature) AS b, regr_intercept(precipitation, temperature) AS a, regr_sxx(precipitation, temperature) AS sxx, regr_syy(precipitation, temperature) AS syy, regr_avgx(precipitation, temperature) AS mx, count(*) AS n FROM fx_climate_year GROUP BY 1), g AS (SELECT f.*, (syy - b * b * sxx) / (n - 2) AS s2, range * (8e0 / 199) AS x FROM f CROSS JOIN range(0, 200))---SELECT series, x, a + b * x AS fit, a + b * x - 1.96e0 * sqrt(s2 * (1e0 / n + (x - mx) ** 2 / sxx)) AS lwr, a + b * x + 1.96e0 * sqrt(s2 * (1e0 / n + (x - mx) ** 2 / sxx)) AS upr FROM g", "x fit lwr upr")(lambda v: a.response_regression(v.climate_year.withColumn("series", (F.col("year") % 2).cast("int")), "temperature", "precipitation", "series", 0.0, 8.0, 200, 1.96))
query("hazard_ratio", _HAZ + "---SELECT * FROM h", "t_fact t_cf hazard_ratio log_hr")(_hazard)
query("hazard_by_decade", _HAZ + f", y AS (SELECT year, exp(sum(log_hr * area_m2) / sum(area_m2)) AS hr FROM h JOIN fx_region r ON h.geo = r.geo GROUP BY 1)---SELECT {_PERIOD} AS period, {_Q('hr', 'hr')} FROM y WHERE {_PERIOD} IS NOT NULL GROUP BY 1", "hr_mean hr_lwr hr_upr")(lambda v: a.hazard_by_period(_hazard(v), v.region, PERIODS))
query("outbreak_index_change", _HAZ + f", y AS (SELECT d.geo, d.year, avg(p_fact * hazard_ratio - p_cf) AS d FROM fx_draws d JOIN h ON d.geo = h.geo AND d.year = h.year GROUP BY 1, 2)---SELECT geo, {_PERIOD} AS period, avg(d) AS delta_index FROM y WHERE {_PERIOD} IS NOT NULL GROUP BY 1, 2", "delta_index")(lambda v: a.outbreak_index_change(v.draws, _hazard(v), PERIODS))
query("scenario_period_slice", f"m AS (SELECT geo, {_PERIOD} AS period, max(population) AS top FROM fx_panel_year WHERE population % 3 = 0 GROUP BY 1, 2)---SELECT r.geo, location_na, period, top FROM fx_region r LEFT JOIN (SELECT * FROM m WHERE period = 'late') m ON r.geo = m.geo")(lambda v: a.scenario_period_slice(a.period_label(v.panel_year.filter("population % 3 = 0"), PERIODS).groupBy("geo", "period").agg(F.max("population").alias("top")), v.region, "late"))
_INV = "k AS (SELECT geo, year, presence, lag(presence) OVER (PARTITION BY geo ORDER BY year) AS b FROM fx_presence WHERE presence IS NOT NULL), g AS (SELECT geo, arg_max(presence, year) AS latest, max(CASE WHEN b = 1 AND presence = 0 THEN 1 ELSE 0 END) AS gone, max(CASE WHEN b = 0 AND presence = 1 THEN year END) AS sw, min(CASE WHEN presence = 1 THEN year END) AS fi FROM k GROUP BY geo), iv AS (SELECT q.geo, CAST(CASE WHEN fi IS NULL THEN NULL WHEN latest = 0 THEN 2024 WHEN gone = 1 THEN sw ELSE fi END AS INT) AS invasion_year FROM (SELECT DISTINCT geo FROM fx_presence) q LEFT JOIN g ON q.geo = g.geo)"
query("invasion_year", _INV + "---SELECT * FROM iv")(lambda v: a.invasion_year(v.presence, 2024))
query("cumulative_invasions", _INV + ", c AS (SELECT invasion_year AS year, count(*) AS n FROM iv WHERE invasion_year <= 2023 GROUP BY 1), y AS (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) + 1 FROM c))) AS year)---SELECT CAST(y.year AS INT) AS year, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY y.year) AS BIGINT) AS total FROM y LEFT JOIN c ON y.year = c.year")(lambda v: a.cumulative_invasions(a.invasion_year(v.presence, 2024), 2023))
query("presence_category", "SELECT *, CASE WHEN presence IS NULL THEN 'No data' WHEN presence = 1 THEN 'Present' ELSE 'Absent' END AS category FROM fx_presence")(lambda v: a.presence_category(v.presence))
query("value_range_for_scale", "SELECT min(temperature) AS low, max(temperature) AS high, ceil(max(temperature) / 1e-1) * 1e-1 AS upper FROM fx_climate_year", "low high upper")(lambda v: a.value_range_for_scale(v.climate_year, "temperature"))
query("histogram_share", "b AS (SELECT CAST(least(floor((precipitation - 0e0) / (1e1 / 20)), 19) AS INT) AS bin, count(*) AS n FROM fx_daily WHERE precipitation BETWEEN 0e0 AND 1e1 GROUP BY 1)---SELECT bin, n, ln(1 + n / sum(n) OVER ()) AS share FROM b", "share")(lambda v: a.histogram_share(v.daily, "precipitation", 0.0, 10.0, 20, log=True))
