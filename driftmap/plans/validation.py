"""Queries of folds, scores and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import validation as o
from driftmap.plans.fixtures import Views
from driftmap.plans.registry import query

LEVELS = (0.2, 0.35, 0.5, 0.65, 0.8)


def scores(v: Views):
    p = v.draws.groupBy("geo", "year").agg(F.round(F.avg("p_fact"), 3).alias("p"))
    return p.join(v.presence, ["geo", "year"]).select("geo", "year", "p", "presence", (F.col("year") - 1994).cast("int").alias("fold"), (F.col("year") >= 2000).alias("test"))


_S = "sc AS (SELECT d.geo, d.year, p, presence, CAST(d.year - 1994 AS INT) AS fold, d.year >= 2000 AS test FROM (SELECT geo, year, round(avg(p_fact), 3) AS p FROM fx_draws GROUP BY 1, 2) d JOIN fx_presence r ON d.geo = r.geo AND d.year = r.year)"
_C = _S + ", ct AS (SELECT fold, CAST(sum(CASE WHEN presence = 1 AND p >= 5e-1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN presence = 0 AND p < 5e-1 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN presence = 0 AND p >= 5e-1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN presence = 1 AND p < 5e-1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM sc WHERE presence IS NOT NULL GROUP BY 1)"
_M = _C + ", mt AS (SELECT *, CASE WHEN tp + tn + fp + fn <> 0 THEN (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) END AS accuracy, CASE WHEN tp + fn <> 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS sensitivity, CASE WHEN tn + fp <> 0 THEN tn / CAST(tn + fp AS DOUBLE) END AS specificity, CASE WHEN tp + fp <> 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM ct)"
_A = _M + ", au AS (SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 5e-1 ELSE 0e0 END) AS auc FROM sc a JOIN sc b ON a.fold = b.fold AND a.presence = 1 AND b.presence = 0 GROUP BY 1), mf AS (SELECT mt.*, auc FROM mt LEFT JOIN au ON mt.fold = au.fold)"
_MET = "accuracy sensitivity specificity precision f1"
_Q = "least(greatest(p, 1e-10), 1 - 1e-10)"
_DEV = f"-2 * (presence * ln({_Q}) + (1 - presence) * ln(1 - {_Q}))"


def _corners(v: Views):
    return v.region.filter("region_id < 50")


query("temporal_folds", "SELECT geo, year, fold, year = fold AS test, presence AS y_orig, CASE WHEN year <> fold THEN presence END AS presence FROM fx_presence CROSS JOIN (SELECT DISTINCT year AS fold FROM fx_presence WHERE year >= 1999) f")(lambda v: o.temporal_folds(v.presence.select("geo", "year", "presence"), 3))
query("spatial_random_folds", "SELECT CAST(range + 1 AS INT) AS fold, (SELECT count(*) FROM fx_region) // 5 + CASE WHEN range < (SELECT count(*) FROM fx_region) % 5 THEN 1 ELSE 0 END AS n_regions FROM range(0, 5)")(lambda v: o.spatial_random_folds(v.presence).groupBy("fold").agg(F.countDistinct("geo").alias("n_regions")))
query("row_random_folds", "SELECT geo, year, CAST(CAST('0x' || substr(md5('42|' || geo || '|' || year), 1, 8) AS BIGINT) % 5 + 1 AS INT) AS fold FROM fx_presence WHERE presence IS NOT NULL")(lambda v: o.row_random_folds(v.presence).select("geo", "year", "fold"))
query("fold_region_status", "SELECT geo, fold, CASE WHEN region_id % 5 + 1 = fold THEN 'Test' WHEN (region_id + 1) % 5 + 1 = fold AND region_id % 2 = 0 THEN 'Buffer' ELSE 'Train' END AS status FROM fx_region CROSS JOIN (SELECT CAST(range AS INT) AS fold FROM range(1, 6)) f")(lambda v: _status(v))
query("spatial_buffered_folds", "st AS (SELECT geo, fold, CASE WHEN region_id % 5 + 1 = fold THEN 'Test' WHEN (region_id + 1) % 5 + 1 = fold AND region_id % 2 = 0 THEN 'Buffer' ELSE 'Train' END AS status FROM fx_region CROSS JOIN (SELECT CAST(range AS INT) AS fold FROM range(1, 6)) f)---SELECT r.geo, year, fold, status, presence AS y_orig, CASE WHEN status = 'Train' THEN presence END AS presence FROM fx_presence r JOIN st ON r.geo = st.geo WHERE status <> 'Buffer'")(lambda v: o.spatial_buffered_folds(v.presence.select("geo", "year", "presence"), _status(v)))
_Z = "z AS (SELECT geo, (longitude - avg(longitude) OVER ()) / stddev(longitude) OVER () AS zx, (latitude - avg(latitude) OVER ()) / stddev(latitude) OVER () AS zy, pow((longitude - median(longitude) OVER ()) / stddev(longitude) OVER (), 2) + pow((latitude - median(latitude) OVER ()) / stddev(latitude) OVER (), 2) AS d FROM fx_region WHERE region_id < 50)"
query("seed_regions_corners", _Z + "---" + " UNION ALL ".join(f"SELECT '{k}' AS seed, (SELECT geo FROM z ORDER BY round({e}, 9), geo LIMIT 1) AS geo" for k, e in (("SW", "zx + zy"), ("NW", "zx - zy"), ("NE", "-zx - zy"), ("SE", "zy - zx"), ("C", "d"))))(lambda v: o.seed_regions_corners(_corners(v)))
_SEEDS = "s1 AS (SELECT 1 AS seed, geo, longitude, latitude FROM fx_region WHERE geo = 'G0')" + "".join(
    f", n{k} AS (SELECT {k} AS seed, r.geo, r.longitude, r.latitude FROM fx_region r CROSS JOIN s{k - 1} s GROUP BY r.geo, r.longitude, r.latitude"
    f" ORDER BY round(min(pow(r.longitude - s.longitude, 2) + pow(r.latitude - s.latitude, 2)), 6) DESC, r.geo LIMIT 1), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM n{k})"
    for k in range(2, 6)
)
query("seed_regions_farthest", _SEEDS + "---SELECT CAST(seed AS INT) AS seed, geo FROM s5")(lambda v: o.seed_regions_farthest(v.region, 5, "G0"))
query("confusion_metrics", _M + "---SELECT * FROM mt", _MET)(lambda v: o.confusion_metrics(scores(v), ["fold"]))
query("cohen_kappa", _C + "---SELECT fold, ((tp + tn) / n - pe) / (1 - pe) AS kappa FROM (SELECT *, CAST(tp + tn + fp + fn AS DOUBLE) AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + tn + fp + fn, 2) AS pe FROM ct) q", "kappa")(lambda v: o.cohen_kappa(scores(v), ["fold"]))
query("roc_curve", _S + ", g AS (SELECT fold, p, sum(CASE WHEN presence = 1 THEN 1e0 ELSE 0e0 END) AS a, sum(CASE WHEN presence = 0 THEN 1e0 ELSE 0e0 END) AS b FROM sc WHERE presence IS NOT NULL GROUP BY 1, 2)---SELECT fold, p AS threshold, sum(a) OVER w / sum(a) OVER (PARTITION BY fold) AS tpr, sum(b) OVER w / sum(b) OVER (PARTITION BY fold) AS fpr FROM g WINDOW w AS (PARTITION BY fold ORDER BY p DESC)", "threshold tpr fpr")(lambda v: o.roc_curve(scores(v), ["fold"]))
query("auc", _A + "---SELECT fold, auc FROM au", "auc")(lambda v: o.auc(scores(v), ["fold"]))
query("metrics_by_fold", _A + "---SELECT * FROM mf WHERE fold IN (1, 3, 5)", _MET + " auc")(lambda v: o.metrics_by_fold(scores(v), [1, 3, 5]))
query("metrics_overall", _A + "---SELECT " + ", ".join(f"avg({m}) AS {m}" for m in (_MET + " auc").split()) + " FROM mf", _MET + " auc")(lambda v: o.metrics_overall(o.metrics_by_fold(scores(v))))
query("metrics_long", _A + "---" + " UNION ALL ".join(f"SELECT fold, '{m}' AS metric, {m} AS value FROM mf" for m in (_MET + " auc").split()), "value")(lambda v: o.metrics_long(o.metrics_by_fold(scores(v))))
query("abs_error", _S + f"---SELECT geo, year, abs(presence - {_Q}) AS error FROM sc", "error")(lambda v: scores(v).select("geo", "year", o.abs_error(F.col("p"), F.col("presence")).alias("error")))
query("bernoulli_deviance", _S + f"---SELECT geo, year, {_DEV} AS deviance FROM sc", "deviance")(lambda v: scores(v).select("geo", "year", o.bernoulli_deviance(F.col("p"), F.col("presence")).alias("deviance")))
query("binomial_deviance", _S + f"---SELECT geo, year, -2 * (ln(factorial(7)::DOUBLE) - ln(factorial(presence * 3)::DOUBLE) - ln(factorial(7 - presence * 3)::DOUBLE) + presence * 3 * ln({_Q}) + (7 - presence * 3) * ln(1 - {_Q})) AS deviance FROM sc", "deviance")(lambda v: scores(v).select("geo", "year", o.binomial_deviance(F.col("p"), F.col("presence") * 3, F.lit(7)).alias("deviance")))
query("residual_summary", _S + f", e AS (SELECT *, abs(presence - {_Q}) AS e, {_DEV} AS d FROM sc)---SELECT sum(e) AS total_error, avg(e) AS mean_error, sum(d) AS total_deviance, avg(d) AS mean_deviance, sum(CASE WHEN test THEN e END) AS test_error, avg(CASE WHEN test THEN e END) AS test_mean_error, avg(CASE WHEN test THEN d END) AS test_mean_deviance FROM e", "total_error mean_error total_deviance mean_deviance test_error test_mean_error test_mean_deviance")(lambda v: o.residual_summary(scores(v)))
query("cpo_logscore", _S + "---SELECT round(-avg(ln(p)), 4) AS logscore FROM sc WHERE p > 0", "logscore")(lambda v: o.cpo_logscore(scores(v).filter("p > 0").withColumnRenamed("p", "cpo")))
_W = _S + ", w AS (SELECT l AS level, CAST(k AS INT) AS step, greatest(0e0, l - 1e-2 * pow(1.05e0, k)) AS p_lower, least(1e0, l + 1e-2 * pow(1.05e0, k)) AS p_upper FROM (SELECT unnest([2e-1, 3.5e-1, 5e-1, 6.5e-1, 8e-1]) AS l) a CROSS JOIN (SELECT range AS k FROM range(0, 100)) b), h AS (SELECT level, step, p_lower, p_upper, count(*) AS n, avg(presence) AS empirical FROM sc JOIN w ON p BETWEEN p_lower AND p_upper WHERE presence IS NOT NULL GROUP BY ALL HAVING count(*) >= 30), cc AS (SELECT level, p_lower, p_upper, n, empirical FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY step) AS r FROM h) q WHERE r = 1)"
query("calibration_curve", _W + "---SELECT * FROM cc", "level p_lower p_upper empirical")(lambda v: o.calibration_curve(scores(v), LEVELS, 0.01, 30))
_CALIBRATED = """
ws AS (SELECT q_lower, q_upper, k, greatest(0e0, l / pow(1.05e0, k)) AS lo, least(1e0, h * pow(1.05e0, k)) AS hi FROM st CROSS JOIN (SELECT range AS k FROM range(0, 200)) s),
ct AS (SELECT q_lower, q_upper, k, lo, hi, count(*) AS n, avg(p) AS p_mean, avg(presence) AS empirical FROM ws JOIN sc ON p BETWEEN lo AND hi GROUP BY ALL),
f1 AS (SELECT q_lower, min(k) AS k1 FROM ct WHERE n >= {n_min} GROUP BY 1),
f2 AS (SELECT q_lower, min(k) AS k2 FROM ct JOIN f1 USING (q_lower) WHERE k >= k1 AND hi - lo >= {least} GROUP BY 1),
ds AS (SELECT DISTINCT n, q_lower, q_upper, lo AS p_lower, hi AS p_upper, p_mean, empirical FROM ct JOIN f2 USING (q_lower) WHERE k = k2)---
SELECT CAST(row_number() OVER (ORDER BY q_lower, p_lower) AS INT) AS level, n, q_lower, q_upper, p_lower, p_upper, p_mean, empirical FROM ds"""
_AT = "ps[CAST(floor({0}) AS INT) + 1] + ({0} - floor({0})) * (ps[CAST(ceil({0}) AS INT) + 1] - ps[CAST(floor({0}) AS INT) + 1])"
_BY_QUANTILE = _S + f", lp AS (SELECT list(p ORDER BY p) AS ps FROM sc), st AS (SELECT range / 1e2 AS q_lower, (range + 20) / 1e2 AS q_upper, {_AT.format('((len(ps) - 1) * range / 1e2)')} AS l, {_AT.format('((len(ps) - 1) * (range + 20) / 1e2)')} AS h FROM lp CROSS JOIN range(0, 81)),"
_LEVEL = "q_lower q_upper p_lower p_upper p_mean empirical"


def _levels(v: Views, **more):
    return o.calibration_levels(scores(v), **more).drop("empirical_original", "reason")


query("calibration_levels", _BY_QUANTILE + _CALIBRATED.format(n_min=20, least="1.5e-1"), _LEVEL)(lambda v: _levels(v, n_min=20, min_range=0.15))
query("calibration_long", _W + ", s AS (SELECT *, CASE WHEN max(n) OVER () > min(n) OVER () THEN (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) ELSE 1e0 END AS size FROM cc)---" + " UNION ALL ".join(f"SELECT level, size, '{k}' AS kind, {k} AS value FROM s" for k in ("p_lower", "empirical", "p_upper")), "level size value")(lambda v: o.calibration_long(o.calibration_curve(scores(v), LEVELS, 0.01, 30)))


def _status(v: Views):
    folds = v.region.select("geo", (F.col("region_id") % 5 + 1).cast("int").alias("fold"))
    buffers = v.region.filter("region_id % 2 = 0").select("geo", ((F.col("region_id") + 1) % 5 + 1).cast("int").alias("fold"))
    return o.fold_region_status(v.region, folds, buffers)
