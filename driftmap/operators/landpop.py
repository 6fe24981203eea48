"""Land use and population by region and year."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def land_use_classes(df: DataFrame, crops: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """croplands as the mean of the crop columns, null if any is null, and the other classes."""
    total = F.col(crops[0])
    for c in crops[1:]:
        total = total + F.col(c)
    return df.select("geo", "year", (total / len(crops)).alias("croplands"), *keep)


def tag_scenario_by_year(df: DataFrame, last_historical: int = 2014, scenario: str = "SSP370") -> DataFrame:
    return df.withColumn("scenario", F.when(F.col("year") <= last_historical, "historical").otherwise(scenario))


def regional_level_shift(df: DataFrame, columns: Sequence[str], historical: str = "historical") -> DataFrame:
    """Per region and column, the coefficient of the later scenario in a least squares fit on year and scenario.

    In closed form from grouped sums of squares; null where years or scenarios don't vary
    apart from each other.
    """
    long = df.withColumn("_s", F.when(F.col("scenario") == historical, 0.0).otherwise(1.0)).withColumn("_t", F.col("year").cast("double"))
    long = long.unpivot(["geo", "_s", "_t"], list(columns), "column", "v").filter("v is not null")
    cross = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / F.count("v")
    g = long.groupBy("geo", "column").agg(cross("_s", "_s").alias("ss"), cross("_t", "_t").alias("tt"), cross("_s", "_t").alias("st"), cross("_s", "v").alias("sy"), cross("_t", "v").alias("ty"))
    det = F.col("ss") * F.col("tt") - F.col("st") * F.col("st")
    return g.select("geo", "column", F.when(F.abs(det) > 1e-9, (F.col("sy") * F.col("tt") - F.col("ty") * F.col("st")) / det).alias("shift"))


def remove_level_shift(df: DataFrame, shifts: DataFrame, columns: Sequence[str], historical: str = "historical") -> DataFrame:
    """scaled_<column>: the column less its region's shift in years of the later scenario. All columns in one join."""
    wide = shifts.groupBy("geo").pivot("column", list(columns)).agg(F.first("shift"))
    wide = wide.select("geo", *(F.col(c).alias(f"_shift_{c}") for c in columns))
    out = df.join(wide, "geo", "left")
    later = F.col("scenario") != historical
    out = out.withColumns({f"scaled_{c}": F.when(later, F.col(c) - F.coalesce(F.col(f"_shift_{c}"), F.lit(0.0))).otherwise(F.col(c)) for c in columns})
    return out.drop(*(f"_shift_{c}" for c in columns))


def keep_scaled_columns(df: DataFrame, first_year: int) -> DataFrame:
    cols = [c for c in df.columns if c.startswith("scaled_")]
    return df.filter(F.col("year") >= first_year).select("geo", "year", (F.col("year") - first_year + 1).cast("int").alias("year_idx"), *(F.col(c).alias(c.removeprefix("scaled_")) for c in cols))


def area_weighted_year_mean(df: DataFrame, regions: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Area-weighted mean of each year. A region counts with its area even where its value is null; a missing area counts as 1."""
    j = df.join(regions.select("geo", "area_m2"), "geo", "left").withColumn("_a", F.coalesce("area_m2", F.lit(1.0)))
    return j.groupBy("year").agg(*((F.sum(F.col(c) * F.col("_a")) / F.sum("_a")).alias(c) for c in columns)).withColumn("series", F.lit(label))


#: Newton steps after which a region's trend counts as not found.
TREND_STEPS = 500


def _least_squares(x: np.ndarray, n: np.ndarray, sy: np.ndarray, syy: np.ndarray, key: np.ndarray, keys: int) -> tuple[np.ndarray, ...]:
    """a, b, sums w0 to w2, rss and whether it was found, of the least-squares curve exp(a + b x) of each key.

    Rows are sums over n values of y at one x. Newton steps, or Gauss-Newton ones where the
    Hessian isn't positive, are halved until the sum of squares falls; keys that have arrived
    leave the set that is worked on.
    """
    total = lambda v, k, m: np.bincount(k, v, m)
    scale = np.maximum(np.sqrt(total(syy, key, keys) / total(n, key, keys)), 1e-300)
    sy, syy = sy / scale[key], syy / scale[key] ** 2
    a, b, found = np.log(total(sy, key, keys) / total(n, key, keys)), np.zeros(keys), np.zeros(keys, bool)
    live = np.arange(keys)

    def rss(a: np.ndarray, b: np.ndarray, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        mu = np.exp(np.minimum(a[k] + b[k] * x[rows], 300))
        return total(syy[rows] - 2 * mu * sy[rows] + n[rows] * mu * mu, k, len(a))

    for _ in range(TREND_STEPS):
        if not len(live):
            break
        place = np.full(keys, -1)
        place[live] = np.arange(len(live))
        rows = np.flatnonzero(place[key] >= 0)
        k, m, xs = place[key[rows]], len(live), x[rows]
        mu = np.exp(np.minimum(a[live][k] + b[live][k] * xs, 300))
        down = mu * (sy[rows] - n[rows] * mu)
        ga, gb = total(down, k, m), total(down * xs, k, m)
        flat = n[rows] * mu * mu
        full = [total((flat - down) * xs**i, k, m) for i in range(3)]
        gauss = [total(flat * xs**i, k, m) for i in range(3)]
        good = (full[0] > 0) & (full[0] * full[2] - full[1] ** 2 > 1e-14 * full[0] * np.abs(full[2]))
        h0, h1, h2 = (np.where(good, f, g) for f, g in zip(full, gauss, strict=True))
        with np.errstate(all="ignore"):
            det = h0 * h2 - h1 * h1
            da, db = (ga * h2 - gb * h1) / det, (h0 * gb - h1 * ga) / det
        before = rss(a[live], b[live], rows, k)
        step, ok = np.ones(m), np.isfinite(da) & np.isfinite(db)
        da, db = np.where(ok, da, 0.0), np.where(ok, db, 0.0)
        arrived = ok & good & (np.abs(da) + np.abs(db) < 1e-6)  # the last step, too small for sums of squares to tell
        for _ in range(60):
            after = rss(a[live] + step * da, b[live] + step * db, rows, k)
            worse = ~(after <= before) & ~arrived
            if not worse.any():
                break
            step[worse] /= 2
        step[worse] = 0
        a[live] += step * da
        b[live] += step * db
        found[live[arrived]] = True
        live = live[ok & ~arrived & ~worse]
    mu = np.exp(np.minimum(a[key] + b[key] * x, 300))
    sums = [total(n * mu * mu * x**i, key, keys) * scale**2 for i in range(3)]
    squares = np.maximum(total(syy - 2 * mu * sy + n * mu * mu, key, keys), 0) * scale**2
    return a + np.log(scale), b, *sums, squares, found


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [batch.column(c) for c in ("year", "n", "sy", "syy")]
        year, n, sy, syy = (c.flatten().to_numpy().astype(float) for c in lists)
        key = np.repeat(np.arange(len(batch)), np.diff(lists[0].offsets.to_numpy()))
        count = np.bincount(key, n, len(batch))
        mean = np.bincount(key, n * year, len(batch)) / count
        a, b, w0, w1, w2, rss, found = _least_squares(year - mean[key], n, sy, syy, key, len(batch))
        lost = lambda v: pa.array(v, mask=~found)
        cols = [batch.column("geo"), lost(a), lost(b), lost(w0), lost(w1), lost(w2), pa.array(count.astype(np.int64)), lost(rss / np.maximum(count - 2, 1)), pa.array(mean), pa.array(found)]
        yield pa.RecordBatch.from_arrays(cols, ["geo", "a", "b", "w0", "w1", "w2", "n", "s2", "mean_year", "converged"])


def fit_population_trend(df: DataFrame, min_years: int = 3) -> DataFrame:
    """Per region, the gaussian fit of exp(a + b x) to population, as a glm with log link gives it, x = year less the region's mean year.

    Needs min_years different years with a positive population. Rows of a year are summed
    first, so a region is as many rows as it has years, and all regions are fitted in the
    tasks that hold them, each until it has converged. Returns geo, a, b, w0, w1, w2, s2
    (parts of the covariance), n, mean_year, converged; where a fit doesn't converge within
    TREND_STEPS steps its figures are null.
    """
    pos = df.filter("population > 0").select("geo", "year", F.col("population").cast("double").alias("y"))
    years = pos.groupBy("geo", "year").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    cells = years.groupBy("geo").agg(F.array_sort(F.collect_list(F.struct("year", "n", "sy", "syy"))).alias("c")).filter(F.size("c") >= min_years)
    lists = cells.select("geo", *(F.col(f"c.{k}").cast("array<double>").alias(k) for k in ("year", "n", "sy", "syy")))
    kind = df.schema["geo"].dataType.simpleString()
    return lists.mapInArrow(_fitted, f"geo {kind}, a double, b double, w0 double, w1 double, w2 double, n bigint, s2 double, mean_year double, converged boolean")


def extrapolate_next_year(fit: DataFrame, year: int, z: float = 1.96) -> DataFrame:
    """Prediction for one year with bounds of z standard errors on the link scale; null where the trend is."""
    x = F.lit(float(year)) - F.col("mean_year")
    det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
    var = F.col("s2") * (F.col("w2") - 2 * x * F.col("w1") + x * x * F.col("w0")) / det
    eta = F.col("a") + F.col("b") * x
    return fit.select("geo", F.lit(year).alias("year"), F.exp(eta).alias("population"), F.exp(eta - z * F.sqrt(var)).alias("lwr"), F.exp(eta + z * F.sqrt(var)).alias("upr"), F.lit(True).alias("is_extrapolated"))


def cap_growth(predicted: DataFrame, observed: DataFrame, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Predictions within low and high times the region's last value; where none is there, the last value."""
    last = observed.groupBy("geo").agg(F.max_by("population", "year").cast("double").alias("last"))
    j = last.join(predicted.select("geo", F.col("population").alias("p")), "geo", "left")
    return j.select("geo", F.least(F.greatest(F.coalesce("p", "last"), F.col("last") * low), F.col("last") * high).alias("population"))


def append_extrapolated(observed: DataFrame, extra: DataFrame, year: int) -> DataFrame:
    rows = extra.select("geo", F.lit(year).alias("year"), "population", F.lit(True).alias("is_extrapolated"))
    return observed.select("geo", "year", F.col("population").cast("double").alias("population"), F.lit(False).alias("is_extrapolated")).unionByName(rows)


def population_density(df: DataFrame, regions: DataFrame) -> DataFrame:
    area = regions.select("geo", (F.col("area_m2") / 1e6).alias("area"))
    return df.join(area, "geo", "left").withColumn("population_density", F.col("population") / F.col("area"))


def population_map_table(density: DataFrame, year: int | None = None) -> DataFrame:
    d = density if year is None else density.filter(F.col("year") == year)
    return d.groupBy("geo").agg(F.avg("population_density").alias("density")).withColumn("log_density", F.when(F.col("density") > 0, F.log("density")))


def land_use_map_table(df: DataFrame, columns: Sequence[str], year: int | None = None) -> DataFrame:
    d = df if year is None else df.filter(F.col("year") == year)
    return d.groupBy("geo").agg(*(F.avg(c).alias(c) for c in columns))
