"""Climate covariates: daily values to region-year means, ensembles, and alignment to observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}

#: Location names that files write with a question mark for the apostrophe (fixed values).
LOCATION_FIXES = {"Cote-d?Or": "Cote-d’Or", "Cotes-d?Armor": "Cotes-d’Armor", "Val-d?Oise": "Val-d’Oise"}


def fix_location_names(df: DataFrame, column: str, fixes: Mapping[str, str] = LOCATION_FIXES) -> DataFrame:
    name = F.col(column)
    for bad, good in fixes.items():
        name = F.when(F.col(column) == bad, F.lit(good)).otherwise(name)
    return df.withColumn(column, name)


def location_mismatch_report(names: DataFrame, regions: DataFrame) -> DataFrame:
    """Names that only one side has. Both inputs: location_na."""
    a, b = (x.select("location_na").distinct().withColumn(k, F.lit(True)) for x, k in ((names, "in_data"), (regions, "in_map")))
    j = a.join(b, "location_na", "full").na.fill(False, ["in_data", "in_map"])
    return j.filter("not (in_data and in_map)")


def annual_mean(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    return daily.groupBy("geo", "year").agg(*(F.avg(c).alias(f"{c}_mean") for c in columns))


def season_means(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Annual and season means in one pass; winter is December, January and February of one calendar year."""
    by = [F.avg(c).alias(f"{c}_mean") for c in columns]
    for s, months in SEASONS.items():
        by += [F.avg(F.when(F.col("month").isin(*months), F.col(c))).alias(f"{c}_{s}_mean") for c in columns]
    return daily.groupBy("geo", "year").agg(*by)


def moving_average_mean(daily: DataFrame, column: str, n: int = 30, by: Sequence[str] = ("geo", "year")) -> DataFrame:
    """Mean of the centred moving average over n rows; an even n looks one row further ahead. Windows that are cut or hold a null don't count."""
    back = (n - 1) // 2
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(-back, n - 1 - back)
    m = daily.withColumn("_n", F.count(column).over(w)).withColumn("_m", F.avg(column).over(w))
    return m.groupBy(*by).agg(F.avg(F.when(F.col("_n") == n, F.col("_m"))).alias(f"{column}_ma_mean"))


def combine_climate_variables(precipitation: DataFrame, temperature: DataFrame, humidity: DataFrame, keys: Sequence[str] = ("geo", "year")) -> DataFrame:
    return precipitation.join(temperature, list(keys), "left").join(humidity, list(keys), "left")


def stack_years(tables: Sequence[DataFrame], base_year: int) -> DataFrame:
    """Yearly tables in one, with year_idx = year - base_year + 1 whichever years are there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("year_idx", (F.col("year") - base_year + 1).cast("int"))


def missing_column_report(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, and how many."""
    counts = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))
    return counts.unpivot([], counts.columns, "column", "n_missing").filter("n_missing > 0")


def window_years_reindex(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(F.col("year").between(first, last)).withColumn("year_idx", (F.col("year") - first + 1).cast("int"))


def scenario_difference(factual: DataFrame, counterfactual: DataFrame, prefix: str, year: int | None = None) -> DataFrame:
    """Per region: both scenarios' values of all columns with a prefix (one year's, or means over years) and their differences."""
    cols = [c for c in factual.columns if c.startswith(prefix) and c in counterfactual.columns]

    def side(df: DataFrame, end: str) -> DataFrame:
        df = df if year is None else df.filter(F.col("year") == year)
        return df.groupBy("geo").agg(*(F.avg(c).alias(c + end) for c in cols))

    j = side(factual, "").join(side(counterfactual, "__pi"), "geo")
    return j.withColumns({f"{c}__diff": F.col(c) - F.col(f"{c}__pi") for c in cols})


def ensemble_mean(models: DataFrame, columns: Sequence[str], by: Sequence[str] = ("geo", "year")) -> DataFrame:
    """Mean over models, and how many there were."""
    return models.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns), F.countDistinct("model").alias("n_models"))


def overlap_baseline(observed: DataFrame, ensemble: DataFrame, columns: Sequence[str], first: int, last: int) -> DataFrame:
    """Means over the overlap years: <column>_obs and <column>_ref for each region."""
    mean = lambda df, end: df.filter(F.col("year").between(first, last)).groupBy("geo").agg(*(F.avg(c).alias(c + end) for c in columns))
    return mean(observed, "_obs").join(mean(ensemble, "_ref"), "geo", "left")


def delta_additive(obs: Column, model: Column, ref: Column) -> Column:
    return obs + (model - ref)


def delta_ratio(obs: Column, model: Column, ref: Column, least: float = 1e-6) -> Column:
    return obs * model / F.greatest(ref, F.lit(least))


def delta_logit(obs: Column, model: Column, ref: Column, scale: Column, edge: float = 1e-4) -> Column:
    """Shift on the logit scale; values are clamped to [edge, 1 - edge] of scale."""
    inside = lambda c: F.least(F.greatest(c / scale, F.lit(edge)), F.lit(1 - edge))
    logit = lambda c: F.log(inside(c) / (1 - inside(c)))
    x = logit(obs) + logit(model) - logit(ref)
    return scale / (1 + F.exp(-x))


def stitch_future(observed: DataFrame, ensemble: DataFrame, first: int, last: int, future_from: int, rules: Mapping[str, str]) -> DataFrame:
    """Ensemble years from future_from on, aligned to observations by their overlap means.

    rules: column to additive, ratio or logit. Humidity is in percent unless the largest
    observed value is at most 1.5. Helper columns go; year_idx counts from future_from.
    """
    base = overlap_baseline(observed, ensemble, list(rules), first, last)
    out = ensemble.filter(F.col("year") >= future_from).join(base, "geo", "left")
    logits = [c for c, r in rules.items() if r == "logit"]
    if logits:
        top = observed.agg(*(F.max(c).alias(f"_top_{c}") for c in logits))
        out = out.crossJoin(F.broadcast(top))
    made = {}
    for c, rule in rules.items():
        obs, model, ref = F.col(f"{c}_obs"), F.col(c), F.col(f"{c}_ref")
        if rule == "logit":
            made[c] = delta_logit(obs, model, ref, F.when(F.col(f"_top_{c}") <= 1.5, 1.0).otherwise(100.0))
        else:
            made[c] = delta_additive(obs, model, ref) if rule == "additive" else delta_ratio(obs, model, ref)
    return out.select("geo", "year", (F.col("year") - future_from + 1).cast("int").alias("year_idx"), *(x.alias(c) for c, x in made.items()))


def scenario_year_series(tables: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Mean over regions of each year, one labelled series for each table."""
    out = None
    for label, df in tables.items():
        t = df.groupBy("year").agg(*(F.avg(c).alias(c) for c in columns)).withColumn("scenario", F.lit(label))
        out = t if out is None else out.unionByName(t)
    return out
