"""Attribution, risk and reporting over posterior draws.

Draw tables are the largest ones: nothing sorts them globally, and all summaries are two
aggregates, first within a draw, then over draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("geo", "region_id", "year_idx", "draw")


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def summary(df: DataFrame, by: Sequence[str], value: str, name: str, median: bool = False) -> DataFrame:
    """Mean and 2.5 % and 97.5 % quantiles over draws, nulls left out."""
    q = lambda p: F.percentile(value, F.lit(p))
    middle = [q(0.5).alias(f"{name}_med")] if median else []
    return df.groupBy(*by).agg(F.avg(value).alias(f"{name}_mean"), *middle, q(0.025).alias(f"{name}_lwr"), q(0.975).alias(f"{name}_upr"))


def pair_draws(factual: DataFrame, counterfactual: DataFrame) -> DataFrame:
    """Inner join on region, year and draw; probabilities are clamped to [0, 1]."""
    both = factual.withColumnRenamed("p", "p_fact").join(counterfactual.select(*KEYS, F.col("p").alias("p_cf")), list(KEYS))
    return both.withColumns({"p_fact": clamp(F.col("p_fact")), "p_cf": clamp(F.col("p_cf"))})


def make_future_scenario(ssp: DataFrame, control: DataFrame, scenario: str, base_year: int) -> DataFrame:
    """Draws of a scenario with the control's, where it has them; the year follows from year_idx if absent."""
    if "year" not in ssp.columns:
        ssp = ssp.withColumn("year", (F.col("year_idx") + F.lit(base_year - 1)).cast("int"))
    c = control.select("geo", "draw", "year_idx", F.col("p").alias("p_cf"))
    return ssp.withColumnRenamed("p", "p_fact").join(c, ["geo", "draw", "year_idx"], "left").withColumn("scenario", F.lit(scenario))


def draw_means(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean factual and counterfactual probability of each draw, and AF, null where the factual mean is 0."""
    d = df.groupBy("draw", *by).agg(F.count("*").alias("t_obs"), F.avg("p_fact").alias("e_fact"), F.avg("p_cf").alias("e_cf"))
    return d.withColumn("af", F.when(F.col("e_fact") > 0, F.col("e_fact") - F.col("e_cf")))


def attribution_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    out = summary(draw_means(df, by), by, "af", "af", median=True)
    return out.withColumns({f"af_pct_{k}": 100 * F.col(f"af_{k}") for k in ("mean", "lwr", "upr")})


def attribution_by_region(df: DataFrame) -> DataFrame:
    return attribution_by(df, ["region_id", "geo"])


def period_label(df: DataFrame, periods: Sequence[tuple[str, int, int]], year: str = "year") -> DataFrame:
    """Add period and its rank; rows of no period go. Periods are a short list."""
    label = rank = F.lit(None)
    for i, (name, lo, hi) in reversed(list(enumerate(periods))):
        inside = F.col(year).between(lo, hi)
        label, rank = F.when(inside, F.lit(name)).otherwise(label), F.when(inside, F.lit(i + 1)).otherwise(rank)
    return df.withColumn("period", label.cast("string")).withColumn("period_rank", rank.cast("int")).filter("period is not null")


def factual_by_period(df: DataFrame, periods: Sequence[tuple[str, int, int]]) -> DataFrame:
    by = ["geo", "period"]
    d = period_label(df, periods).groupBy("draw", *by).agg(F.avg("p_fact").alias("p"))
    return summary(d, by, "p", "p")


def attribution_by_period(df: DataFrame, periods: Sequence[tuple[str, int, int]]) -> DataFrame:
    by = ["geo", "period", "scenario"] if "scenario" in df.columns else ["geo", "period"]
    return summary(draw_means(period_label(df, periods), by), by, "af", "af", median=True)


def attribution_by_year_area_weighted(df: DataFrame, regions: DataFrame) -> DataFrame:
    w = df.join(regions.select("geo", "area_m2"), "geo")
    mean = lambda c: F.sum(F.col(c) * F.col("area_m2")) / F.sum("area_m2")
    d = w.groupBy("draw", "year").agg(mean("p_fact").alias("m_fact"), mean("p_cf").alias("m_cf"), F.countDistinct("geo").alias("n_regions"))
    d = d.withColumn("af", F.col("m_fact") - F.col("m_cf"))
    return summary(d, ["year"], "af", "af").join(d.groupBy("year").agg(F.max("n_regions").alias("n_regions")), "year")


def at_risk(df: DataFrame, population: DataFrame, people: Column) -> DataFrame:
    """Sum of people (a column of p_fact, p_cf, population) in each draw and year, then over draws."""
    j = df.join(population.select("geo", "year", "population"), ["geo", "year"])
    d = j.groupBy("draw", "year").agg(F.sum(people).alias("people"))
    return summary(d, ["year"], "people", "pop")


def population_at_risk_threshold(df: DataFrame, population: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = (F.col("p_fact") >= threshold) & (F.col("p_cf") < threshold)
    return at_risk(df, population, F.when(hit, F.col("population")).otherwise(0).cast("double"))


def population_at_risk_factual(df: DataFrame, population: DataFrame) -> DataFrame:
    return at_risk(df, population, F.col("population") * F.col("p_fact"))


def population_at_risk_attributable(df: DataFrame, population: DataFrame) -> DataFrame:
    return at_risk(df, population, F.col("population") * F.greatest(F.col("p_fact") - F.col("p_cf"), F.lit(0.0)))


def observed_population_exposed(presence: DataFrame, population: DataFrame) -> DataFrame:
    j = presence.join(population.select("geo", "year", "population"), ["geo", "year"])
    return j.groupBy("year").agg(F.sum(F.when(F.col("presence") == 1, F.col("population")).otherwise(0)).alias("pop_observed"))


def combine_risk_series(risk: DataFrame, observed: DataFrame) -> DataFrame:
    cols = [(F.col(c) / 1e6).alias(f"{c}_m") for c in ("pop_mean", "pop_lwr", "pop_upr")]
    return risk.select("year", *cols).join(observed.select("year", (F.col("pop_observed") / 1e6).alias("pop_observed_m")), "year", "left")


def invaded_region_table(attribution: DataFrame, presence: DataFrame, regions: DataFrame) -> DataFrame:
    """Attribution of regions where the species is present, with names, in percent to two digits, largest first."""
    there = presence.filter("presence = 1").select("geo").distinct()
    out = attribution.join(there, "geo", "left_semi").join(regions.select("geo", "location_na", "country_id"), "geo")
    out = out.select("geo", F.col("location_na").alias("region"), F.col("country_id").alias("country"), *(F.round(f"af_pct_{k}", 2).alias(f"attributable_pct_{k}") for k in ("mean", "lwr", "upr")))
    return out.orderBy(F.desc("attributable_pct_mean"), "geo")


def area_weighted_series(values: DataFrame, regions: DataFrame, column: str, name: str) -> DataFrame:
    j = values.join(regions.select("geo", "area_m2"), "geo")
    return j.groupBy("year").agg((F.sum(F.col(column) * F.col("area_m2")) / F.sum("area_m2")).alias(name))


def temperature_delta(scenario: DataFrame, control: DataFrame) -> DataFrame:
    """Area-weighted temperature of a scenario less the control's, by year."""
    return scenario.select("year", F.col("temperature").alias("t_ssp")).join(control.select("year", F.col("temperature").alias("t_ctl")), "year").withColumn("delta_temp", F.col("t_ssp") - F.col("t_ctl"))


def response_regression(df: DataFrame, x: str, y: str, by: str, lo: float, hi: float, points: int, t_quantile: float) -> DataFrame:
    """Least squares of y on x for each group, and its confidence band on an even grid of x."""
    fit = df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_avgx(y, x).alias("mx"), F.regr_count(y, x).alias("n"))
    s2 = (F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / (F.col("n") - 2)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + i * F.lit((hi - lo) / (points - 1)))
    out = fit.withColumn("s2", s2).withColumn("x", F.explode(grid)).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    half = F.lit(t_quantile) * F.sqrt(F.col("s2") * (1 / F.col("n") + (F.col("x") - F.col("mx")) ** 2 / F.col("sxx")))
    return out.select(by, "x", "fit", (F.col("fit") - half).alias("lwr"), (F.col("fit") + half).alias("upr"))


def hazard_ratio(factual: DataFrame, counterfactual: DataFrame, first_year: int, rate: float = 1.55) -> DataFrame:
    """rate ** (T_fact - T_cf) and its log for each region and year from first_year on."""
    j = factual.select("geo", "year", F.col("temperature").alias("t_fact")).join(counterfactual.select("geo", "year", F.col("temperature").alias("t_cf")), ["geo", "year"])
    d = F.col("t_fact") - F.col("t_cf")
    return j.filter(F.col("year") >= first_year).withColumn("hazard_ratio", F.pow(F.lit(rate), d)).withColumn("log_hr", d * F.log(F.lit(rate)))


def hazard_by_period(hazard: DataFrame, regions: DataFrame, periods: Sequence[tuple[str, int, int]]) -> DataFrame:
    """exp of the area-weighted mean log ratio of each year; mean and interval over a period's years."""
    yearly = area_weighted_series(hazard, regions, "log_hr", "m").withColumn("hr", F.exp("m"))
    return summary(period_label(yearly, periods), ["period"], "hr", "hr")


def outbreak_index_change(df: DataFrame, hazard: DataFrame, periods: Sequence[tuple[str, int, int]]) -> DataFrame:
    """p_fact * HR - p_cf: mean over draws of each year, then over the years of a period."""
    j = df.join(hazard.select("geo", "year", "hazard_ratio"), ["geo", "year"])
    yearly = j.groupBy("geo", "year").agg(F.avg(F.col("p_fact") * F.col("hazard_ratio") - F.col("p_cf")).alias("d"))
    return period_label(yearly, periods).groupBy("geo", "period").agg(F.avg("d").alias("delta_index"))


def scenario_period_slice(table: DataFrame, regions: DataFrame, period: str) -> DataFrame:
    """One period's rows joined to every region; regions without a row stay."""
    return regions.select("geo", "location_na").join(table.filter(F.col("period") == period), "geo", "left")


def invasion_year(presence: DataFrame, absent_year: int) -> DataFrame:
    """When each region was invaded: null if never present, absent_year if absent in its latest known year, the last 0 to 1 switch if it ever vanished, else the first year present."""
    known = presence.filter("presence is not null")
    w = Window.partitionBy("geo").orderBy("year")
    k = known.withColumn("before", F.lag("presence").over(w))
    g = k.groupBy("geo").agg(
        F.max_by("presence", "year").alias("latest"),
        F.max(((F.col("before") == 1) & (F.col("presence") == 0)).cast("int")).alias("vanished"),
        F.max(F.when((F.col("before") == 0) & (F.col("presence") == 1), F.col("year"))).alias("switch"),
        F.min(F.when(F.col("presence") == 1, F.col("year"))).alias("first"),
    )
    year = F.when(F.col("first").isNull(), None).when(F.col("latest") == 0, F.lit(absent_year)).when(F.col("vanished") == 1, F.col("switch")).otherwise(F.col("first"))
    return presence.select("geo").distinct().join(g.select("geo", year.cast("int").alias("invasion_year")), "geo", "left")


def cumulative_invasions(invaded: DataFrame, last_year: int) -> DataFrame:
    """Regions invaded in each year and the running total; years without an invasion carry it on."""
    counts = invaded.filter(F.col("invasion_year") <= last_year).groupBy(F.col("invasion_year").alias("year")).agg(F.count("*").alias("n"))
    years = counts.agg(F.min("year").alias("a"), F.max("year").alias("z")).filter("a is not null").select(F.explode(F.sequence("a", "z")).alias("year"))
    filled = years.join(counts, "year", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return filled.withColumn("total", F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def presence_category(presence: DataFrame) -> DataFrame:
    return presence.withColumn("category", F.when(F.col("presence").isNull(), "No data").when(F.col("presence") == 1, "Present").otherwise("Absent"))


def value_range_for_scale(df: DataFrame, column: str, step: float = 0.1) -> DataFrame:
    """Common least and greatest value, and the upper bound in whole steps."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high")).withColumn("upper", F.ceil(F.col("high") / step) * step)


def histogram_share(df: DataFrame, column: str, lo: float, hi: float, bins: int, log: bool = False) -> DataFrame:
    """Rows in even bins from lo to hi as a share of all in range, with log(1 + share) if asked; both ends belong."""
    b = F.least(F.floor((F.col(column) - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    c = df.filter(F.col(column).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return c.withColumn("share", F.log1p(share) if log else share)
