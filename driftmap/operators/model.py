"""Presence model: design, fit, effects, draws and year-by-year prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.operators import binning, graph
from driftmap.operators.lineage import cut, drop


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def model_design(df: DataFrame, fixed: Sequence[str], binned: Sequence[str], keys: Sequence[str] = ("geo", "year")) -> DataFrame:
    """Long design: a row for each key and term. Fixed terms carry their value, binned ones 1 for their bin's level; intercept is 1."""
    terms = [F.struct(F.lit("intercept").alias("term"), F.lit(1.0).alias("value"))]
    terms += [F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("value")) for c in fixed]
    terms += [F.struct(F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("term"), F.lit(1.0).alias("value")) for c in binned]
    return df.select(*keys, F.inline(F.array(*terms))).filter("term is not null and value is not null")


def fit_presence_model(df: DataFrame, fixed: Sequence[str], binned: Sequence[str], ridge: float = 0.01, rounds: int = 50) -> DataFrame:
    """term, coefficient of a ridge logistic fit of presence on the design, by Spark's own solver. Rows without a response don't train."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    data = df.filter("presence is not null").select(F.col("presence").cast("double").alias("label"), *(F.col(c).cast("double").alias(c) for c in (*fixed, *binned))).dropna()
    data = rows = cut(data)  # the encoder and the solver both read them
    encoder = OneHotEncoder(inputCols=list(binned), outputCols=[f"{c}_v" for c in binned], dropLast=False, handleInvalid="keep").fit(data) if binned else None
    data = encoder.transform(data) if encoder else data
    data = VectorAssembler(inputCols=[*fixed, *(f"{c}_v" for c in binned)], outputCol="features").transform(data)
    fitted = LogisticRegression(maxIter=rounds, regParam=ridge).fit(data)
    names = list(fixed)
    for c, n in zip(binned, encoder.categorySizes if encoder else [], strict=True):
        names += [f"{c}={k}" for k in range(n + 1)]
    drop(rows)
    found = [("intercept", float(fitted.intercept)), *((t, float(w)) for t, w in zip(names, fitted.coefficients, strict=False))]
    return df.sparkSession.createDataFrame(found, "term string, coefficient double")


def fixed_effect_contribution(design: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Each term's share of the linear predictor; unknown terms add nothing. Coefficients have one row for each term."""
    return design.join(F.broadcast(coefficients), "term").withColumn("effect", F.col("value") * F.col("coefficient"))


def random_effect_lookup(binned: DataFrame, effects: DataFrame, column: str) -> DataFrame:
    """Mean and bounds of the effect of each row's bin. effects: bin, mean, lwr, upr."""
    e = effects.select(F.col("bin").alias(f"{column}_bin"), *(F.col(k).alias(f"{column}_effect_{k}") for k in ("mean", "lwr", "upr")))
    return binned.join(F.broadcast(e), f"{column}_bin", "left")


def spatial_effect_join(df: DataFrame, spatial: DataFrame, keys: Sequence[str] = ("geo", "year")) -> DataFrame:
    return df.join(spatial, list(keys), "left")


def effect_map_table(effects: DataFrame, regions: DataFrame, presence: DataFrame, year: int, hidden_bins: Sequence[int] = ()) -> DataFrame:
    """One year's effects on every region, blank for hidden bins and where the species was present the year before. effects: geo, year, bin, effect."""
    was = presence.filter((F.col("year") == year - 1) & (F.col("presence") == 1)).select("geo", F.lit(True).alias("was"))
    j = regions.select("geo").join(effects.filter(F.col("year") == year).select("geo", "bin", "effect"), "geo", "left").join(was, "geo", "left")
    hide = F.coalesce("was", F.lit(False)) | F.coalesce(F.col("bin").isin(*hidden_bins), F.lit(False))
    return j.select("geo", F.when(~hide, F.col("effect")).alias("effect"))


def sum_effects_to_probability(effects: DataFrame, keys: Sequence[str] = ("geo", "year")) -> DataFrame:
    """log_odds and p of each row from its effects, the intercept among them."""
    return effects.groupBy(*keys).agg(F.sum("effect").alias("log_odds")).withColumn("p", inverse_logit(F.col("log_odds")))


def fitted_table(df: DataFrame, fitted: DataFrame, keys: Sequence[str] = ("geo", "year")) -> DataFrame:
    """Fitted probability and log-odds on the full grid of rows."""
    return df.join(fitted.select(*keys, "p", "log_odds"), list(keys), "left")


def draws_to_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns draw_<k> of linear predictors to rows with probabilities; no sort."""
    long = wide.unpivot(list(keys), [c for c in wide.columns if c.startswith("draw_")], "name", "eta")
    return long.select(*keys, F.regexp_replace("name", "^draw_", "").cast("int").alias("draw"), inverse_logit(F.col("eta")).alias("p"))


def score_draws(design: DataFrame, draws: DataFrame, keys: Sequence[str] = ("geo", "year")) -> DataFrame:
    """p of each row and draw. draws: term, draw, coefficient. The join is on terms; sums are taken before the shuffle as far as they can be."""
    j = design.join(draws, "term")
    return j.groupBy(*keys, "draw").agg(inverse_logit(F.sum(F.col("value") * F.col("coefficient"))).alias("p"))


def recurrent_prediction(panel: DataFrame, q: DataFrame, start: DataFrame, coefficient_draws: DataFrame, fixed: Sequence[str], years: Sequence[int], spec: DataFrame | None = None, rounds: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """by, geo, year_idx, draw, p year by year: proximity of a year comes from the mean draws of the year before, the first year's from start.

    by names columns of panel, such as a scenario: each of their values is a course of its
    own, and all go through binning, scoring and one solve a year together. start: geo,
    y_proximity_exp100, and columns of by where courses start apart. With a bin spec of that
    column its bins enter the design, else its value. The state carried from year to year is
    one row for each course and region.
    """
    name, out, keys = "y_proximity_exp100", None, (*by, "geo", "year_idx")
    state = start.select(*(c for c in by if c in start.columns), "geo", name)
    panel, q = cut(panel), cut(q.select("i", "j", "value"))  # every year reads them
    for y in years:
        rows = panel.filter(F.col("year_idx") == y).join(state, [c for c in state.columns if c != name], "left")
        if spec is not None:
            rows = binning.apply_bin_spec(rows, spec, [name])
        design = model_design(rows, [*fixed, *([] if spec is not None else [name])], [f"{name}_bin"] if spec is not None else [], keys)
        p = cut(score_draws(design, coefficient_draws, keys))
        if out is not None:
            drop(state)
        out = p if out is None else out.unionByName(p)
        mean = p.groupBy(*by, "geo").agg(F.avg("p").alias("m"))
        known = mean.select(F.struct(F.lit(y).alias("year_idx"), *by).alias("key"), F.col("geo").alias("node"), (F.col("m") >= 0.5).cast("int").alias("presence"))
        fill = graph.harmonic_fill(q, known, 1, rounds=rounds)
        state = cut(fill.select(*(F.col(f"key.{c}").alias(c) for c in by), F.col("node").alias("geo"), F.col("x").alias(name)))
    return out


def posterior_effect_curve(effects: DataFrame, keys: DataFrame) -> DataFrame:
    """Effects of all columns with the mean value of their bins, by which they are drawn. effects: column, bin, mean, lwr, upr; keys: column, bin, bin_mean."""
    return effects.join(F.broadcast(keys.dropDuplicates(["column", "bin"])), ["column", "bin"], "left").select("column", "bin", "bin_mean", "mean", "lwr", "upr")


def fixed_effect_table(effects: DataFrame) -> DataFrame:
    """Fixed effects without the intercept, with title-case labels."""
    return effects.filter("term <> 'intercept'").select(F.initcap(F.regexp_replace("term", "_", " ")).alias("label"), "mean", "lwr", "upr")


def stdev_of_effect(effects: DataFrame) -> DataFrame:
    return effects.agg(F.stddev_samp("effect").alias("stdev"))
