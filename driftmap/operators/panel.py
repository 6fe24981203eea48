"""Panel assembly: keys, joins, completeness, set operations, and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.operators.lineage import numbered

KEYS = ("geo", "year_idx")


def coerce_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("geo", F.col("geo").cast("string")).withColumn("year_idx", F.col("year_idx").cast("int"))


def dedup_keep_first(df: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def assert_unique_key(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys that stand in several rows; there must be none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assemble_panel(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Chained left joins on one key, which share its partitioning."""
    for o in others:
        base = base.join(o, list(keys), "left")
    return base


def unmatched_counts(base: DataFrame, others: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """How many keys of base each covariate table lacks."""
    out = None
    for name, o in others.items():
        n = base.join(o, list(keys), "left_anti").agg(F.count("*").alias("n_unmatched")).select(F.lit(name).alias("table"), "n_unmatched")
        out = n if out is None else out.unionByName(n)
    return out


def same_key_set(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys of one side only, with the side they are on."""
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def keep_complete_rows(df: DataFrame, covariates: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(covariates))


def semi_join_clean(response: DataFrame, clean: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return response.join(clean, list(keys), "left_semi")


def drop_first_year(df: DataFrame) -> DataFrame:
    return df.filter("year_idx > 1").withColumn("year_idx", (F.col("year_idx") - 1).cast("int"))


def drop_last_year_per_region(df: DataFrame) -> DataFrame:
    last = F.max("year_idx").over(Window.partitionBy("geo"))
    return df.withColumn("_last", last).filter("year_idx < _last").drop("_last")


def trim_to_common_years(tables: Sequence[DataFrame]) -> list[DataFrame]:
    """Every table up to the last year of the shortest one."""
    ends = [t.agg(F.max("year_idx").alias("m")) for t in tables]
    last = ends[0]
    for e in ends[1:]:
        last = last.unionByName(e)
    last = last.agg(F.min("m").alias("_last"))
    return [t.crossJoin(F.broadcast(last)).filter("year_idx <= _last").drop("_last") for t in tables]


def restrict_to_regions(presence: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return presence.join(regions, "geo", "left_semi"), regions.join(presence, "geo", "left_semi")


def year_from_index(df: DataFrame, base_year: int) -> DataFrame:
    return df if "year" in df.columns else df.withColumn("year", (F.col("year_idx") + (base_year - 1)).cast("int"))


def stack_train_and_prediction(train: DataFrame, prediction: DataFrame) -> DataFrame:
    return train.withColumn("set", F.lit("train")).unionByName(prediction.withColumn("set", F.lit("prediction")), allowMissingColumns=True)


def drop_columns_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def snake_case(name: str) -> str:
    import re

    parts = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", parts).strip("_").lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(snake_case, df.columns))


def assign_region_id(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Number the mapped regions by geo and join the number to data."""
    ids = numbered(regions.select("geo").distinct(), ("geo",), "region_no")
    return df.join(ids.select("geo", F.col("region_no").cast("int").alias("region_no")), "geo", "left")


def align_to_training_schema(df: DataFrame, schema: T.StructType, fill: bool = False) -> DataFrame:
    """The training columns, in order and type; a missing one is an error, or a typed null if fill is set; others go."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing and not fill:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*((F.lit(None) if f.name in missing else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def join_response(presence: DataFrame, covariates: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return presence.join(covariates, list(keys), "left")


def densify_panel(df: DataFrame) -> DataFrame:
    """All combinations of region and year, with the rows that are there."""
    grid = df.select("geo").distinct().crossJoin(df.select("year_idx").distinct())
    return grid.join(df, list(KEYS), "left")


def complete_panel_check(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Combinations of mapped region and year that don't have exactly one row."""
    grid = regions.select("geo").distinct().crossJoin(df.select("year_idx").distinct())
    n = df.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return grid.join(n, list(KEYS), "full").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).filter("n <> 1")


def rename_missing_regions(df: DataFrame, regions: DataFrame, more: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """The region table with regions that only data has, looked up in a second map, under their new names and with the source."""
    lost = df.select("geo").distinct().exceptAll(regions.select("geo").distinct())
    found = more.join(lost, "geo", "left_semi")
    name = F.coalesce(*(F.when(F.col("geo") == a, F.lit(b)) for a, b in renamed.items()), F.col("geo")) if renamed else F.col("geo")
    return regions.withColumn("source", F.lit("map")).unionByName(found.withColumn("geo", name).withColumn("source", F.lit("second map")), allowMissingColumns=True)


def filter_bbox(regions: DataFrame, west: float = -10, east: float = 31, south: float = 35, north: float = 75) -> DataFrame:
    return regions.filter(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))


def region_mean_over_years(df: DataFrame, covariates: Sequence[str]) -> DataFrame:
    return df.groupBy("geo").agg(*(F.avg(c).alias(c) for c in covariates), F.countDistinct("year_idx").alias("n_years"))


def parse_year_index_from_dates(df: DataFrame, first: int) -> DataFrame:
    """Dense position of each start year among those from first on."""
    d = df.filter(F.col("date_start") >= first)
    idx = d.select("date_start").distinct().withColumn("year_no", F.dense_rank().over(Window.orderBy("date_start")))
    return d.join(F.broadcast(idx), "date_start")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x, y, r of all pairs of columns over rows where both are there, in one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    known = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a).cast("double"))
    one = df.agg(*(F.corr(known(a, b), known(b, a)).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], one.columns, "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), "r")


def prune_correlated(matrix: DataFrame, cutoff: float, protected: Sequence[str] = ()) -> list[str]:
    """Columns to keep: again and again, of the most correlated pair above cutoff the one with the larger mean |r| goes.

    Protected columns stay; it ends where both of a pair are protected. The matrix has one
    row for each pair of columns and is small by its schema.
    """
    r = {(x["x"], x["y"]): abs(x["r"]) for x in matrix.collect() if x["r"] is not None}
    left = sorted({k[0] for k in r})
    while True:
        over = [(-r[a, b], a, b) for i, a in enumerate(left) for b in left[i + 1 :] if r.get((a, b), 0) > cutoff]
        over = [p for p in sorted(over) if not (p[1] in protected and p[2] in protected)] if over and not (min(over)[1] in protected and min(over)[2] in protected) else []
        if not over:
            return left
        _, a, b = over[0]
        mean = {c: sum(r.get((c, d), 0) for d in left if d != c) / max(1, len(left) - 1) for c in (a, b)}
        gone = b if a in protected else a if b in protected else a if mean[a] >= mean[b] else b
        left.remove(gone)


def correlation_with_effect(effects: DataFrame, presence: DataFrame, keys: Sequence[str] = ("geo", "year")) -> DataFrame:
    j = effects.join(presence.filter("presence is not null"), list(keys))
    return j.agg(F.corr("effect", F.col("presence").cast("double")).alias("r"), F.count("*").alias("n"))
