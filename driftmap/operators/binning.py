"""Binning of covariates: breaks fitted on training rows, saved as a spec, applied to later ones.

A spec has one row for each column: breaks, and for each raw bin its final number. It is
small and is broadcast; data rows are never shuffled to get their bin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _even(lo: Column, hi: Column, bins: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: lo + (hi - lo) * i / bins)


def fit_equal_width_bins(df: DataFrame, columns: Sequence[str], bins: int, label_digits: int | None = None) -> DataFrame:
    """column, breaks: bins + 1 even breaks from least to greatest training value; rounded to significant digits if asked, as breaks read from printed labels are."""
    ends = df.agg(*(x for c in columns for x in (F.min(c).cast("double").alias(f"lo|{c}"), F.max(c).cast("double").alias(f"hi|{c}"))))
    out = None
    for c in columns:
        b = _even(F.col(f"`lo|{c}`"), F.col(f"`hi|{c}`"), bins)
        if label_digits:
            size = lambda x: F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (label_digits - 1))
            b = F.transform(b, lambda x: F.when(x == 0, 0.0).otherwise(F.round(x / size(x)) * size(x)))
        row = ends.select(F.lit(c).alias("column"), b.alias("breaks"))
        out = row if out is None else out.unionByName(row)
    return out


def bin_of(x: Column, breaks: Column, include_lowest: bool = True) -> Column:
    """Number of the right-closed interval, after clamping to the outer breaks; the lowest break belongs to bin 1 or to none."""
    first, last = F.element_at(breaks, 1), F.element_at(breaks, -1)
    v = F.least(F.greatest(x, first), last)
    n = F.aggregate(F.slice(breaks, 2, F.size(breaks) - 2), F.lit(1), lambda a, b: a + (v > b).cast("int"))
    return F.when(x.isNull(), None).when(F.lit(not include_lowest) & (v <= first), None).otherwise(n)


def assign_bins(df: DataFrame, spec: DataFrame, column: str, include_lowest: bool = True) -> DataFrame:
    one = spec.filter(F.col("column") == column).select(F.col("breaks").alias("_b"))
    return df.crossJoin(F.broadcast(one)).withColumn(f"{column}_bin", bin_of(F.col(column), F.col("_b"), include_lowest)).drop("_b")


def empty_bin_remap(binned: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, to: each bin's nearest non-empty one, the lower of two."""
    full = binned.select(F.col(f"{column}_bin").alias("to")).filter("to is not null").distinct()
    every = binned.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.crossJoin(F.broadcast(full)).groupBy("bin").agg(F.min(F.struct(F.abs(F.col("bin") - F.col("to")).alias("d"), "to")).alias("m")).select("bin", F.col("m.to").alias("to"))


def compress_bins(remap: DataFrame) -> DataFrame:
    """Number the bins that are used 1 to k. The table has one row for each bin."""
    return remap.withColumn("bin_no", F.dense_rank().over(Window.orderBy("to")))


def merge_bins(numbered: DataFrame, groups: Sequence[tuple[int, int]]) -> DataFrame:
    """Merge ranges of bin_no, keep the order, number again without gaps: merged_no."""
    lead = F.col("bin_no")
    for lo, hi in groups:
        lead = F.when(F.col("bin_no").between(lo, hi), F.lit(lo)).otherwise(lead)
    return numbered.withColumn("_l", lead).withColumn("merged_no", F.dense_rank().over(Window.orderBy("_l"))).drop("_l")


def merge_spec_table(df: DataFrame, groups: Mapping[str, Sequence[tuple[int, int]]]) -> DataFrame:
    """column, lo, hi, n: the groups of bins to merge of each column that df has, with the number of its known values."""
    rows = [(c, lo, hi) for c, g in groups.items() if c in df.columns for lo, hi in g]
    table = df.sparkSession.createDataFrame(rows, "column string, lo int, hi int")
    known = df.agg(*(F.count(c).alias(c) for c in dict.fromkeys(r[0] for r in rows))) if rows else df.agg(F.count("*").alias("_"))
    return table.join(known.unpivot([], known.columns, "column", "n"), "column")


def bin_map(df: DataFrame, spec: DataFrame, column: str, bins: int, groups: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """bin, to, bin_no, merged_no of one column from its training rows."""
    return merge_bins(compress_bins(empty_bin_remap(assign_bins(df, spec, column), column, bins)), groups)


def save_bin_spec(df: DataFrame, columns: Sequence[str], bins: int, groups: Mapping[str, Sequence[tuple[int, int]]] | None = None) -> DataFrame:
    """column, breaks, numbers: the whole spec, to be written and applied later."""
    spec, out = fit_equal_width_bins(df, columns, bins), None
    for c in columns:
        m = bin_map(df, spec, c, bins, (groups or {}).get(c, ()))
        row = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "merged_no"))), lambda s: s["merged_no"]).alias("numbers")).withColumn("column", F.lit(c))
        out = row if out is None else out.unionByName(row)
    return spec.join(F.broadcast(out), "column")


def apply_bin_spec(df: DataFrame, spec: DataFrame, columns: Sequence[str], include_lowest: bool = True) -> DataFrame:
    """<column>_bin of every row by a saved spec, all columns in one pass."""
    wide = spec.agg(*(F.max(F.when(F.col("column") == c, F.struct("breaks", "numbers"))).alias(f"_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(wide))
    made = {f"{c}_bin": F.element_at(F.col(f"_{c}.numbers"), bin_of(F.col(c), F.col(f"_{c}.breaks"), include_lowest)) for c in columns}
    return out.withColumns(made).drop(*(f"_{c}" for c in columns))


def bin_keys(binned: DataFrame, column: str) -> DataFrame:
    """Of each bin: least, greatest and mean value, rows, and a range label."""
    g = binned.filter(F.col(f"{column}_bin").isNotNull()).groupBy(F.col(f"{column}_bin").alias("bin")).agg(F.min(column).alias("bin_min"), F.max(column).alias("bin_max"), F.avg(column).alias("bin_mean"), F.count("*").alias("n"))
    return g.withColumn("range", F.format_string("[%.3f, %.3f]", "bin_min", "bin_max"))


def attach_bins(train: DataFrame, prediction: DataFrame, spec: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Bins and the training mean of each bin, on both tables."""
    t, p = (apply_bin_spec(x, spec, [column]) for x in (train, prediction))
    keys = bin_keys(t, column).select(F.col("bin").alias(f"{column}_bin"), F.col("bin_mean").alias(f"{column}_bin_mean"))
    return tuple(x.join(F.broadcast(keys), f"{column}_bin", "left") for x in (t, p))


def write_back_bins(panel: DataFrame, binned: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("geo", "year_idx")) -> DataFrame:
    """Replace columns by those of another table with the same key."""
    return panel.drop(*columns).join(binned.select(*keys, *columns), list(keys), "left")


def bin_all_columns(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    return apply_bin_spec(df, save_bin_spec(df, columns, bins), columns)


def proximity_bins_reserved(df: DataFrame, column: str, previous: str, bins: int) -> DataFrame:
    """Bin 1 is for rows present the year before; others are cut by breaks of the absent rows, numbered on from 2 without gaps."""
    absent = df.filter(F.coalesce(F.col(previous), F.lit(0)) != 1)
    spec = fit_equal_width_bins(absent, [column], bins)
    cut = assign_bins(df, spec, column).withColumn("_raw", F.when(F.col(previous) == 1, F.lit(1)).otherwise(F.col(f"{column}_bin") + 1)).drop(f"{column}_bin")
    numbers = cut.select("_raw").filter("_raw is not null").distinct().withColumn(f"{column}_bin", F.dense_rank().over(Window.orderBy("_raw")))
    return cut.join(F.broadcast(numbers), "_raw", "left").drop("_raw")


def bin_presence_rate(binned: DataFrame, column: str) -> DataFrame:
    return binned.groupBy(F.col(f"{column}_bin").alias("bin")).agg(F.avg("presence").alias("rate"), F.count("presence").alias("n"))


def bin_density(keys: DataFrame) -> DataFrame:
    """Rows for each unit of the covariate; null for a bin of one value."""
    width = F.col("bin_max") - F.col("bin_min")
    return keys.withColumn("density", F.when(width > 0, F.col("n") / width))


def cross_bins(df: DataFrame, x: str, y: str) -> DataFrame:
    """All combinations of two binned columns, a label, a dense number and how many rows have them."""
    grid = df.select(x).distinct().crossJoin(df.select(y).distinct())
    n = df.groupBy(x, y).agg(F.count("*").alias("n"))
    g = grid.join(n, [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return g.withColumn("label", F.concat_ws("x", x, y)).withColumn("cross_no", F.row_number().over(Window.orderBy(x, y)))


def cross_bins_collapsed(df: DataFrame, x: str, y: str) -> DataFrame:
    """As cross_bins, with the lowest class of x in one label, and the presence rate of each label."""
    label = F.when(F.col(x) == 1, F.lit("1x-")).otherwise(F.concat_ws("x", x, y))
    g = df.withColumn("label", label).groupBy("label").agg(F.avg("presence").alias("rate"), F.count("*").alias("n"))
    return g.withColumn("cross_no", F.dense_rank().over(Window.orderBy("label")))
