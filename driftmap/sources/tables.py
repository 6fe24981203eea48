"""Reading and writing panels, daily and annual tables, and regions.

Files are always read through Spark with a schema or a header, never opened on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names under which tables hold a probability, first choice first (fixed values).
PROBABILITY_COLUMNS = ("p", "p_pred", "prob", "p_mean")


def wide_to_long_daily(wide: DataFrame, days: Sequence[str], key: str = "Location", pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Day columns to rows: location, date, value."""
    long = wide.unpivot([key], list(days), "day", "value")
    return long.select(F.col(key).alias("location"), F.to_date(F.regexp_replace("day", r"^X|\.", ""), pattern.replace("-", "")).alias("date") if days and days[0].startswith("X") else F.to_date("day", pattern).alias("date"), F.expr("try_cast(value as double)").alias("value"))


#: One field of a line of CSV, with the comma before it.
_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)'


def _fields(line: Column) -> Column:
    bare = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), bare)


def read_daily_csv(spark: SparkSession, path: str | Sequence[str], key: str = "Location") -> DataFrame:
    """location, date, value, file_year of wide daily files <variable>_mean_<year>.csv, any number in one read.

    Each value takes the date that the header of its own file gives to its place, so files may
    differ in days, leap years and the order of columns. A header is a line with a field that
    is the key's name; where a file has none, an error is raised. Columns whose names are no
    dates (an index X) give no rows, an empty or unreadable value is null. Fields may be
    quoted, but not hold line breaks; blank lines are skipped.
    """
    text = spark.read.text(path).filter("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), _fields(F.regexp_replace("value", "^\ufeff|\r$", "")).alias("fields"))
    is_header = F.array_contains("fields", key)
    heads = text.filter(is_header).groupBy("file").agg(F.first("fields").alias("names"))
    rows = text.filter(~is_header).join(heads, "file", "left")
    names = F.coalesce("names", F.raise_error(F.concat(F.lit("no header in "), F.col("file"))))
    cells = rows.withColumn("names", names).select(F.element_at("fields", F.array_position("names", F.lit(key)).cast("int")).alias("location"), "file", F.explode(F.arrays_zip("names", "fields")).alias("cell"))
    year = F.regexp_extract("file", r"(\d{4})(?=[^/]*\.csv)", 1).cast("int")
    long = cells.select("location", F.regexp_extract(F.translate("cell.names", ".", "-"), r"^X?(\d{4}-\d{2}-\d{2})$", 1).alias("day"), F.col("cell.fields").alias("value"), year.alias("file_year"))
    return long.filter("day <> ''").select("location", F.to_date("day").alias("date"), F.expr("try_cast(value as double)").alias("value"), "file_year")


def read_daily_csv_headerless(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Files whose header stands in their first row: that row goes, the given names hold, values become doubles."""
    raw = spark.read.csv(path, header=False).toDF(*columns)
    return raw.filter(F.col(columns[0]) != columns[0]).select(columns[0], *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in columns[1:]))


def read_annual_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Yearly tables by file; columns: name in the file to name here. All but the first become doubles."""
    raw = spark.read.csv(path, header=True)
    first, *rest = columns
    year = F.regexp_extract(F.input_file_name(), r"(\d{4})(?=[^/]*\.csv)", 1).cast("int")
    return raw.select(F.col(f"`{first}`").alias(columns[first]), *(F.expr(f"try_cast(`{c}` as double)").alias(columns[c]) for c in rest), year.alias("year"))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find_input_by_pattern(files: DataFrame, patterns: Sequence[str], by: Sequence[str] = ("folder",)) -> DataFrame:
    """The first file of each folder by the first pattern that fits any. files: folder, path."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col("path").rlike(p), F.lit(i)).otherwise(rank)
    w = Window.partitionBy(*by).orderBy("rank", "path")
    return files.withColumn("rank", rank).filter("rank is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_scenario_models(spark: SparkSession, path: str, scenarios: Sequence[str] | None = None) -> DataFrame:
    """All scenarios and models of a table laid out as scenario=/model=, in one read; filters prune folders."""
    df = spark.read.parquet(path)
    return df if scenarios is None else df.filter(F.col("scenario").isin(*scenarios))


def select_prediction_table(candidates: dict[str, DataFrame]) -> str | None:
    """The name of the table whose schema fits draws best: region, draw, year and a probability. Only schemas are looked at."""

    def score(df: DataFrame) -> int:
        c = set(df.columns)
        needed = ("geo" in c) + ("draw" in c) + bool(c & {"year", "year_idx"}) + bool(c & set(PROBABILITY_COLUMNS))
        return 10 * (needed == 4) + needed

    ranked = sorted(candidates, key=lambda n: (-score(candidates[n]), n))
    return ranked[0] if ranked and score(candidates[ranked[0]]) >= 10 else None


def pick_prob_column(df: DataFrame) -> DataFrame:
    """The first probability column there is, as p."""
    for c in PROBABILITY_COLUMNS:
        if c in df.columns:
            return df.withColumnRenamed(c, "p")
    raise ValueError("no probability column")


def read_region_map(current: DataFrame, older: DataFrame) -> DataFrame:
    """The current map and the regions that only the older one has."""
    return current.unionByName(older.join(current, "geo", "left_anti"), allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str, by: Sequence[str] = ("scenario", "model")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_rounded(df: DataFrame, path: str, digits: int) -> None:
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes]
    write_csv(df.select(*cols), path)
