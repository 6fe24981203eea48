"""Intermediate tables in the shared folder, and keys of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a temporary folder in local mode, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="driftmap-"))
        base = _own[0]
    return base.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive an executor. The shuffle files that the
    write needed are dropped when it ends, so that a job's disk is that of its largest step.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/driftmap/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def row_key(*names: str) -> Column:
    """A 128-bit key of the named columns, nulls told apart from empty strings."""
    cols = [x for n in names for x in (F.col(n).isNull(), F.col(n))]
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(71), *reversed(cols)).alias("b"))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with its place in the order given, from 0. Ranges are sorted each in its task; only their sizes are summed in one."""
    ranges = settle(df.sort(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    base = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranges.withColumn("_in", inside).join(base, "_range").withColumn(name, F.col("_in") + F.col("_base")).drop("_range", "_in", "_base")


def sums_before(df: DataFrame, value: str, place: str, by: tuple[str, ...] = (), width: int = 10_000) -> DataFrame:
    """df with column before: the sum of value over the rows of equal by that have a smaller place.

    place is a whole number, unique for by. Runs of width places are summed first, so that a
    task holds a run, or one row for each run, and not all rows of a key.
    """
    rows = df.withColumn("_run", F.floor(F.col(place) / width))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = rows.groupBy(*by, "_run").agg(F.sum(value).alias("_sum"))
    runs = runs.select(*by, "_run", F.coalesce(F.sum("_sum").over(ahead(Window.partitionBy(*by).orderBy("_run"))), zero).alias("_base"))
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(ahead(Window.partitionBy(*by, "_run").orderBy(place))), zero))
    return rows.join(runs, [*by, "_run"]).withColumn("before", F.col("_in") + F.col("_base")).drop("_run", "_in", "_base")
