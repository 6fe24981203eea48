"""Cut the lineage of iterative jobs with files that outlive an executor, number rows and sum along them without one task for all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set, one temporary folder in local mode, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="driftmap-"))
        base = _own[0]
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back, which survives a lost executor; see drop."""
    path = f"{shared_folder(df.sparkSession)}/driftmap/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more: iterative jobs keep their last state only."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """df with each row's place in the order of some columns, from 1: ranges are sorted each in its task, only their sizes in one."""
    ranges = cut(df.sort(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_in", inside).join(ahead, "_range").withColumn(name, F.col("_in") + F.col("_ahead")).drop("_range", "_in", "_ahead")


def running(df: DataFrame, by: Sequence[str], order: Column, **sums: str) -> DataFrame:
    """df with running sums of columns within by, in an order that no two rows of by share: new name = summed column.

    Rows are sorted into ranges of (by, order) first. A group of any size lies in as many
    ranges as it fills; a task holds a range, or one row for each range of a group.
    """
    ranges = cut(df.withColumn("_order", order).sort(*by, "_order").withColumn("_range", F.spark_partition_id()))
    key = [F.struct(*by).alias("_by")] if by else [F.lit(0).alias("_by")]
    parts = ranges.groupBy(*key, "_range").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    ahead = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("_by").alias("_of"), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_by", "_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.withColumns({"_by": key[0]}).withColumns({k: F.sum(c).over(inside) for k, c in sums.items()})
    joined = rows.join(base, (F.col("_range") == F.col("_at")) & F.col("_by").eqNullSafe(F.col("_of")))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))
