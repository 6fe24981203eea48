"""Queries by name, with the SQL they are held against.

A query applies one operator to the fixture views. Doubles are rounded to six digits on
both sides, after a nudge off ties, so that sums taken in another order compare equal.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.plans.fixtures import NUDGE, Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`") + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, sql: str | None = None, floats: str = "", digits: int = DIGITS) -> Callable:
    """Register a function of Views as a query, and its SQL body over the views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Views(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = oracle(sql, floats, digits)
        return f

    return add


for _m in ("attribution", "climate", "landpop", "mobility", "panel", "binning", "validation", "graph", "grid", "model"):
    importlib.import_module(f"driftmap.plans.{_m}")
