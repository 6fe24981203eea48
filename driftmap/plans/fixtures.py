"""The panel's tables as views over the driver's Parquet tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Numbers with an exponent are doubles in both engines.
VIEWS = {
    "fx_region": """
SELECT concat('G', CAST(s_suppkey AS STRING)) AS geo, CAST(s_suppkey AS INT) AS region_id, s_name AS location_na,
       CAST(s_nationkey AS INT) AS country_id, -1e1 + CAST(s_suppkey * 37 % 410 AS DOUBLE) / 1e1 AS longitude,
       3.5e1 + CAST(s_suppkey * 53 % 400 AS DOUBLE) / 1e1 AS latitude, 1e8 * (1 + s_suppkey % 17) AS area_m2,
       CAST(s_suppkey % 10 AS INT) AS grid_col, CAST(floor(s_suppkey / 10) AS INT) AS grid_row
FROM supplier""",
    "fx_daily": """
SELECT concat('G', CAST(l_suppkey AS STRING)) AS geo, CAST(l_shipdate AS DATE) AS date,
       CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month,
       avg(l_quantity) - 2e1 AS temperature, avg(l_extendedprice) / 1e4 AS precipitation,
       1e2 * (5e-2 + avg(l_discount) * 9e0) AS relative_humidity
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "fx_model_year": """
SELECT concat('G', CAST(l_suppkey AS STRING)) AS geo, CAST(l_linenumber % 5 AS INT) AS model,
       CAST(year(l_shipdate) AS INT) AS year, avg(l_quantity) - 1.9e1 AS temperature,
       avg(l_extendedprice) / 9e3 AS precipitation, 1e2 * (3e-2 + avg(l_discount) * 9e0) AS relative_humidity
FROM lineitem GROUP BY 1, 2, 3""",
    "fx_panel_year": """
SELECT concat('G', CAST(l_suppkey AS STRING)) AS geo, CAST(year(l_shipdate) AS INT) AS year,
       CAST(year(l_shipdate) - 1994 AS INT) AS year_idx, count(*) AS n_rows,
       CAST(sum(CAST(l_quantity AS BIGINT)) * 1000 AS BIGINT) AS population,
       CASE WHEN year(l_shipdate) <= 1998 THEN 'historical' ELSE 'SSP370' END AS scenario,
       avg(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END) AS primary_forested_area,
       avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS pasture_land,
       avg(CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END) AS urban_land
FROM lineitem GROUP BY 1, 2, 3, 6""",
    "fx_presence": """
SELECT geo, year, year_idx, CASE WHEN population % 11 = 0 THEN NULL WHEN population % 7 < 3 THEN 1 ELSE 0 END AS presence
FROM fx_panel_year""",
    "fx_draws": """
SELECT p.geo, r.region_id, p.year, p.year_idx, CAST(d.draw AS INT) AS draw,
       CAST((r.region_id * 7919 + p.year * 104729 + d.draw * 1299709) % 100003 AS DOUBLE) / 1.00003e5 AS p_fact,
       CAST((r.region_id * 7907 + p.year * 104723 + d.draw * 1299721) % 80021 AS DOUBLE) / 1.00003e5 AS p_cf
FROM fx_panel_year p JOIN fx_region r ON p.geo = r.geo CROSS JOIN (SELECT id AS draw FROM range(1, 21)) d""",
    "fx_climate_year": """
SELECT geo, year, CAST(year - 1994 AS INT) AS year_idx, avg(temperature) AS temperature, avg(precipitation) AS precipitation,
       avg(relative_humidity) AS relative_humidity
FROM fx_daily GROUP BY geo, year""",
    "fx_panel": """
SELECT p.geo, p.year, p.year_idx, c.temperature, c.precipitation, c.relative_humidity, CAST(p.population AS DOUBLE) AS population,
       p.primary_forested_area, p.pasture_land, p.urban_land, r.presence
FROM fx_panel_year p JOIN fx_climate_year c ON p.geo = c.geo AND p.year = c.year JOIN fx_presence r ON p.geo = r.geo AND p.year = r.year""",
    "fx_edges": """
SELECT a.geo AS src, b.geo AS dst FROM fx_region a JOIN fx_region b
ON (a.grid_row = b.grid_row AND (a.grid_col = b.grid_col + 1 OR b.grid_col = a.grid_col + 1))
OR (a.grid_col = b.grid_col AND (a.grid_row = b.grid_row + 1 OR b.grid_row = a.grid_row + 1))""",
}

#: In Spark in place of the same view above, whose alternatives it would join row by row: each side of a square is a join by place.
BY_PLACE = {
    "fx_edges": """
SELECT a.geo AS src, b.geo AS dst FROM (
    SELECT geo, inline(array(struct(grid_row AS r, grid_col - 1 AS c), struct(grid_row AS r, grid_col + 1 AS c),
                             struct(grid_row - 1 AS r, grid_col AS c), struct(grid_row + 1 AS r, grid_col AS c))) FROM fx_region
) a JOIN fx_region b ON a.r = b.grid_row AND a.c = b.grid_col""",
}

#: Added before rounding.
NUDGE = 1.7e-9


class Views:
    """The views over one folder of tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for t in ("lineitem", "supplier"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        for name, text in (VIEWS | BY_PLACE).items():
            spark.sql(text).createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.table(f"fx_{name}")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)


def oracle(body: str, floats: str = "", digits: int = 6) -> str:
    """DuckDB SQL: the views, then body (which may begin with more of them, after a comma); floats are rounded."""
    views = ", ".join(f"{n} AS ({t.replace('STRING', 'VARCHAR').replace('SELECT id AS draw', 'SELECT range AS draw')})" for n, t in VIEWS.items())
    more, _, last = body.strip().rpartition("---") if "---" in body else ("", "", body)
    more = f", {more.strip().strip(',')}" if more.strip() else ""
    shown = "*"
    if floats:
        shown = "* REPLACE (" + ", ".join(f"round({c} + {NUDGE}, {digits}) + 0e0 AS {c}" for c in floats.split()) + ")"
    return f"WITH {'RECURSIVE ' if '/*recursive*/' in more else ''}{views}{more}\nSELECT {shown} FROM ({last}) AS result"
