"""Queries of region graphs and proximity, over the unit-square lattice of the regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.operators import graph as g
from driftmap.operators import mobility as m
from driftmap.operators import polygons, validation
from driftmap.plans.fixtures import Views
from driftmap.plans.mobility import DISTANCES
from driftmap.plans.registry import query

_QUEEN = "SELECT a.geo AS src, b.geo AS dst FROM fx_region a JOIN fx_region b ON abs(a.grid_row - b.grid_row) <= 1 AND abs(a.grid_col - b.grid_col) <= 1 AND a.geo <> b.geo"
_SQUARE = "array(array(named_struct('lon', CAST(grid_col AS DOUBLE), 'lat', CAST(grid_row AS DOUBLE)), named_struct('lon', grid_col + 1e0, 'lat', CAST(grid_row AS DOUBLE)), named_struct('lon', grid_col + 1e0, 'lat', grid_row + 1e0), named_struct('lon', CAST(grid_col AS DOUBLE), 'lat', grid_row + 1e0)))"
_ISLAND = "fe AS (SELECT e.* FROM fx_edges e JOIN fx_region a ON a.geo = src JOIN fx_region b ON b.geo = dst WHERE a.grid_col <> 3 AND b.grid_col <> 3 AND a.region_id <> 0 AND b.region_id <> 0)"


def squares(v: Views):
    return v.region.withColumn("geometry", F.expr(_SQUARE))


def _cut_edges(v: Views):
    r = v.region.filter("grid_col <> 3 and region_id <> 0").select("geo")
    return v.edges.join(r, F.col("src") == r["geo"], "left_semi").join(r, F.col("dst") == r["geo"], "left_semi")


def _q(v: Views):
    return g.laplacian_edges(v.region, v.edges, 0.9)


def _proximity(v: Views, exponents=(1,)):
    return g.proximity_by_year(_q(v), v.presence, exponents)


query("polygon_neighbours", _QUEEN)(lambda v: g.polygon_neighbours(squares(v)))
query("touching_regions", _QUEEN)(lambda v: polygons.touching_regions(squares(v)))
query("border_neighbours", "SELECT src, dst, 1e0 AS border FROM fx_edges", "border")(lambda v: polygons.border_neighbours(squares(v), snap=0.25))
query("polygon_intersections", f"SELECT src AS geo, count(*) AS n_touching FROM ({_QUEEN}) q GROUP BY 1")(lambda v: polygons.polygon_intersections(squares(v)))
query("neighbour_counts", _ISLAND + "---SELECT r.geo, coalesce(n, 0) AS degree, coalesce(l, []) AS neighbours, n IS NOT NULL AS has_neighbour FROM fx_region r LEFT JOIN (SELECT src, count(*) AS n, list_sort(list(dst)) AS l FROM fe GROUP BY 1) q ON r.geo = q.src")(lambda v: g.neighbour_counts(v.region, _cut_edges(v)))
_COMP = "lb AS (SELECT geo, CASE WHEN region_id = 0 THEN 'a' WHEN grid_col = 3 THEN geo WHEN grid_col < 3 THEN 'w' ELSE 'e' END AS part FROM fx_region), cs AS (SELECT part, count(*) AS size, min(geo) AS g FROM lb GROUP BY 1), cr AS (SELECT part, size, CAST(row_number() OVER (ORDER BY size DESC, g) AS INT) AS component FROM cs)"
query("connected_components", _COMP + "---SELECT geo, component, size FROM lb JOIN cr ON lb.part = cr.part")(lambda v: g.connected_components(v.region, _cut_edges(v)))
query("component_of", "SELECT geo FROM fx_region WHERE grid_col > 3")(lambda v: g.component_of(_cut_edges(v), "G4"))
query("grid_and_chain_graph", "c AS (SELECT s_suppkey AS dst, lag(s_suppkey) OVER (ORDER BY s_suppkey) AS src FROM supplier WHERE s_suppkey NOT IN (5, 9)), d AS (SELECT src, dst FROM c WHERE src IS NOT NULL AND NOT (src = 20 AND dst = 21) UNION SELECT * FROM (VALUES (30, 31), (30, 35), (31, 35)) t)---SELECT src, dst FROM d UNION ALL SELECT dst, src FROM d")(lambda v: g.grid_and_chain_graph(v.sql("SELECT CAST(s_suppkey AS BIGINT) AS node FROM supplier"), [5, 9], [(20, 21)], [30, 31, 35]))
_LAP = "q AS (SELECT src AS i, dst AS j, -1e0 AS value FROM fx_edges UNION ALL SELECT geo, geo, CAST(count(dst) AS DOUBLE) FROM fx_region LEFT JOIN fx_edges ON geo = src GROUP BY geo)"
query("laplacian_edges", _LAP + "---SELECT i, j, value * 0.9e0 + CASE WHEN i = j THEN 0.1e0 ELSE 0e0 END AS value FROM q", "value")(_q)
_CEN = DISTANCES + ", d AS (SELECT src, dst, dist FROM fx_edges JOIN di ON i = src AND j = dst), e AS (SELECT src, dst, dist / (SELECT max(dist) FROM d) AS l FROM d)"
query("laplacian_centroid_weights", _CEN + "---SELECT src AS i, dst AS j, -exp(-l) / (1 - exp(-2 * l)) AS value FROM e UNION ALL SELECT src, src, sum(5e-1 + exp(-2 * l) / (1 - exp(-2 * l))) + CASE WHEN count(*) = 1 THEN 5e-1 ELSE 0e0 END FROM e GROUP BY src", "value")(lambda v: g.laplacian_centroid_weights(v.region, m.edge_distance(v.region, v.edges)))
query("links_to_laplacian", "k AS (SELECT a.geo AS i, b.geo AS j, CAST((a.region_id + b.region_id) % 7 + 1 AS DOUBLE) AS w FROM fx_edges JOIN fx_region a ON a.geo = src JOIN fx_region b ON b.geo = dst WHERE src < dst), b2 AS (SELECT i, j, w FROM k UNION ALL SELECT j, i, w FROM k)---SELECT i, j, -w AS value FROM b2 UNION ALL SELECT i, i, sum(w) FROM b2 GROUP BY i", "value")(lambda v: g.links_to_laplacian(v.sql("SELECT a.geo AS i, b.geo AS j, CAST((a.region_id + b.region_id) % 7 + 1 AS DOUBLE) AS weight FROM fx_edges JOIN fx_region a ON a.geo = src JOIN fx_region b ON b.geo = dst WHERE src < dst")))
query("presence_or_zero", "SELECT geo, year, year_idx, CAST(coalesce(presence, 0) AS INT) AS presence FROM fx_presence")(lambda v: g.presence_or_zero(v.presence))
query("harmonic_fill")(lambda v: g.harmonic_fill(_q(v), g.presence_or_zero(v.presence).select(F.col("year_idx").alias("key"), F.col("geo").alias("node"), "presence"), 1))
query("harmonic_fill_with_noise")(lambda v: g.harmonic_fill(_q(v), g.presence_or_zero(v.presence).select(F.col("year_idx").alias("key"), F.col("geo").alias("node"), "presence"), 1, None))
query("proximity_by_year")(_proximity)
query("surrounded_regions", "SELECT a.geo AS \"inner\", b.geo AS \"outer\" FROM fx_region a JOIN fx_region b ON (a.geo = 'G1' AND b.geo = 'G2') OR (a.geo = 'G7' AND b.geo = 'G8')")(lambda v: g.surrounded_regions(v.region, [("G1", "G2"), ("G7", "G8"), ("G1", "G2")]))
_INH = "px AS (SELECT geo, year_idx, population % 97 / 9.7e1 AS x FROM fx_panel_year), bf AS (SELECT geo, year_idx + 1 AS year_idx, coalesce(presence, 0) AS was FROM fx_presence), pw AS (SELECT px.*, coalesce(was, 0) AS was FROM px LEFT JOIN bf ON px.geo = bf.geo AND px.year_idx = bf.year_idx)"
query("inherit_outer_proximity", _INH + "---SELECT a.geo, a.year_idx, CASE WHEN o.geo IS NOT NULL AND a.was = 0 AND o.was = 0 THEN o.x ELSE a.x END AS x FROM pw a LEFT JOIN pw o ON o.year_idx = a.year_idx AND o.geo = CASE a.geo WHEN 'G1' THEN 'G2' WHEN 'G7' THEN 'G8' END", "x")(lambda v: g.inherit_outer_proximity(v.sql("SELECT geo, year_idx, population % 97 / 9.7e1 AS x FROM fx_panel_year"), v.presence, g.surrounded_regions(v.region, [("G1", "G2"), ("G7", "G8")]), "x"))
query("proximity_from_draws")(lambda v: g.proximity_from_draws(v.draws.select("geo", "year_idx", F.col("p_fact").alias("p")), _q(v), g.surrounded_regions(v.region, [("G1", "G2")])))
query("proximity_map_table", _INH + "---SELECT geo, year_idx, CASE WHEN was <> 1 THEN x END AS x FROM pw WHERE year_idx = 3", "x")(lambda v: g.proximity_map_table(v.sql("SELECT geo, year_idx, population % 97 / 9.7e1 AS x FROM fx_panel_year"), v.presence, "x", 3))


def _plane(v: Views):
    """The lattice in kilometres, 100 for a side: it is longer than there are degrees of latitude."""
    side = lambda p: F.struct((p["lon"] * 100).alias("lon"), (p["lat"] * 100).alias("lat"))
    return squares(v).withColumn("geometry", F.transform("geometry", lambda ring: F.transform(ring, side)))


def _folds(v: Views):
    return v.region.filter("grid_col < 3").select("geo", F.when(F.col("grid_row") < 4, 1).otherwise(2).alias("fold"))


query("buffer_regions", "f AS (SELECT geo, grid_row, grid_col, CAST(CASE WHEN grid_row < 4 THEN 1 ELSE 2 END AS INT) AS fold FROM fx_region WHERE grid_col < 3)---SELECT DISTINCT f.fold, b.geo FROM f JOIN fx_region b ON abs(f.grid_row - b.grid_row) <= 1 AND abs(f.grid_col - b.grid_col) <= 1 WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.geo = b.geo AND x.fold = f.fold)")(lambda v: validation.buffer_regions(_plane(v), _folds(v), 35.0, None))
query("contiguous_folds")(lambda v: validation.contiguous_folds(squares(v).withColumn("longitude", F.col("grid_col").cast("double")).withColumn("latitude", F.col("grid_row").cast("double")), v.edges, v.spark.createDataFrame([(1, "G0"), (2, "G9"), (3, "G55")], "seed int, geo string")))
