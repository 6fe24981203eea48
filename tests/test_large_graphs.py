"""The lattice of regions beyond a few hundred rows."""

import pytest
from pyspark.sql import functions as F

from driftmap.operators import graph, validation
from driftmap.plans import fixtures

FOLDER = "/root/testdata/sf0.001"


def test_buffers_on_a_plane_and_beyond_the_pole(spark):
    box = lambda k: [[(0.0, 100.0 * k), (100.0, 100.0 * k), (100.0, 100.0 * k + 100), (0.0, 100.0 * k + 100)]]
    kind = "geo string, geometry array<array<struct<lon: double, lat: double>>>"
    df = spark.createDataFrame([(f"b{k}", box(k)) for k in (0, 1, 2, 359, 360, 361)], kind)
    folds = spark.createDataFrame([("b360", 1), ("b0", 2)], "geo string, fold int")
    assert sorted((r.fold, r.geo) for r in validation.buffer_regions(df, folds, 35.0, None).collect()) == [(1, "b359"), (1, "b361"), (2, "b1")]
    with pytest.raises(Exception, match="beyond a pole"):
        validation.buffer_regions(df, folds, 35.0).collect()


def test_edges_by_place_are_those_of_the_view(spark):
    fixtures.Views(spark, FOLDER)
    assert sorted(spark.table("fx_edges").collect()) == sorted(spark.sql(fixtures.VIEWS["fx_edges"]).collect())


def test_a_fill_reads_its_matrix_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(v):
        calls.add(1)
        return v

    count = F.udf(counted, "double").asNondeterministic()
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(5)], "geo string")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(5) for b in range(5) if abs(a - b) == 1], "src string, dst string")
    q = graph.laplacian_edges(nodes, edges, 0.9).withColumn("value", count("value"))
    known = spark.createDataFrame([(1, f"n{k}", int(k == 0)) for k in range(5)], "key int, node string, presence int")
    graph.harmonic_fill(q, known).collect()
    assert calls.value == 13
