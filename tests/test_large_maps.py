"""Steps that must not meet every pair of regions, and the radiation model by blocks of origins."""

import random

import pytest
from pyspark.sql import functions as F

from driftmap.operators import mobility, radiation
from driftmap.plans import registry

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def world(spark):
    """Regions of which several share a place, with years that some lack, a zero and a null population."""
    rng = random.Random(3)
    regions = [(f"r{k}", float(k % 7), 40.0 + k % 5) for k in range(40)]
    pop = [(g, y, rng.choice([0, 5, rng.randrange(1, 900)])) for g, *_ in regions for y in (2000, 2001, 2002) if rng.random() < 0.8]
    pop += [("r40", 2000, None), ("nowhere", 2000, 50), ("r0", 2009, 7)]
    regions.append(("r40", 3.5, 42.5))
    return spark.createDataFrame(regions, "geo string, longitude double, latitude double").cache(), spark.createDataFrame(pop, "geo string, year int, population long").cache()


def test_flux_by_blocks_is_that_of_the_table_of_pairs(monkeypatch, world):
    monkeypatch.setattr(radiation, "BLOCK", 7)
    monkeypatch.setattr(radiation, "CHUNK", 5)
    regions, pop = world
    dist = mobility.pairwise_distance(regions).withColumn("dist", F.round("dist", 9))
    want = mobility.radiation_flux(dist, pop).cache()
    assert rows(radiation.region_flux(regions, pop)) == rows(want)
    got, sums = radiation.region_flux_totals(regions, pop), mobility.flux_totals(want)
    assert rows(got) == rows(sums.select(got.columns))
    ends = regions.filter("latitude > 41")
    flux = radiation.region_flux(regions, pop, ["flux"], ends)
    assert rows(flux) == rows(mobility.subset_links_by_map(want.select("year", "i", "j", "flux"), ends))
    assert rows(radiation.region_distances(regions)) == rows(mobility.pairwise_distance(regions))


def test_empty_maps_give_no_flux(world):
    regions, pop = world
    assert not radiation.region_flux(regions.limit(0), pop).collect()
    assert not radiation.region_flux_totals(regions, pop.limit(0)).collect()
    assert not radiation.region_flux_totals(regions.limit(1), pop).collect()


def test_duplicate_centroids_are_those_of_all_pairs(spark, world):
    more = spark.createDataFrame([("x", None, 1.0), ("y", 1.0, None), ("p", 1e-170, 0.0), ("q", -1e-170, 0.0)], "geo string, longitude double, latitude double")
    regions = world[0].unionByName(more)
    want = rows(mobility.duplicate_centroid_check(mobility.pairwise_distance(regions)))
    assert rows(mobility.duplicate_centroids(regions)) == want and len(want) > 100


def test_edge_distances_are_those_of_all_pairs(spark, world):
    edges = spark.createDataFrame([("r1", "r2"), ("r9", "r0"), ("r3", "r3"), ("r1", "none")], "src string, dst string")
    want = mobility.pairwise_distance(world[0]).withColumnsRenamed({"i": "src", "j": "dst"}).join(edges, ["src", "dst"])
    assert rows(mobility.edge_distance(world[0], edges)) == rows(want)


@pytest.mark.parametrize("name", ["laplacian_edges", "links_to_laplacian", "laplacian_centroid_weights", "border_neighbours", "duplicate_centroid_check", "pairwise_distance", "flux_totals", "flux_matrix_to_edges"])
def test_no_query_meets_all_pairs_row_by_row(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [x for x in plan.splitlines() if "Join " in x and " = " not in x and " <=> " not in x and "IS NULL" not in x.upper()]
    assert not [x for x in joins if "Cross" not in x], plan


@pytest.mark.parametrize("rooms", [1, 1 << 27])
def test_links_without_a_shuffle_of_pairs(monkeypatch, world, rooms):
    monkeypatch.setattr(radiation, "BLOCK", 7)
    monkeypatch.setattr(radiation, "TILE_BYTES", 3000 * rooms)
    regions, pop = world
    dist = mobility.pairwise_distance(regions).withColumn("dist", F.round("dist", 9))
    want = mobility.flux_matrix_to_edges(mobility.radiation_flux(dist, pop), directed=False).cache()
    assert rows(radiation.region_links(regions, pop)) == rows(want.select("year", "i", "j", "flux"))
    ends = regions.filter("latitude > 41")
    assert rows(radiation.region_links(regions, pop, ends)) == rows(mobility.subset_links_by_map(want.select("year", "i", "j", "flux"), ends))
    shares = [0.2, 0.99, 0.5, 0.0, 1.0]
    assert radiation.link_quantiles(regions, pop, shares) == pytest.approx(mobility.quantiles(want, "flux", shares), rel=1e-12)
    assert not radiation.region_links(regions, pop, regions.limit(0)).collect()
    assert radiation.link_quantiles(regions, pop.limit(0), shares) == [None] * 5


def test_unknown_places_and_years_of_one_region(spark, world):
    regions, pop = world
    lost = spark.createDataFrame([("a", None, 40.0), ("z", 3.0, None), ("r99", None, None)], "geo string, longitude double, latitude double")
    more = spark.createDataFrame([(g, y, 11) for g in ("a", "z", "r99") for y in (2000, 2002)], "geo string, year int, population long")
    regions, pop = regions.unionByName(lost), pop.unionByName(more)
    want = mobility.radiation_flux(mobility.pairwise_distance(regions).withColumn("dist", F.round("dist", 9)), pop).cache()
    assert rows(radiation.region_flux(regions, pop)) == rows(want)
    got = radiation.region_flux_totals(regions, pop)
    assert rows(got) == rows(mobility.flux_totals(want).select(got.columns))
    assert rows(radiation.region_links(regions, pop)) == rows(mobility.flux_matrix_to_edges(want, directed=False).select("year", "i", "j", "flux"))


def test_a_place_is_sorted_once(monkeypatch, world):
    regions, pop = world
    chunks = regions.join(pop.groupBy("geo").agg(F.count("*")), "geo").count()
    places = regions.join(pop, "geo").select("longitude", "latitude").distinct().count()
    table = radiation._with_years(regions, pop)[0].orderBy("geo").toArrow().combine_chunks().to_struct_array()
    whole = radiation._Map([table if not hasattr(table, "combine_chunks") else table.combine_chunks()], [2000, 2001, 2002, 2009])
    assert len(whole.geo) == chunks and len(list(whole.groups(whole.dealt(0, 1, sums=True)))) == places == len(whole.x) < chunks
    dealt = [whole.dealt(b, 5, sums=True) for b in range(5)]
    assert sorted(o for d in dealt for o in d) == list(range(chunks)) and all(len(d) for d in dealt)


@pytest.mark.parametrize("name", ["flux_matrix_to_edges", "subset_links_by_map"])
def test_links_of_a_query_are_not_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(k for k, x in enumerate(plan) if "MapInArrow" in x)
    assert not [x for x in plan[:last] if any(w in x for w in ("Aggregate", "Join", "Sort", "Repartition"))], plan


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_link_strength_by_ranges(monkeypatch, world, most):
    monkeypatch.setattr(radiation, "BLOCK", 7)
    monkeypatch.setattr(radiation, "RANGE", most)
    regions, pop = world
    dist = mobility.pairwise_distance(regions).withColumn("dist", F.round("dist", 9))
    want = mobility.flux_matrix_to_edges(mobility.radiation_flux(dist, pop), directed=False).withColumn("w", F.round("flux", 3)).cache()
    by_pairs = mobility.link_strength_percentile(want, "w").select("year", "i", "j", "flux", "strength")
    assert rows(radiation.region_link_strength(regions, pop, 3)) == rows(by_pairs)
    assert not radiation.region_link_strength(regions, pop.limit(0)).collect()


def test_link_strength_joins_no_links(spark):
    """Only the ranges, told to be broadcast, meet the links: the planner takes links for as small as their map."""
    plan = registry.QUERIES["link_strength_percentile"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (join,) = [x for x in plan if "Join " in x]
    assert "rightHint=(strategy=broadcast)" in join
