"""Radiation-model mobility between regions and networks of links.

The model needs every ordered pair of regions of a year: its size follows the region map,
which is fixed, not the observations. Pairs are partitioned by year and origin.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.operators.lineage import cut, running

EARTH_KM = 6371.0088
#: Equatorial radius and flattening (fixed values).
WGS84_KM = 6378.137
WGS84_FLATTENING = 1 / 298.257223563


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """On the sphere of the mean radius."""
    return EARTH_KM * _angle(F.radians(lon1), F.radians(lat1), F.radians(lon2), F.radians(lat2))


def _angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    half = lambda d: F.pow(F.sin(d / 2), F.lit(2.0))
    a = half(y2 - y1) + F.cos(y1) * F.cos(y2) * half(x2 - x1)
    return 2 * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would leave out an unknown longitude


def geodesic_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """On the WGS84 ellipsoid by Lambert's formula for long lines, within about ten metres over thousands of kilometres."""
    reduced = lambda lat: F.atan((1 - WGS84_FLATTENING) * F.tan(F.radians(lat)))
    b1, b2 = reduced(lat1), reduced(lat2)
    s = _angle(F.radians(lon1), b1, F.radians(lon2), b2)
    square = lambda c: F.pow(c, F.lit(2.0))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * square(F.sin(p) * F.cos(q)) / square(F.cos(s / 2))
    y = (s + F.sin(s)) * square(F.cos(p) * F.sin(q)) / square(F.sin(s / 2))
    return F.when(s == 0, 0.0).otherwise(WGS84_KM * (s - WGS84_FLATTENING / 2 * (x + y)))


def pairwise_distance(regions: DataFrame) -> DataFrame:
    """i, j, dist of all ordered pairs of regions, in kilometres on the ellipsoid."""
    a = regions.select(F.col("geo").alias("i"), F.col("longitude").alias("x1"), F.col("latitude").alias("y1"))
    b = regions.select(F.col("geo").alias("j"), F.col("longitude").alias("x2"), F.col("latitude").alias("y2"))
    return a.join(b, F.col("i") != F.col("j")).select("i", "j", geodesic_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("dist"))


def duplicate_centroid_check(distance: DataFrame) -> DataFrame:
    """Pairs at distance 0 or of unknown distance; there must be none."""
    return distance.filter("dist = 0 or dist is null")


def edge_distance(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, dist of edges between two different regions, as pairwise_distance has them, without the other pairs."""
    a = regions.select(F.col("geo").alias("src"), F.col("longitude").alias("x1"), F.col("latitude").alias("y1"))
    b = regions.select(F.col("geo").alias("dst"), F.col("longitude").alias("x2"), F.col("latitude").alias("y2"))
    return edges.filter("src <> dst").select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", geodesic_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("dist"))


def duplicate_centroids(regions: DataFrame) -> DataFrame:
    """duplicate_centroid_check of pairwise_distance, by a join on the place: only regions at one place, or at none that is known, make pairs."""
    x, y = F.radians("longitude"), F.atan((1 - WGS84_FLATTENING) * F.tan(F.radians("latitude")))
    spots = regions.select("geo", "longitude", "latitude", F.round(x, 9).alias("px"), F.round(y, 9).alias("py"))
    end = lambda name, k: spots.select(F.col("geo").alias(name), F.col("longitude").alias(f"x{k}"), F.col("latitude").alias(f"y{k}"), "px", "py")
    a, b = end("i", 1), end("j", 2)
    of = lambda pairs: pairs.filter("i <> j").select("i", "j", geodesic_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("dist"))
    unknown = lambda df, k: df.filter(f"x{k} is null or y{k} is null").drop("px", "py")
    known = lambda df, k: df.filter(f"x{k} is not null and y{k} is not null").drop("px", "py")
    lost = of(unknown(a, 1).crossJoin(b.drop("px", "py"))).unionByName(of(known(a, 1).crossJoin(unknown(b, 2))))
    return of(a.join(b, ["px", "py"])).filter("dist = 0").unionByName(lost)


def radiation_flux(distance: DataFrame, population: DataFrame) -> DataFrame:
    """Flux of each year and ordered pair: 0.9 m p, p = m n / ((m + s)(m + n + s)), s the population nearer to i than j is.

    Ties in distance are in order of j. prob_rescaled divides by 1 - m / total. 0 where a
    factor of the denominator is 0.
    """
    pop = population.select("geo", "year", F.col("population").cast("double").alias("p"))
    total = pop.groupBy("year").agg(F.sum("p").alias("total"))
    j = distance.join(pop.select(F.col("geo").alias("j"), "year", F.col("p").alias("n")), "j")
    j = j.join(pop.select(F.col("geo").alias("i"), "year", F.col("p").alias("m")), ["i", "year"]).join(total, "year")
    w = Window.partitionBy("year", "i").orderBy("dist", "j").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("s", F.coalesce(F.sum("n").over(w), F.lit(0.0)))
    m, n, s = F.col("m"), F.col("n"), F.col("s")
    prob = F.when(((m + s) == 0) | ((m + n + s) == 0), 0.0).otherwise(m * n / ((m + s) * (m + n + s)))
    j = j.withColumn("prob", prob)
    return j.select("year", "i", "j", "dist", "prob", F.when(F.col("prob") == 0, 0.0).otherwise(F.col("prob") / (1 - m / F.col("total"))).alias("prob_rescaled"), (0.9 * m * F.col("prob")).alias("flux"))


def flux_totals(flux: DataFrame) -> DataFrame:
    """Outgoing, incoming and net flux of each region and year."""
    none = F.lit(None).cast("double")
    ends = F.array(F.struct(F.col("i").alias("geo"), F.col("flux").alias("out"), none.alias("into")), F.struct(F.col("j").alias("geo"), none.alias("out"), F.col("flux").alias("into")))
    sums = flux.select("year", F.explode(ends).alias("e")).groupBy("year", "e.geo").agg(F.sum("e.out").alias("total_flux_out"), F.sum("e.into").alias("total_flux_in"))
    return sums.withColumn("net_flux_out", F.col("total_flux_out") - F.col("total_flux_in"))


def mobility_by_year(regions: DataFrame, population: DataFrame) -> DataFrame:
    return flux_totals(radiation_flux(pairwise_distance(regions), population))


def flux_matrix_to_edges(flux: DataFrame, directed: bool = True) -> DataFrame:
    """All off-diagonal links, or one for each pair with the larger flux of both ways."""
    if directed:
        return flux.select("year", "i", "j", "flux")
    return flux.groupBy("year", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("flux").alias("flux"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of a column, exactly, without its values in one task.

    One approximate pass finds a narrow band around each; the values of all bands are counted
    by value together, and only those at the ranks asked for come to the driver.
    """
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    order = sorted(range(len(shares)), key=lambda i: shares[i])
    if order != list(range(len(shares))):
        by_share = quantiles(df, column, [shares[i] for i in order])
        return [by_share[order.index(i)] for i in range(len(shares))]
    n = x.count()
    if not n:
        return [None] * len(shares)
    pad = 0.01 + 2 / n  # more than the pass may be off, and two ranks
    found = x.approxQuantile("x", [b for q in shares for b in (max(0.0, q - pad), min(1.0, q + pad))], 0.002)
    lows, highs = (F.array(*map(F.lit, ends)) for ends in (found[::2], found[1::2]))
    k = len(shares)
    # lows grow with the shares, so those above a value are the last ones
    above = {r["c"]: r["m"] for r in x.groupBy(F.size(F.filter(lows, lambda low: F.col("x") < low)).alias("c")).agg(F.count("*").alias("m")).collect()}
    below = [sum(m for c, m in above.items() if c >= k - i) for i in range(k)]
    of = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("x") >= F.get(lows, i)) & (F.col("x") <= F.get(highs, i)))
    counts = x.select("x", F.explode(of).alias("band")).groupBy("band", "x").agg(F.count("*").alias("m"))
    ranks = [((n - 1) * q, int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1)) for q in shares]
    of_band = lambda values: F.get(F.array(*map(F.lit, values)), F.col("band"))
    ranked = running(counts, ["band"], F.col("x"), upto="m").withColumn("last", F.col("upto") + of_band(below) - 1).withColumn("first", F.col("last") - F.col("m") + 1)
    wanted = (F.col("first") <= of_band([hi for *_, hi in ranks])) & (F.col("last") >= of_band([lo for _, lo, _ in ranks]))
    rows = ranked.filter(wanted).select("band", "x", "first", "last").collect()
    out = []
    for k, (at, lo, hi) in enumerate(ranks):
        value = {r: next(row.x for row in rows if row.band == k and row.first <= r <= row.last) for r in (lo, hi)}
        out.append(value[lo] + (at - lo) * (value[hi] - value[lo]))
    return out


def filter_links_quantile(links: DataFrame, weight: str, q: float, strict: bool = True, limit: float | None = None) -> DataFrame:
    """Links whose weight is above the quantile (or at least it). limit: the quantile, if it is known; else the links are written once, as it and the result both read them."""
    if limit is None:
        links = cut(links)
        limit = quantiles(links, weight, [q])[0]
    return links.filter(F.col(weight) > F.lit(limit) if strict else F.col(weight) >= F.lit(limit))


def link_strength_percentile(links: DataFrame, weight: str, by: Sequence[str] = ("year",)) -> DataFrame:
    """links with strength: the share of the group's links whose weight isn't larger, signs left out. Nulls come first, as Spark sorts them, and are counted. The links are written once: they are read twice, and what is not written may be far larger than a join takes it for."""
    sized = cut(links.withColumn("_size", F.abs(weight)))
    counts = sized.groupBy(*by, "_size").agg(F.count("*").alias("_m"))
    upto = running(counts, by, F.col("_size"), _upto="_m")
    whole = counts.groupBy(*by).agg(F.sum("_m").alias("_n"))
    same = lambda a, b, names: functools.reduce(operator.and_, (a[c].eqNullSafe(b[c]) for c in names))
    share = upto.join(whole, same(upto, whole, by)).select(*(upto[c] for c in by), "_size", (F.col("_upto") / F.col("_n")).alias("strength"))
    return sized.join(share, same(sized, share, [*by, "_size"])).select(*(sized[c] for c in links.columns), "strength")


def link_strength_class(links: DataFrame, weight: str, classes: int = 5, limits: Sequence[float | None] | None = None) -> DataFrame:
    """Quantile classes 1 to classes; the lowest weight belongs to the first. limits: the quantiles, if they are known; else the links are written once, as they and the result both read them."""
    number = F.lit(1)
    if limits is None:
        links = cut(links)
        limits = quantiles(links, weight, [k / classes for k in range(1, classes)])
    for limit in limits:
        number = number + (F.col(weight) > F.lit(limit)).cast("int")
    return links.withColumn("class", number)


def net_flux_nodes(totals: DataFrame) -> DataFrame:
    return totals.select("year", "geo", F.abs("net_flux_out").alias("weight"))


def subset_links_by_map(links: DataFrame, regions: DataFrame) -> DataFrame:
    g = regions.select("geo").distinct()
    return links.join(g, F.col("i") == F.col("geo"), "left_semi").join(g, F.col("j") == F.col("geo"), "left_semi")


def top_k_regions(totals: DataFrame, year: int, k: int = 10) -> DataFrame:
    return totals.filter(F.col("year") == year).orderBy(F.desc("total_flux_in"), "geo").limit(k).select("geo", "total_flux_in")


def pivot_years_wide(totals: DataFrame, selected: DataFrame, years: Sequence[int]) -> DataFrame:
    wide = totals.join(selected.select("geo"), "geo", "left_semi").groupBy("geo").pivot("year", list(years)).agg(F.first("total_flux_in"))
    return wide.select("geo", *(F.col(str(y)).alias(f"y{y}") for y in years))


def unpivot_years_long(wide: DataFrame, drop: Sequence[str], scale: float, first: int, last: int) -> DataFrame:
    long = wide.filter(~F.col("geo").isin(*drop)).unpivot(["geo"], [c for c in wide.columns if c != "geo"], "name", "value")
    return long.select("geo", F.regexp_replace("name", "^y", "").cast("int").alias("year"), (F.col("value") / scale).alias("value")).filter(F.col("year").between(first, last))


def fit_scale(df: DataFrame, column: str) -> DataFrame:
    """The fitted maximum, null unless finite and positive, as a table of one row."""
    return df.agg(F.max(column).alias("top")).select(F.lit(column).alias("column"), F.when((F.col("top") > 0) & (F.col("top") < float("inf")), F.col("top")).alias("top"))


def scale_by_max(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """Divide by a fitted maximum, that of the training years also for later ones; without one the column stays."""
    return df.crossJoin(F.broadcast(fitted.select("top"))).withColumn(column, F.coalesce(F.col(column) / F.col("top"), F.col(column))).drop("top")
