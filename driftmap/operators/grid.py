"""Gridded data to regions, and points in regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.operators.polygons import segments

EARTH_KM = 6371.0088

#: Cells that a tile of the zonal join is wide and high.
TILE = 4

#: Of a column p of points: the bounding box.
_BOX = [f"{f}(transform(p, q -> q.{k})) as {name}" for f, k, name in (("array_min", "lon", "w"), ("array_max", "lon", "e"), ("array_min", "lat", "s"), ("array_max", "lat", "n"))]


def decode_time_axis(df: DataFrame, units: str = "units", time: str = "time") -> DataFrame:
    """date from "days since <date>" and whole or fractional days."""
    origin = F.to_date(F.regexp_extract(units, r"days since (\d{4}-\d{1,2}-\d{1,2})", 1), "y-M-d")
    return df.withColumn("date", F.date_add(origin, F.floor(time).cast("int")))


def mask_fill_value(df: DataFrame, column: str, fill: str = "fill_value", missing: str = "missing_value") -> DataFrame:
    """Null where the value is the fill value, or else the missing value."""
    mark = F.coalesce(F.col(fill), F.col(missing))
    return df.withColumn(column, F.when(mark.isNull() | (F.col(column) != mark), F.col(column)))


def bounding_box(regions: DataFrame) -> DataFrame:
    p = regions.select(F.explode(F.flatten("geometry")).alias("p"))
    return p.agg(F.min("p.lon").alias("west"), F.max("p.lon").alias("east"), F.min("p.lat").alias("south"), F.max("p.lat").alias("north"))


def crop_to_extent(cells: DataFrame, regions: DataFrame) -> DataFrame:
    box = F.broadcast(bounding_box(regions))
    return cells.crossJoin(box).filter("lon between west and east and lat between south and north").drop("west", "east", "south", "north")


def block_mean(cells: DataFrame, factor: int = 2, by: Sequence[str] = ("date",)) -> DataFrame:
    """Mean of blocks of factor by factor cells, nulls left out."""
    return cells.groupBy(F.floor(F.col("cell_row") / factor).cast("int").alias("cell_row"), F.floor(F.col("cell_col") / factor).cast("int").alias("cell_col"), *by).agg(F.avg("value").alias("value"))


def cell_area(lat: Column, size: float) -> Column:
    """Square kilometres of a cell of the sphere that is size degrees wide and high."""
    half = size / 2
    return F.lit(EARTH_KM**2) * F.radians(F.lit(size)) * (F.sin(F.radians(lat + half)) - F.sin(F.radians(lat - half)))


def _under(x: tuple[Column, Column], y: tuple[Column, Column], south: Column, north: Column) -> Column:
    """The area under a segment from x[0] to x[1], between two latitudes; negative where it runs west."""
    high = north - south
    up = lambda v: F.greatest(F.lit(0.0), F.least(v - south, high))
    # the antiderivative of up: its difference over the rise is the mean height of what is under the segment
    whole = lambda v: up(v) * up(v) / 2 + high * F.greatest(F.lit(0.0), v - north)
    rise = y[1] - y[0]
    flat = F.abs(rise) < 1e-6 * high
    return (x[1] - x[0]) * F.when(flat, up((y[0] + y[1]) / 2)).otherwise((whole(y[1]) - whole(y[0])) / F.when(~flat, rise))


def cell_region_coverage(cells: DataFrame, regions: DataFrame, size: float) -> DataFrame:
    """cell_row, cell_col, lat, geo, frac: the share of each cell that lies in each region, of those above 1e-12.

    A region is the even-odd fill of its rings: an outline, holes, islands. Its area in a cell
    is a sum over its segments, each with what is under it in the cell; segments meet the
    cells of their columns, from the region's foot to their own height, in a join of tiles.
    """
    segs = segments(regions).withColumn("sign", F.when(F.col("left"), -1).otherwise(1))
    foot = segs.groupBy("geo").agg(F.min(F.least("y1", "y2")).alias("foot"))
    edges = segs.filter("x1 <> x2").join(foot, "geo").select("geo", "x1", "y1", "x2", "y2", "sign", "foot")
    half = size / 2
    tiles = lambda low, high: F.explode(F.sequence(F.floor(low - half), F.floor(high + half)))
    edges = edges.withColumn("tx", tiles(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("ty", tiles(F.col("foot"), F.greatest("y1", "y2")))
    one = cells.select("cell_row", "cell_col", "lon", "lat").distinct().withColumn("tx", F.floor("lon")).withColumn("ty", F.floor("lat"))
    west, east, south, north = F.col("lon") - half, F.col("lon") + half, F.col("lat") - half, F.col("lat") + half
    near = one.join(edges, ["tx", "ty"]).filter((F.least("x1", "x2") < east) & (F.greatest("x1", "x2") > west) & (F.greatest("y1", "y2") > south) & (F.col("foot") < north))
    cut = lambda c: F.greatest(west, F.least(east, F.col(c)))
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    at = lambda c: F.col("y1") + (cut(c) - F.col("x1")) * slope
    part = F.col("sign") * _under((cut("x1"), cut("x2")), (at("x1"), at("x2")), south, north)
    areas = near.groupBy("cell_row", "cell_col", "lat", "geo").agg((F.sum(part) / F.lit(size * size)).alias("frac"))
    return areas.filter("frac > 1e-12").select("cell_row", "cell_col", "lat", "geo", "frac")


def _by_region(cells: DataFrame, weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """geo, by, value, _w of each cell in each region; weights: cell_row, cell_col, geo, _w.

    Both meet by square tiles of cells, so that a region's cells of one day lie in few tasks and
    are summed there before they are dealt out. A tile's weights are one row of a hash table, a
    list for each of its cells; the cells, which are many more, are neither sorted nor gathered.
    """
    tile = lambda df: df.withColumns({"_tr": F.floor(F.col("cell_row") / TILE), "_tc": F.floor(F.col("cell_col") / TILE), "_at": (F.pmod("cell_row", F.lit(TILE)) * TILE + F.pmod("cell_col", F.lit(TILE))).cast("int")})
    own = tile(weights).groupBy("_tr", "_tc").agg(F.collect_list(F.struct("_at", "geo", "_w")).alias("all"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda k: F.filter("all", lambda x: x["_at"] == k))
    j = tile(cells.select("cell_row", "cell_col", *by, "value")).join(own.select("_tr", "_tc", slots.alias("slots")).hint("shuffle_hash"), ["_tr", "_tc"])
    return j.select(*by, "value", F.explode(F.col("slots")[F.col("_at")]).alias("x")).select("x.geo", *by, "value", "x._w")


def zonal_weighted_mean(cells: DataFrame, coverage: DataFrame, size: float, by: Sequence[str] = ("date",)) -> DataFrame:
    """Mean of cell values by covered area for each region and day; null values don't weigh."""
    w = coverage.select("cell_row", "cell_col", "geo", (F.col("frac") * cell_area(F.col("lat"), size)).alias("_w"))
    return _by_region(cells.filter("value is not null"), w, by).groupBy("geo", *by).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))


def zonal_sum(cells: DataFrame, coverage: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Sum of cell values by covered share: head counts."""
    w = coverage.select("cell_row", "cell_col", "geo", F.col("frac").alias("_w"))
    return _by_region(cells, w, by).groupBy("geo", *by).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))


def split_by_year(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """Rows of the years asked for, with the year to partition the output by."""
    return df.withColumn("year", F.year("date")).filter(F.col("year").isin(*years))


def pivot_region_by_day(df: DataFrame, days: Sequence[str]) -> DataFrame:
    return df.groupBy("geo").pivot("date", list(days)).agg(F.first("value"))


def points_on_grid(regions: DataFrame, nx: int, ny: int) -> DataFrame:
    """Even grid of nx by ny points over the regions' bounding box."""
    x = F.col("west") + F.col("i") * (F.col("east") - F.col("west")) / (nx - 1)
    y = F.col("south") + F.col("j") * (F.col("north") - F.col("south")) / (ny - 1)
    g = bounding_box(regions).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    return g.select((F.col("j") * nx + F.col("i") + 1).alias("point_id"), x.alias("lon"), y.alias("lat"))


def _inside(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all edges of all rings; west and south edges belong to the region."""

    def crossings(ring: Column) -> Column:
        nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        edges = F.arrays_zip(ring.alias("a"), nxt.alias("b"))

        def one(n: Column, e: Column) -> Column:
            a, b = e["a"], e["b"]
            spans = (a["lat"] > y) != (b["lat"] > y)
            at = a["lon"] + (y - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
            return n + F.when(spans & (x < at), 1).otherwise(0)

        return F.aggregate(edges, F.lit(0), one)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda n, c: n + c) % 2 == 1


def point_in_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """point_id, lon, lat, geo of every region that a point lies in; candidates come from whole-degree tiles of bounding boxes."""
    box = regions.select("geo", "geometry", F.flatten("geometry").alias("p")).selectExpr("geo", "geometry", *_BOX)
    b = box.withColumn("tx", F.explode(F.sequence(F.floor("w"), F.floor("e")))).withColumn("ty", F.explode(F.sequence(F.floor("s"), F.floor("n"))))
    j = points.withColumn("tx", F.floor("lon")).withColumn("ty", F.floor("lat")).join(b, ["tx", "ty"]).filter("lon between w and e and lat between s and n")
    return j.filter(_inside(F.col("geometry"), F.col("lon"), F.col("lat"))).select("point_id", "lon", "lat", "geo")


def region_point_counts(matched: DataFrame, regions: DataFrame) -> DataFrame:
    n = matched.groupBy("geo").agg(F.count("*").alias("n_points"))
    return regions.select("geo").join(n, "geo", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))


def fill_empty_regions(matched: DataFrame, regions: DataFrame) -> DataFrame:
    """matched, and for each region without a point its box centre and the points a quarter off it that lie inside, tagged extra."""
    none = regions.join(matched.select("geo").distinct(), "geo", "left_anti")
    box = none.select("geo", F.flatten("geometry").alias("p")).selectExpr("geo", *_BOX)
    spots = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0.5, 0.5), (0.25, 0.25), (0.25, 0.75), (0.75, 0.25), (0.75, 0.75))))
    made = box.select("geo", "w", "e", "s", "n", F.posexplode(spots).alias("k", "c"))
    pts = made.select(F.concat_ws(":", "geo", "k").alias("point_id"), (F.col("w") + F.col("c.a") * (F.col("e") - F.col("w"))).alias("lon"), (F.col("s") + F.col("c.b") * (F.col("n") - F.col("s"))).alias("lat"))
    extra = point_in_region(pts, none)
    return matched.withColumn("point_id", F.col("point_id").cast("string")).withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
