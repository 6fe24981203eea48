"""Relations of polygons: contact of boundaries, shared borders, overlap and containment.

A region is the even-odd fill of its rings: outlines, holes and islands. Segments of two
regions meet in a join of the tiles that they lie in. Where boundaries meet, each segment is
cut at the places of contact, and the middles of its pieces tell whether it runs inside the
other region; a piece that both have is told by the sides on which they lie. Rings that meet
nothing of the other region are inside or outside as a whole, by one of their points. Points
meet segments in bands of latitude, so that a region's geometry is never one row of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of a segment's length that count as nothing.
NEAR = 1e-9


def _odd(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from a point to the east crosses a ring an odd number of times."""
    ends = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("b"))

    def one(n: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        at = a["lon"] + (y - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return n + F.when(((a["lat"] > y) != (b["lat"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(ends, F.lit(0), one) % 2 == 1


def segments(regions: DataFrame, snap: float = 0.0) -> DataFrame:
    """geo, ring, n, x1, y1, x2, y2, left of each segment; left: whether the region lies on its left. snap rounds coordinates to its multiples."""
    put = (lambda c: F.round(c / snap) * snap) if snap else (lambda c: c)
    ring = F.transform("geometry", lambda r: F.transform(r, lambda p: F.struct(put(p["lon"]).alias("lon"), put(p["lat"]).alias("lat"))))
    base = regions.select("geo", ring.alias("rings"))
    middle = lambda r: [(r[0][k] + F.element_at(r, F.when(F.size(r) > 1, 2).otherwise(1))[k]) / 2 for k in ("lon", "lat")]
    depth = lambda r, i: F.size(F.filter("rings", lambda s, j: (j != i) & _odd(s, *middle(r))))
    next_of = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    area = lambda r: F.aggregate(F.arrays_zip(r.alias("a"), next_of(r).alias("b")), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    told = F.transform("rings", lambda r, i: F.struct(F.arrays_zip(r.alias("a"), next_of(r).alias("b")).alias("ends"), ((area(r) > 0) == (depth(r, i) % 2 == 0)).alias("left")))
    rings = base.filter(F.size("rings") > 0).select("geo", F.posexplode(told).alias("ring", "r"))
    ends = rings.select("geo", "ring", "r.left", F.posexplode("r.ends").alias("n", "e"))
    return ends.select("geo", "ring", "n", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"), "left").filter("x1 <> x2 or y1 <> y2")


def _tiles(a: str, b: str, tile: float) -> Column:
    return F.explode(F.sequence(F.floor(F.least(a, b) / tile), F.floor(F.greatest(a, b) / tile)))


def _meetings(segs: DataFrame, tile: float) -> DataFrame:
    """Segments of two regions that meet: those of src with the share of the way where (at), or from lo to hi where they run together, and whether the regions are then on one side; crossed where they cross inside both."""
    own = segs.withColumn("tx", _tiles("x1", "x2", tile)).withColumn("ty", _tiles("y1", "y2", tile))
    names = ("x1", "y1", "x2", "y2", "left")
    a = own.select(F.col("geo").alias("src"), "ring", "n", *names, "tx", "ty")
    b = own.select(F.col("geo").alias("dst"), *(F.col(c).alias(f"o{c}") for c in names), "tx", "ty")
    c = F.col
    low = lambda p: F.floor(F.greatest(F.least(f"{p}1", f"{p}2"), F.least(f"o{p}1", f"o{p}2")) / tile)
    apart = lambda p: (F.greatest(f"{p}1", f"{p}2") < F.least(f"o{p}1", f"o{p}2")) | (F.greatest(f"o{p}1", f"o{p}2") < F.least(f"{p}1", f"{p}2"))
    # a pair may share several tiles; the one of the larger lower bounds counts
    met = a.join(b, ["tx", "ty"]).filter("src <> dst").filter((c("tx") == low("x")) & (c("ty") == low("y")) & ~apart("x") & ~apart("y"))
    dx, dy, ex, ey, fx, fy = c("x2") - c("x1"), c("y2") - c("y1"), c("ox2") - c("ox1"), c("oy2") - c("oy1"), c("ox1") - c("x1"), c("oy1") - c("y1")
    met = met.withColumns({"d2": dx * dx + dy * dy, "e2": ex * ex + ey * ey, "cross": dx * ey - dy * ex})
    level = F.abs("cross") <= NEAR * F.sqrt(c("d2") * c("e2"))
    t, u = F.when(~level, (fx * ey - fy * ex) / c("cross")), F.when(~level, (fx * dy - fy * dx) / c("cross"))
    on_line = level & (F.abs(fx * dy - fy * dx) <= NEAR * F.sqrt(c("d2") * F.greatest("d2", "e2")))
    ta, tb = (fx * dx + fy * dy) / c("d2"), ((fx + ex) * dx + (fy + ey) * dy) / c("d2")
    met = met.withColumns({"t": t, "u": u, "lo": F.when(on_line, F.greatest(F.lit(0.0), F.least(ta, tb))), "hi": F.when(on_line, F.least(F.lit(1.0), F.greatest(ta, tb)))})
    inside = lambda v, e: (v > e) & (v < 1 - e)
    hit = F.coalesce(inside(c("t"), F.lit(-NEAR)) & inside(c("u"), F.lit(-NEAR)), F.lit(False))
    together = F.coalesce(c("hi") - c("lo") > NEAR, F.lit(False))
    point = F.coalesce(F.abs(c("hi") - c("lo")) <= NEAR, F.lit(False))
    same = (c("left") == c("oleft")) == (dx * ex + dy * ey > 0)
    return met.filter(hit | together | point).select(
        "src", "dst", "ring", "n", "x1", "y1", "x2", "y2",
        F.when(hit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("t")))).when(point, c("lo")).alias("at"),
        F.when(together, F.struct("lo", "hi")).alias("run"),
        F.when(together, (c("hi") - c("lo")) * F.sqrt("d2")).otherwise(0.0).alias("length"),
        (hit & inside(c("t"), F.lit(NEAR)) & inside(c("u"), F.lit(NEAR)) | together & same).alias("crossed"),
    )


def _inside(points: DataFrame, segs: DataFrame, tile: float) -> DataFrame:
    """src, dst of points (src, dst, x, y) that lie in dst."""
    bands = segs.select(F.col("geo").alias("dst"), "x1", "y1", "x2", "y2", _tiles("y1", "y2", tile).alias("band"))
    spots = points.withColumn("band", F.floor(F.col("y") / tile))
    east = F.col("x1") + (F.col("y") - F.col("y1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    over = spots.join(bands, ["dst", "band"]).filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))).filter(F.col("x") < east)
    return over.groupBy("src", "dst", "x", "y").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("src", "dst").distinct()


def region_relations(regions: DataFrame, tile: float = 1.0, snap: float = 0.0) -> DataFrame:
    """src, dst, contact, border, overlap of every ordered pair of regions that meet.

    regions: geo, geometry (rings of lon, lat; the first point isn't repeated or is). contact:
    their boundaries have a point in common; border: the length of what they share, in the
    units of the coordinates; overlap: their insides have a point in common. Null geometry,
    empty rings and rings without extent meet nothing. tile is the width of the tiles in
    which segments meet: about that of a region.
    """
    segs = segments(regions, snap)
    met = _meetings(segs, tile)
    each = met.groupBy("src", "dst", "ring", "n", "x1", "y1", "x2", "y2").agg(F.collect_set("at").alias("at"), F.collect_set("run").alias("runs"), F.max("length").alias("length"), F.max("crossed").alias("crossed"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), "at", "runs.lo", "runs.hi")))
    each = each.withColumn("cuts", cuts)
    pieces = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.element_at("cuts", i).alias("a"), F.element_at("cuts", i + 1).alias("b")))
    own = F.filter(pieces, lambda p: (p["b"] - p["a"] > 2 * NEAR) & ~F.exists("runs", lambda r: (r["lo"] < (p["a"] + p["b"]) / 2) & (r["hi"] > (p["a"] + p["b"]) / 2)))
    probes = each.filter("not crossed").select("src", "dst", "x1", "y1", "x2", "y2", F.explode(F.transform(own, lambda p: (p["a"] + p["b"]) / 2)).alias("t"))
    probes = probes.select("src", "dst", (F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))).alias("y"))
    boxes = segs.groupBy(F.col("geo").alias("dst")).agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("nn"))
    spread = boxes.withColumn("tx", _tiles("w", "e", tile)).withColumn("ty", _tiles("s", "nn", tile))
    firsts = segs.groupBy(F.col("geo").alias("src"), "ring").agg(F.min_by(F.struct("x1", "y1"), "n").alias("p")).select("src", "ring", F.col("p.x1").alias("x"), F.col("p.y1").alias("y"))
    firsts = firsts.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    loose = firsts.join(spread, ["tx", "ty"]).filter("src <> dst and x between w and e and y between s and nn").select("src", "dst", "ring", "x", "y")
    loose = loose.join(each.select("src", "dst", "ring").distinct(), ["src", "dst", "ring"], "left_anti").drop("ring")
    held = _inside(probes.unionByName(loose), segs, tile)
    mine = each.groupBy("src", "dst").agg(F.lit(True).alias("contact"), F.sum("length").alias("border"), F.max("crossed").alias("overlap"))
    both = held.unionByName(held.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    all_pairs = mine.unionByName(both.select("src", "dst", F.lit(False).alias("contact"), F.lit(0.0).alias("border"), F.lit(True).alias("overlap")))
    return all_pairs.groupBy("src", "dst").agg(F.max("contact").alias("contact"), F.max("border").alias("border"), F.max("overlap").alias("overlap"))


def polygon_intersections(regions: DataFrame, tile: float = 1.0) -> DataFrame:
    """geo, n_touching: with how many other regions each has a point in common; regions that meet none are left out."""
    return region_relations(regions, tile).groupBy(F.col("src").alias("geo")).agg(F.count("*").alias("n_touching"))


def touching_regions(regions: DataFrame, tile: float = 1.0) -> DataFrame:
    """src, dst: regions whose boundaries meet and whose insides don't."""
    return region_relations(regions, tile).filter("contact and not overlap").select("src", "dst")


def border_neighbours(regions: DataFrame, tile: float = 1.0, snap: float = 0.00745) -> DataFrame:
    """src, dst, border: regions that share a stretch of border, wherever its vertices lie, with its length."""
    return region_relations(regions, tile, snap).filter("border > 0").select("src", "dst", "border")
