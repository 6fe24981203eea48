"""Relations of polygons against results by hand and against a raster of points."""

import random

import pytest

from driftmap.operators import polygons, validation

TYPE = "geo string, geometry array<array<struct<lon: double, lat: double>>>"


def ring(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def box(w, s, e, n):
    return ring((w, s), (e, s), (e, n), (w, n))


def related(spark, shapes, **more):
    df = spark.createDataFrame([(k, v) for k, v in shapes.items()], TYPE)
    return {(r.src, r.dst): (r.contact, round(r.border, 9), r.overlap) for r in polygons.region_relations(df, **more).collect()}


A = box(0, 0, 4, 4)
CASES = {
    "apart": (box(6, 0, 8, 2), None),
    "triangle beside, boxes overlap": (ring((5, 0), (6, 6), (3.9, 6)), None),
    "corner": (box(4, 4, 6, 6), (True, 0, False)),
    "edge": (box(4, 0, 6, 4), (True, 4, False)),
    "part of an edge, T-junction": (box(4, 1, 6, 3), (True, 2, False)),
    "tip on an edge": (ring((4, 2), (6, 1), (6, 3)), (True, 0, False)),
    "crossing": (box(2, 2, 6, 6), (True, 0, True)),
    "inside": (box(1, 1, 2, 2), (False, 0, True)),
    "inside along an edge": (box(0, 1, 2, 2), (True, 1, True)),
    "inside from corner to corner": (ring((0, 0), (4, 4), (0, 4)), (True, 8, True)),
    "equal": (A, (True, 16, True)),
    "equal, backwards": (A[::-1], (True, 16, True)),
    "around": (box(-1, -1, 5, 5), (False, 0, True)),
    "through both sides": (box(-1, 1, 5, 2), (True, 0, True)),
    "tip inside": (ring((3, 2), (6, 1), (6, 3)), (True, 0, True)),
    "diamond on all corners": (ring((2, -2), (6, 2), (2, 6), (-2, 2)), (True, 0, True)),
    "from corner through": (ring((4, 4), (-1, 1), (1, -1)), (True, 0, True)),
}


def moved(shape, by):
    return [{"lon": p["lon"] + by, "lat": p["lat"]} for p in shape]


@pytest.mark.parametrize("tile", [1.0, 50.0])
def test_pairs(spark, tile):
    """Each case lies by itself, 64 units from the next."""
    shapes = {f"{k}/{name}": [moved(shape, 64 * i)] for i, (name, (other, _)) in enumerate(CASES.items()) for k, shape in (("a", A), ("b", other))}
    got = related(spark, shapes, tile=tile)
    want = {}
    for name, (_, w) in CASES.items():
        for k, j in ("ab", "ba") if w else ():
            want[f"{k}/{name}", f"{j}/{name}"] = w
    assert got.keys() == want.keys()
    for k, (contact, border, overlap) in want.items():
        assert (k, got[k]) == (k, (contact, pytest.approx(border), overlap))


def test_holes_and_islands(spark):
    ring_shaped = [box(0, 0, 9, 9), box(2, 2, 7, 7)]
    got = related(spark, {"o": ring_shaped, "fill": [box(2, 2, 7, 7)], "free": [box(3, 3, 4, 4)], "partly": [box(1, 3, 3, 4)]})
    assert got["o", "fill"] == (True, 20, False)
    assert ("o", "free") not in got and got["fill", "free"] == (False, 0, True)
    assert got["o", "partly"][2] and got["fill", "partly"][2]
    parts = [box(0, 0, 1, 1), box(10, 10, 11, 11)]
    got = related(spark, {"m": parts, "touch": [box(1, 0, 2, 1)], "both": [box(1, 0, 2, 1), box(9, 9, 12, 12)]})
    assert got["m", "touch"] == (True, 1, False) and got["m", "both"] == (True, 1, True)


def test_named_operators(spark):
    shapes = {"a": [A], "t": [box(4, 1, 6, 3)], "c": [box(-2, -2, 0, 0)], "in": [box(1, 1, 2, 2)], "far": [box(50, 50, 51, 51)], "none": [], "null": None}
    df = spark.createDataFrame(list(shapes.items()), TYPE)
    assert {(r.src, r.dst) for r in polygons.touching_regions(df).collect()} == {("a", "t"), ("t", "a"), ("a", "c"), ("c", "a")}
    assert {r.geo: r.n_touching for r in polygons.polygon_intersections(df).collect()} == {"a": 3, "t": 1, "c": 1, "in": 1}
    assert {(r.src, r.dst, r.border) for r in polygons.border_neighbours(df, snap=0.5).collect()} == {("a", "t", 2.0), ("t", "a", 2.0)}


def inside(rings, x, y):
    n = 0
    for r in rings:
        for a, b in zip(r, r[1:] + r[:1], strict=True):
            if (a["lat"] > y) != (b["lat"] > y) and x < a["lon"] + (y - a["lat"]) / (b["lat"] - a["lat"]) * (b["lon"] - a["lon"]):
                n += 1
    return n % 2 == 1


def test_triangles_on_a_lattice(spark):
    """Overlap of triangles with whole corners, by a fine raster of points: what it finds must be found, and what is found must be no accident of one pair."""
    rng = random.Random(3)
    shapes = {}
    while len(shapes) < 40:
        p = [(rng.randrange(9), rng.randrange(9)) for _ in range(3)]
        if (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) != (p[2][0] - p[0][0]) * (p[1][1] - p[0][1]):
            shapes[f"t{len(shapes)}"] = [ring(*p)]
    got = related(spark, shapes, tile=2.0)
    fine = [(0.0137 + i / 24, 0.0071 + j / 24) for i in range(24 * 9) for j in range(24 * 9)]
    held = {k: {q for q in fine if inside(v, *q)} for k, v in shapes.items()}
    missed = 0
    for a in shapes:
        for b in shapes:
            if a != b:
                found = got.get((a, b), (False, 0, False))[2]
                assert found or not held[a] & held[b], (a, b)
                missed += found and not held[a] & held[b]
    assert missed <= 0.05 * len(got)  # slivers between the points


def test_buffers_reach_across(spark):
    """A region around another one, and one whose long edge crosses it, are within any distance of it."""
    shapes = {"in": [box(9.9, 51.9, 10.1, 52.1)], "around": [box(4, 48, 16, 56)], "bar": [box(6, 51.99, 14, 52.01)], "far": [box(30, 50, 31, 51)]}
    df = spark.createDataFrame(list(shapes.items()), TYPE)
    folds = spark.createDataFrame([("in", 1)], "geo string, fold int")
    assert {r.geo for r in validation.buffer_regions(df, folds, 35.0).collect()} == {"around", "bar"}
