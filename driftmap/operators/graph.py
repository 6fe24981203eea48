"""Region graphs, precision matrices on edges, and proximity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.operators.lineage import cut, drop, numbered
from driftmap.operators.spectrum import noise_shift


def _vertices(regions: DataFrame, snap: float) -> DataFrame:
    """geo and snapped vertices of its rings, each once."""
    p = regions.select("geo", F.explode(F.flatten("geometry")).alias("p"))
    return p.select("geo", F.round(F.col("p.lon") / snap).cast("long").alias("vx"), F.round(F.col("p.lat") / snap).cast("long").alias("vy")).distinct()


def polygon_neighbours(regions: DataFrame, snap: float = 0.00745, queen: bool = True) -> DataFrame:
    """src, dst: regions that share a vertex (queen) or at least two (rook), by a self join on snapped vertices."""
    v = _vertices(regions, snap)
    shared = v.select(F.col("geo").alias("src"), "vx", "vy").join(v.select(F.col("geo").alias("dst"), "vx", "vy"), ["vx", "vy"]).filter("src <> dst")
    return shared.groupBy("src", "dst").agg(F.count("*").alias("n")).filter(F.col("n") >= (1 if queen else 2)).select("src", "dst")


def duplicate_geometries(regions: DataFrame) -> DataFrame:
    """Regions with the same vertices; there must be none."""
    g = _vertices(regions, 1e-6).groupBy("geo").agg(F.sort_array(F.collect_set(F.struct("vx", "vy"))).alias("shape"))
    return g.groupBy("shape").agg(F.sort_array(F.collect_list("geo")).alias("geos")).filter(F.size("geos") > 1).select("geos")


def neighbour_counts(regions: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("src").alias("geo")).agg(F.count("*").alias("degree"), F.sort_array(F.collect_set("dst")).alias("neighbours"))
    return regions.select("geo").join(n, "geo", "left").select("geo", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"), F.col("degree").isNotNull().alias("has_neighbour"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _labels(edges: DataFrame) -> DataFrame:
    """geo, label of every node with an edge to another one: the least node reachable, edges taken both ways.

    Large-star and small-star steps alternate until no edge changes.
    """
    stars = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before, old = state, stars
        stars = cut(_small_star(_large_star(old)))
        drop(old)
    return stars.select(F.col("u").alias("geo"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("geo"), F.col("v").alias("label")).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """geo, component, size: components numbered from the largest down (ties by least geo).

    Edges with an end outside nodes are left out.
    """
    all_nodes = nodes.select("geo").distinct()
    inside = edges.join(all_nodes, edges["src"] == all_nodes["geo"], "left_semi").join(all_nodes, edges["dst"] == all_nodes["geo"], "left_semi")
    label = cut(all_nodes.join(_labels(inside), "geo", "left").select("geo", F.coalesce("label", "geo").alias("label")))
    size = label.groupBy("label").agg(F.count("*").alias("size"))
    rank = numbered(size.withColumn("_less", -F.col("size")), ("_less", "label"), "component")
    return label.join(rank, "label").select("geo", F.col("component").cast("int").alias("component"), "size")


def component_of(edges: DataFrame, start: str | None = None) -> DataFrame:
    """geo of the component of one node, by default that of the largest degree; edges go both ways."""
    spark = edges.sparkSession
    if start is None:
        top = edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()
        start = top["src"]
    label = _labels(edges)
    own = label.filter(F.col("geo") == start).select("label")
    return label.join(own, "label", "left_semi").select("geo").unionByName(spark.createDataFrame([(start,)], "geo string")).distinct()


def grid_and_chain_graph(nodes: DataFrame, removed_nodes: Sequence[int] = (), removed: Sequence[tuple[int, int]] = (), clique: Sequence[int] = ()) -> DataFrame:
    """src, dst of a chain over nodes in order without some, without some links, with a clique added; both ways."""
    left = nodes.filter(~F.col("node").isin(*removed_nodes)) if removed_nodes else nodes
    places = numbered(left.select("node"), ("node",), "_n")
    chain = places.select(F.col("node").alias("src"), (F.col("_n") + 1).alias("_n")).join(places.withColumnRenamed("node", "dst"), "_n").select("src", "dst")
    spark = nodes.sparkSession
    if removed:
        chain = chain.join(spark.createDataFrame(list(removed), "src long, dst long"), ["src", "dst"], "left_anti")
    more = [(a, b) for a in clique for b in clique if a < b]
    if more:
        chain = chain.unionByName(spark.createDataFrame(more, "src long, dst long")).distinct()
    return chain.unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def laplacian_edges(nodes: DataFrame, edges: DataFrame, mixing: float | None = None) -> DataFrame:
    """i, j, value of the graph Laplacian; with mixing in (0, 1): mixing * Q + (1 - mixing) * I."""
    if mixing is not None and not 0 < mixing < 1:
        raise ValueError("mixing must lie in (0, 1)")
    degree = nodes.select("geo").join(edges.groupBy(F.col("src").alias("geo")).agg(F.count("*").cast("double").alias("d")), "geo", "left")
    q = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("value")).unionByName(degree.select(F.col("geo").alias("i"), F.col("geo").alias("j"), F.coalesce("d", F.lit(0.0)).alias("value")))
    return q if mixing is None else q.withColumn("value", F.col("value") * mixing + F.when(F.col("i") == F.col("j"), 1 - mixing).otherwise(0.0))


def laplacian_centroid_weights(nodes: DataFrame, edges: DataFrame, kappa: float = 1.0, tau: float = 0.5) -> DataFrame:
    """Precision on edges by centroid distance, scaled by the largest: off the diagonal -2kt e^(-kl) / (1 - e^(-2kl)). edges: src, dst, dist."""
    top = edges.agg(F.max("dist").alias("top"))
    e = edges.crossJoin(F.broadcast(top)).withColumn("l", F.col("dist") / F.col("top"))
    a, b = F.exp(-kappa * F.col("l")), F.exp(-2 * kappa * F.col("l"))
    off = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-2 * kappa * tau * a / (1 - b)).alias("value"), (0.5 + b / (1 - b)).alias("part"))
    diag = off.groupBy("i").agg((2 * kappa * tau * (F.sum("part") + F.when(F.count("*") == 1, 0.5).otherwise(0.0))).alias("value"))
    alone = nodes.select(F.col("geo").alias("i")).join(diag, "i", "left_anti").select("i", F.lit(2 * kappa * tau).alias("value"))
    diag = diag.unionByName(alone)
    return off.select("i", "j", "value").unionByName(diag.select("i", F.col("i").alias("j"), "value"))


def links_to_laplacian(links: DataFrame) -> DataFrame:
    """Symmetric link weights i < j as a Laplacian: off the diagonal the negative weight, on it the row's sum."""
    both = links.select("i", "j", "weight").unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    return both.select("i", "j", (-F.col("weight")).alias("value")).unionByName(both.groupBy("i").agg(F.sum("weight").alias("value")).select("i", F.col("i").alias("j"), "value"))


def _times(q: DataFrame, x: DataFrame, exponent: int, shift: float) -> DataFrame:
    """(Q ** exponent + shift I) x by key; x: key, node, v."""
    y = x
    for _ in range(exponent):
        y = q.join(y, q["j"] == y["node"]).groupBy("key", "i").agg(F.sum(F.col("value") * F.col("v")).alias("v")).select("key", F.col("i").alias("node"), "v")
    if not shift:
        return y
    return y.unionByName(x.select("key", "node", (F.col("v") * shift).alias("v"))).groupBy("key", "node").agg(F.sum("v").alias("v"))


def _root_terms(low: float, high: float, accuracy: float, e: float) -> tuple[list[tuple[int, float, float]], float, float]:
    """v ** e, for e in (0, 1), as c0 + c1 v + sum of w v / (v + t) over (k, w, t), for v from low to high: the trapezoidal rule on the logarithm of Balakrishnan's integral."""
    spread = -math.log(accuracy)
    step = math.pi**2 / spread
    begin, end = math.log(low) / 2 - spread / (2 + 2 * e), math.log(high) / 2 + spread / (4 - 2 * e)
    n = math.ceil((end - begin) / step)
    at = [begin + step * (k + 0.5) for k in range(n)]
    front = 2 * math.sin(math.pi * e) / math.pi
    terms = [(k, front * step * math.exp(2 * e * u), math.exp(2 * u)) for k, u in enumerate(at, 1)]
    return terms, front / (2 * e) * math.exp(2 * e * begin), front / (2 - 2 * e) * math.exp((2 * e - 2) * (begin + n * step))


def _root_graph(q: DataFrame, known: DataFrame, accuracy: float, e: float) -> tuple[DataFrame, DataFrame]:
    """A larger graph in which the fill by Q is the fill by Q ** e, for e in (0, 1).

    x' w Q (Q + t)^-1 x is the least value over z of (w / t) z' Q z + w |x - z|^2, so each
    term of the root adds a copy of the graph whose nodes are tied to those of x. Nodes are
    structs of the node and the number of its copy, 0 for x. The bounds of Q's eigenvalues
    are those of its rows; one that isn't above 0 counts as a ten-thousandth of the largest.
    """
    rows = q.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("d"), F.sum(F.when(F.col("i") != F.col("j"), F.abs("value"))).alias("o"))
    low, high = rows.select(F.min(F.col("d") - F.coalesce("o", F.lit(0.0))), F.max(F.col("d") + F.coalesce("o", F.lit(0.0)))).first()
    terms, c0, c1 = _root_terms(low if low > high * 1e-4 else high * 1e-4, high, accuracy, e)
    term = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"), F.lit(t).alias("t")) for k, w, t in terms))).alias("c")
    node = lambda c, k: F.struct(F.col(c).alias("node"), (F.lit(k) if isinstance(k, int) else k).alias("copy"))
    edge = lambda df, i, j, value: df.select(i.alias("i"), j.alias("j"), value.alias("value"))
    copies, nodes = q.select("i", "j", "value", term), rows.select("i", term)
    k, w = F.col("c.k"), F.col("c.w")
    larger = edge(q, node("i", 0), node("j", 0), F.col("value") * c1)
    larger = larger.unionByName(edge(rows, node("i", 0), node("i", 0), F.lit(c0 + sum(w for _, w, _ in terms))))
    larger = larger.unionByName(edge(copies, node("i", k), node("j", k), F.col("value") * w / F.col("c.t")))
    for i, j, sign in ((node("i", k), node("i", k), 1), (node("i", 0), node("i", k), -1), (node("i", k), node("i", 0), -1)):
        larger = larger.unionByName(edge(nodes, i, j, sign * w))
    free = nodes.select(node("i", k).alias("node")).crossJoin(known.select("key").distinct()).select("key", "node", F.lit(0).alias("presence"))
    return cut(larger), known.select("key", node("node", 0).alias("node"), F.col("presence").cast("int").alias("presence")).unionByName(free)


def harmonic_fill(q: DataFrame, known: DataFrame, exponent: float = 1, shift: float | None = 0.0, rounds: int = 1000, tolerance: float = 1e-14, accuracy: float = 1e-6) -> DataFrame:
    """key, node, x: x is 1 where known is 1; elsewhere M_AA x_A = -M_AB 1 with M = Q ** exponent + shift I.

    exponent: between 0 and 1, or a whole number; accuracy is that of the root of Q. shift:
    None takes a fifth of Q's median eigenvalue (noise_shift). known: key, node, presence (0 or 1). A key without a 1 is 0 everywhere. All keys are solved together
    by conjugate gradients, one exponent of joins and two aggregates a round, until each
    key's squared residual is under the tolerance times that of the right-hand side. A
    ValueError is raised if that takes more than the given rounds.
    """
    if shift is None:
        shift = noise_shift(q)
    if 0 < exponent < 1:
        larger, all_known = _root_graph(q, known, accuracy, exponent)
        if shift:
            larger = larger.unionByName(larger.select("i").filter("i.copy = 0").distinct().select("i", F.col("i").alias("j"), F.lit(float(shift)).alias("value")))
        return harmonic_fill(larger, all_known, 1, 0.0, rounds, tolerance).filter("node.copy = 0").select("key", F.col("node.node").alias("node"), "x")
    if exponent < 1 or exponent != int(exponent):
        raise ValueError("exponent must lie between 0 and 1 or be a positive integer")
    q, known = cut(q.select("i", "j", "value")), cut(known.select("key", "node", "presence"))  # every round reads them
    ones = known.filter("presence = 1").select("key", "node", F.lit(1.0).alias("v"))
    free = known.filter("presence <> 1").select("key", "node").join(ones.select("key").distinct(), "key", "left_semi")
    b = _times(q, ones, int(exponent), 0.0).join(free, ["key", "node"], "right").select("key", "node", F.coalesce(-F.col("v"), F.lit(0.0)).alias("r"))
    if exponent == 1:  # preconditioned by the diagonal
        diagonal = q.filter(F.col("i") == F.col("j")).groupBy("i").agg((1 / (F.sum("value") + shift)).alias("d"))
        b = b.join(diagonal, b["node"] == diagonal["i"], "left").select("key", "node", "r", F.coalesce("d", F.lit(1.0)).alias("d"))
    else:
        b = b.withColumn("d", F.lit(1.0))
    state = cut(b.select("key", "node", F.lit(0.0).alias("x"), "r", (F.col("r") * F.col("d")).alias("p"), "d"))
    size = cut(state.groupBy("key").agg(F.sum(F.col("r") * F.col("r")).alias("bb")))
    left, done = (1.0 if size.filter("bb > 0").head(1) else 0.0), 0
    while not left < tolerance:
        if done == rounds:
            raise ValueError(f"a squared residual of {left} times the right-hand side is left after {rounds} rounds")
        done += 1
        ap = _times(q, state.select("key", "node", F.col("p").alias("v")), int(exponent), shift).withColumnRenamed("v", "ap")
        s = state.join(ap, ["key", "node"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
        sums = s.groupBy("key").agg(F.sum(F.col("r") * F.col("d") * F.col("r")).alias("rz"), F.sum(F.col("p") * F.col("ap")).alias("pap"))
        step = F.when(F.col("pap") > 0, F.col("rz") / F.col("pap")).otherwise(0.0)
        s = s.join(sums, "key").withColumn("al", step)
        s = s.select("key", "node", (F.col("x") + F.col("al") * F.col("p")).alias("x"), (F.col("r") - F.col("al") * F.col("ap")).alias("r"), "p", "d", "rz")
        new = s.groupBy("key").agg(F.sum(F.col("r") * F.col("d") * F.col("r")).alias("zn"), F.sum(F.col("r") * F.col("r")).alias("rn"))
        s = s.join(new, "key")
        turn = F.when(F.col("rz") > 0, F.col("zn") / F.col("rz")).otherwise(0.0)
        old, state = state, cut(s.select("key", "node", "x", "r", (F.col("r") * F.col("d") + turn * F.col("p")).alias("p"), "d", "rn"))
        drop(old)
        left = state.groupBy("key").agg(F.max("rn").alias("rn")).join(size, "key").agg(F.max(F.when(F.col("bb") > 0, F.col("rn") / F.col("bb")).otherwise(0.0))).first()[0] or 0.0
        state = state.drop("rn")
    drop(size, q)
    solved = state.select("key", "node", "x")
    return known.select("key", "node", "presence").join(solved, ["key", "node"], "left").select("key", "node", F.when(F.col("presence") == 1, 1.0).otherwise(F.coalesce("x", F.lit(0.0))).alias("x"))


def presence_or_zero(presence: DataFrame) -> DataFrame:
    return presence.withColumn("presence", F.coalesce(F.when(F.col("presence") == 1, 1), F.lit(0)))


def proximity_by_year(q: DataFrame, presence: DataFrame, exponents: Sequence[float], shift: float | None = 0.0, rounds: int = 1000) -> DataFrame:
    """geo, year_idx, y_proximity_exp<e>, in hundredths (050 for one half): each year's fill stands in the next year; zeros in the first.

    shift None: a fifth of Q's median eigenvalue, found once for all exponents.
    """
    if shift is None:
        shift = noise_shift(q)
    known = presence_or_zero(presence).select(F.col("year_idx").alias("key"), F.col("geo").alias("node"), "presence")
    out = None
    for e in exponents:
        x = harmonic_fill(q, known, e, shift, rounds).select(F.col("node").alias("geo"), (F.col("key") + 1).cast("int").alias("year_idx"), F.col("x").alias(f"y_proximity_exp{round(100 * e):03d}"))
        zero = presence.select("geo").distinct().crossJoin(presence.agg(F.min("year_idx").cast("int").alias("year_idx"))).withColumn(f"y_proximity_exp{round(100 * e):03d}", F.lit(0.0))
        one = zero.unionByName(x.select(*zero.columns))
        out = one if out is None else out.join(one, ["geo", "year_idx"])
    return out


def surrounded_regions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """inner, outer: of a short list of regions that lie inside another one, each pair once whose regions are both in df."""
    listed = df.sparkSession.createDataFrame(sorted(set(pairs)), "inner string, outer string")
    there = df.select("geo").distinct()
    return listed.join(there, listed["inner"] == there["geo"], "left_semi").join(there, listed["outer"] == there["geo"], "left_semi")


def inherit_outer_proximity(proximity: DataFrame, presence: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """An inner region takes its outer region's proximity while neither was present the year before."""
    before = presence_or_zero(presence).select("geo", (F.col("year_idx") + 1).cast("int").alias("year_idx"), F.col("presence").alias("was"))
    p = proximity.join(before, ["geo", "year_idx"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
    outer = p.select(F.col("geo").alias("outer"), "year_idx", F.col(column).alias("_o"), F.col("was").alias("_w"))
    j = p.join(F.broadcast(pairs), p["geo"] == pairs["inner"], "left").drop("inner").join(outer, ["outer", "year_idx"], "left")
    take = F.col("_o").isNotNull() & (F.col("was") == 0) & (F.col("_w") == 0)
    return j.withColumn(column, F.when(take, F.col("_o")).otherwise(F.col(column))).select(*proximity.columns)


def proximity_from_draws(draws: DataFrame, q: DataFrame, pairs: DataFrame, exponent: float = 1, shift: float | None = 0.0, rounds: int = 1000) -> DataFrame:
    """Next year's proximity from draws: presence where the mean probability is at least one half."""
    mean = draws.groupBy("geo", "year_idx").agg(F.avg("p").alias("m")).withColumn("presence", (F.col("m") >= 0.5).cast("int"))
    name = f"y_proximity_exp{round(100 * exponent):03d}"
    last = mean.agg(F.max("year_idx").alias("last"))
    x = proximity_by_year(q, mean, [exponent], shift, rounds).crossJoin(F.broadcast(last)).filter("year_idx = last + 1").drop("last")
    return inherit_outer_proximity(x, mean, pairs, name)


def proximity_map_table(proximity: DataFrame, presence: DataFrame, column: str, year_idx: int | None = None) -> DataFrame:
    """Proximity for maps, blank where the species was present the year before."""
    p = proximity if year_idx is None else proximity.filter(F.col("year_idx") == year_idx)
    before = presence_or_zero(presence).select("geo", (F.col("year_idx") + 1).cast("int").alias("year_idx"), F.col("presence").alias("was"))
    return p.join(before, ["geo", "year_idx"], "left").select("geo", "year_idx", F.when(F.coalesce("was", F.lit(0)) != 1, F.col(column)).alias(column))
