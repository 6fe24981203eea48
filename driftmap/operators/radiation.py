"""The radiation model from a region map, by places instead of a table of pairs.

A task takes a block of origins and meets the map in chunks. Regions at one place see all
others in one order, so destinations are sorted once for a place and all years; with the
origin itself counted, the population up to a farther destination is the same for all
origins of a place. Memory is a few numbers for each region and year. Pairs leave a task one
origin and year at a time, sums leave without the pairs, and a link of two regions is made
where both its ways are known, so that no pair is shuffled. The work is one sort of the map for
each place, and for sums one step for each place, region and year.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmap.operators.lineage import cut, numbered, running
from driftmap.operators.mobility import WGS84_FLATTENING, WGS84_KM

#: Regions in a row of the packed map, and least number of origins in a block.
CHUNK, BLOCK = 1024, 128
#: Tasks that the map is copied to, unless the session has more shuffle partitions.
TASKS = 64
#: Links that are ranked together, at least, and most ranges of them.
RANGE, RANGES = 1_000_000, 4096
#: Bytes that a tile's table of populations may take, and blocks of a map that is small enough for one.
TILE_BYTES, TILE_BLOCKS = 1 << 28, 10


class _Map:
    """All regions as arrays in the order of their names; populations by year, missing ones NaN, there tells which years a region has."""

    def __init__(self, chunks: list[pa.StructArray], years: Sequence[int]):
        number = lambda a: a.cast(pa.float64()).to_numpy(zero_copy_only=False)
        whole = lambda name: pa.concat_arrays([c.field(name) for c in chunks])
        self.geo, self.years, self.listed = whole("geo"), years, whole("listed").to_numpy(zero_copy_only=False)
        table = lambda name: np.ascontiguousarray(number(pa.concat_arrays([c.field(name).flatten() for c in chunks])).reshape(len(self.geo), len(years)).T)
        self.population, self.there = table("p"), table("there") > 0
        self.counted = np.nan_to_num(self.population)
        at = number(whole("longitude")) + 0.0 + 1j * (number(whole("latitude")) + 0.0)
        lost = np.isnan(at)  # in one place, whatever is known of them
        at[lost] = 1e9
        spots, self.place = np.unique(at, return_inverse=True)
        x, lat = np.radians(spots.real), np.radians(np.where(spots == 1e9, np.nan, spots.imag))
        self.x, self.y = x, np.arctan((1 - WGS84_FLATTENING) * np.tan(lat))
        self.sin, self.cos = np.sin(self.y), np.cos(self.y)
        self.by_place = np.argsort(self.place, kind="stable")
        self.bits = len(self.place).bit_length()

    def distances(self, a: int) -> np.ndarray:
        """Of one place from all, as mobility.geodesic_km has them."""
        sin_q, half = np.sin((self.y - self.y[a]) / 2), np.sin((self.x - self.x[a]) / 2)
        square = np.minimum(sin_q * sin_q + self.cos[a] * self.cos * (half * half), 1.0)
        near, far = np.sqrt(square), np.sqrt(1 - square)  # sine and cosine of half the angle
        s, sine = 2 * np.arcsin(near), 2 * near * far
        along, across = (self.sin + self.sin[a]) / 2, (self.sin - self.sin[a]) / 2
        with np.errstate(invalid="ignore", divide="ignore"):
            bend = (s - sine) * (along * along) / (1 - square) + (s + sine) * (across * across) / square
        return np.where(s == 0, 0.0, WGS84_KM * (s - WGS84_FLATTENING / 2 * bend))

    def nearest_first(self, a: int, d: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """All regions by distance from a place in units of 1e-9 km, then by name, unknown distances first, as Spark sorts nulls; how many are no farther than the place's own; which places are nearer than it (-1), as near (0) and farther."""
        unit = np.where(np.isnan(d), -1.0, np.rint(d * 1e9)).astype(np.int64)
        if self.bits > 17:  # half the equator in those units takes 45 bits
            unit = np.unique(unit, return_inverse=True)[1]
        key = (unit[self.place] << self.bits) | np.arange(len(self.place))
        key.sort()
        return key & ((1 << self.bits) - 1), int(np.searchsorted(key, (unit[a] + 1) << self.bits)), np.sign(unit - unit[a])

    def groups(self, origins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Place and origins there, of origins in the order of their places."""
        at = self.place[origins]
        for part in np.split(origins, np.flatnonzero(np.diff(at)) + 1) if len(origins) else []:
            yield int(self.place[part[0]]), part

    def dealt(self, block: int, blocks: int, sums: bool = False) -> np.ndarray:
        """A block's origins in the order of their places. For sums, the first origin of a place counts most, and each of the others by the regions at its place."""
        n = len(self.by_place)
        if not sums:
            return self.by_place[block * n // blocks : (block + 1) * n // blocks]
        at = self.place[self.by_place]
        cost = np.cumsum(np.where(np.diff(at, prepend=-1) > 0, 1.0, 0.0) + 0.01 + np.bincount(self.place)[at] / n)
        return self.by_place[np.minimum((cost / cost[-1] * blocks).astype(int), blocks - 1) == block]

    def fluxes(self, origins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, Callable, np.ndarray, float]]:
        """origin, year's place, destinations, names of them, prob, population of the origin, for each year that it has; and the distances from it."""
        for a, here in self.groups(origins):
            d = self.distances(a)
            order, head, _ = self.nearest_first(a, d)
            for t in np.flatnonzero(self.there[:, here].any(axis=1)):
                to = order if self.there[t].all() else order[self.there[t, order]]
                first = head if to is order else int(self.there[t, order[:head]].sum())
                n, upto = self.population[t, to], np.cumsum(self.counted[t, to])
                least = np.concatenate(([0.0], upto[:-1]))
                names = self.geo.take(pa.array(to))
                for o in here[self.there[t, here]]:
                    m, p = self.population[t, o], int(np.flatnonzero(to[:first] == o)[0])
                    under = least * (least + n)
                    under[:p] = (least[:p] + m) * (least[:p] + m + n[:p])
                    with np.errstate(invalid="ignore", divide="ignore"):
                        prob = np.where(under == 0, 0.0 * m, m * n / under)
                    yield o, t, np.delete(to, p), pa.concat_arrays([names[:p], names[p + 1 :]]), np.delete(prob, p), m, d


def _by_blocks(ranked: DataFrame, blocks: int, years: Sequence[int], schema: str, work: Callable[[_Map, int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What work gives for each block. ranked: what _ranked gives."""
    chunk = CHUNK
    chunks = ranked.groupBy(F.floor(F.col("_n") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_n", "geo", "longitude", "latitude", "p", "there", "listed"))).alias("rows"))
    parts = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1))))).repartitionById(max(1, blocks), F.col("block")).sortWithinPartitions("block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            rows = batch.column("rows")
            for k, b in enumerate(batch.column("block").to_pylist()):
                if held and b != block:
                    yield from work(_Map(held, years), block)
                    held = []
                block = b
                held.append(rows[k].values)
        if held:
            yield from work(_Map(held, years), block)

    return parts.select("block", "rows").mapInArrow(run, schema)


def _ranked(regions: DataFrame) -> DataFrame:
    """The map, numbered by name. regions: geo, longitude, latitude, p, there (arrays by year), listed."""
    return cut(numbered(regions, ("geo",), "_n").withColumn("_n", F.col("_n").cast("long") - 1))


def _most(ranked: DataFrame) -> int:
    return max(TASKS, int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _blocks(ranked: DataFrame) -> int:
    return min(-(-ranked.count() // BLOCK), _most(ranked))


def _with_years(regions: DataFrame, population: DataFrame, ends: DataFrame | None = None) -> tuple[DataFrame, list[int], list[float]]:
    """The map with populations by year, the years and all populations of each."""
    pop = cut(population.filter("year is not null").select("geo", F.col("year").cast("int").alias("year"), F.col("population").cast("double").alias("p")))
    found = pop.groupBy("year").agg(F.sum("p").alias("total")).orderBy("year").collect()
    years = [r["year"] for r in found]
    by_geo = pop.groupBy("geo").agg(F.map_from_entries(F.collect_list(F.struct("year", "p"))).alias("_p"))
    at = F.array(*map(F.lit, years)) if years else F.array().cast("array<int>")
    mapped = regions.select("geo", "longitude", "latitude").join(by_geo, "geo")
    listed = F.lit(True)
    if ends is not None:
        mapped = mapped.join(ends.select("geo", F.lit(True).alias("_listed")).distinct(), "geo", "left")
        listed = F.coalesce("_listed", F.lit(False))
    mapped = mapped.select("geo", "longitude", "latitude", F.transform(at, lambda y: F.try_element_at("_p", y)).alias("p"), F.transform(at, lambda y: F.map_contains_key("_p", y).cast("tinyint")).alias("there"), listed.alias("listed"))
    return _ranked(mapped), years, [r["total"] for r in found]


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:  # noqa: ANN003
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type, from_pandas=True) for k, c in columns.items()], schema=schema)


def _same(value: object, kind: pa.DataType, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def region_distances(regions: DataFrame) -> DataFrame:
    """i, j, dist of all ordered pairs of regions, as mobility.pairwise_distance has them. regions: geo (one row of each), longitude, latitude."""
    schema = pa.schema([("i", pa.string()), ("j", pa.string()), ("dist", pa.float64())])

    def work(whole: _Map, block: int) -> Iterator[pa.RecordBatch]:
        for a, here in whole.groups(whole.dealt(block, blocks)):
            dist = whole.distances(a)[whole.place]
            for o in here:
                yield _batch(schema, i=_same(whole.geo[o].as_py(), pa.string(), len(dist) - 1), j=pa.concat_arrays([whole.geo[:o], whole.geo[o + 1 :]]), dist=np.delete(dist, o))

    none = F.array().cast("array<double>")
    ranked = _ranked(regions.filter("geo is not null").select("geo", "longitude", "latitude", none.alias("p"), none.alias("there"), F.lit(True).alias("listed")))
    blocks = _blocks(ranked)
    return _by_blocks(ranked, blocks, [], "i string, j string, dist double", work)


def region_flux(regions: DataFrame, population: DataFrame, columns: Sequence[str] = ("dist", "prob", "prob_rescaled", "flux"), ends: DataFrame | None = None) -> DataFrame:
    """year, i, j and columns of mobility.radiation_flux over all pairs of regions, distances compared in units of 1e-9 km.

    regions: geo, longitude, latitude; population: geo, year, population; one row for each
    region, and for each region and year. ends (geo): only pairs of two of these are given;
    all regions still count as nearer ones.
    """
    ranked, years, totals = _with_years(regions, population, ends)
    limited = ends is not None
    blocks = _blocks(ranked)
    schema = pa.schema([("year", pa.int32()), ("i", pa.string()), ("j", pa.string()), *((c, pa.float64()) for c in columns)])

    def work(whole: _Map, block: int) -> Iterator[pa.RecordBatch]:
        origins = whole.dealt(block, blocks)
        for o, t, to, names, prob, m, d in whole.fluxes(origins[whole.listed[origins]]):
            if limited:
                at = np.flatnonzero(whole.listed[to])
                to, prob, names = to[at], prob[at], names.take(pa.array(at))
            values = {"dist": lambda: d[whole.place[to]], "prob": lambda: prob, "flux": lambda: 0.9 * m * prob, "prob_rescaled": lambda: np.where(prob == 0, 0.0, prob / (1 - m / totals[t] if m != totals[t] else 1.0))}
            yield _batch(schema, year=_same(years[t], pa.int32(), len(to)), i=_same(whole.geo[o].as_py(), pa.string(), len(to)), j=names, **{c: values[c]() for c in columns})

    return _by_blocks(ranked, blocks, years, "year int, i string, j string, " + ", ".join(f"{c} double" for c in columns), work)


def region_flux_totals(regions: DataFrame, population: DataFrame) -> DataFrame:
    """mobility.flux_totals of region_flux: a block sums its origins' fluxes by destination, so that no pair leaves its task.

    Beyond its own place, an origin's flux is 0.9 m m n / (upto before * upto after), where
    upto is the same for all origins of the place: their m m are added up before.
    """
    ranked, years, _ = _with_years(regions, population)
    blocks = _blocks(ranked)
    met = ranked.agg(*(F.sum(F.get("there", F.lit(t))) for t in range(len(years)))).first() if years else ()
    sums = [f"{way}_{t}" for way in ("out", "into") for t in range(len(years))]
    schema = pa.schema([("geo", pa.string()), *((c, pa.float64()) for c in sums)])

    def work(whole: _Map, block: int) -> Iterator[pa.RecordBatch]:
        out, into, n = np.zeros(whole.there.shape), np.zeros(whole.there.shape), whole.counted
        there, upto, under = np.empty((3, len(whole.place)))  # written over for each place
        for a, here in whole.groups(whole.dealt(block, blocks, sums=True)):
            order, head, _ = whole.nearest_first(a, whole.distances(a))
            near, far = order[:head], order[head:]
            ahead = np.zeros((len(years), head))
            weight = 0.9 * (n[:, here] * n[:, here]).sum(axis=1)
            for t in np.flatnonzero(weight):
                np.take(n[t], order, out=there, mode="clip")
                np.cumsum(there, out=upto)
                ahead[t, 1:] = upto[: head - 1]
                share = np.multiply(upto[head - 1 : -1], upto[head:], out=under[head:])
                with np.errstate(invalid="ignore", divide="ignore"):
                    np.divide(there[head:], share, out=share)
                if not upto[head - 1] > 0:  # a factor may be 0
                    share[(upto[head - 1 : -1] == 0) | (upto[head:] == 0)] = 0.0
                out[t, here] += 0.9 * n[t, here] * n[t, here] * share.sum()
                share *= weight[t]
                into[t, far] += share
            for o in here if head > 1 else []:
                m, p = n[:, o, None], int(np.flatnonzero(near == o)[0])
                least = ahead.copy()
                least[:, :p] += m
                product = least * (least + n[:, near])
                with np.errstate(invalid="ignore", divide="ignore"):
                    flux = 0.9 * m * np.where(product == 0, 0.0, m * n[:, near] / product)
                flux[:, p] = 0.0
                into[:, near] += flux
                out[:, o] += flux.sum(axis=1)
        known = ~np.isnan(whole.population)
        alone = known.sum(axis=1, keepdims=True) < 2  # a sum without any known flux is null
        out[~known | alone], into[~known | alone] = np.nan, np.nan
        yield _batch(schema, geo=whole.geo, **dict(zip(sums, (*out, *into), strict=True)))

    each = _by_blocks(ranked, blocks, years, "geo string" + "".join(f", {c} double" for c in sums), work).groupBy("geo").agg(F.count("*").alias("_blocks"), *(F.sum(c).alias(c) for c in sums))
    of_year = lambda t: F.struct(F.lit(years[t]).alias("year"), F.get("there", F.lit(t)).alias("there"), F.col(f"out_{t}").alias("out"), F.col(f"into_{t}").alias("into"))
    by_year = F.array(*(of_year(t) for t, n in enumerate(met) if n and n > 1)).cast("array<struct<year: int, there: tinyint, out: double, into: double>>")
    rows = each.join(ranked.select("geo", "there"), "geo").select("geo", F.explode(by_year).alias("e")).filter("e.there = 1")
    return rows.select("e.year", "geo", F.col("e.out").alias("total_flux_out"), F.col("e.into").alias("total_flux_in"), (F.col("e.out") - F.col("e.into")).alias("net_flux_out"))


class _Tile:
    """Links between two slices of regions in the order of their places: one for each pair and year, with the larger flux of both ways."""

    def __init__(self, whole: _Map, a: np.ndarray, b: np.ndarray):
        self.whole, self.a, self.b = whole, a, b
        n = len(whole.place)  # written over for each place
        self.places, self.at, self.n, self.sums = np.arange(n), np.empty(n, np.int64), np.empty(n), np.zeros(n + 1)

    def upto(self, place: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Populations before each of ends in the order of a place, by year, and whether ends lie nearer (-1), as near (0) or farther."""
        order, _, side = self.whole.nearest_first(place, self.whole.distances(place))
        self.at[order] = self.places
        before = self.at[ends]
        found = np.empty((len(self.whole.there), len(ends)))
        for t, n in enumerate(self.whole.counted):
            np.take(n, order, out=self.n, mode="clip")
            np.cumsum(self.n, out=self.sums[1:])
            np.take(self.sums, before, out=found[t], mode="clip")
        return found, side[self.whole.place[ends]].astype(np.int8)

    @staticmethod
    def flux(m: np.ndarray, n: np.ndarray, before: np.ndarray, first: np.ndarray | None) -> np.ndarray:
        """first: where the destination comes before the origin in the origin's order, so that the origin isn't among those before it."""
        least = before if first is None else np.where(first, before + m, before)
        under = least * (least + n)
        with np.errstate(invalid="ignore", divide="ignore"):
            return 0.9 * m * np.where(under == 0, 0.0 * m, m * n / under)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Year's places, ends, other ends and fluxes, for one end of b after the other."""
        w, a, b = self.whole, self.a, self.b
        places, of = np.unique(w.place[a], return_inverse=True)
        before, side = np.empty((len(b), len(w.there), len(places))), np.empty((len(b), len(places)), np.int8)
        for k, place in enumerate(places):
            sums, side[:, k] = self.upto(place, b)
            before[:, :, k] = sums.T
        close = (side <= 0).any(axis=1)
        k = 0
        for place, here in w.groups(b):
            back, back_side = self.upto(place, a)
            back_close = bool((back_side <= 0).any())
            for j in here:
                to = slice(0, k if a is b else len(a))
                i, m, n = a[to], w.population[:, a[to]], w.population[:, j, None]
                first = lambda s, less: (s < 0) | ((s == 0) & less)
                out = self.flux(m, n, before[k][:, of[to]], first(side[k, of[to]], j < i) if close[k] else None)
                back_flux = self.flux(n, m, back[:, to], first(back_side[to], i < j) if back_close else None)
                t, at = np.nonzero(w.there[:, i] & w.there[:, j, None])
                yield t, i[at], np.full(len(at), j), np.fmax(out, back_flux)[t, at]
                k += 1


def _tiled(regions: DataFrame, population: DataFrame, ends: DataFrame | None, schema: str, work: Callable[[list[int], Iterator, _Map], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What work gives for years, links (of some 100,000 at a time) and the map of each task's tiles."""
    ranked, years, _ = _with_years(regions, population, ends)
    listed, places = ranked.filter("listed").agg(F.count("*"), F.count_distinct(F.struct("longitude", "latitude"))).first()
    pieces = max(1, math.ceil(math.sqrt(listed * places * 8 * max(1, len(years)) / TILE_BYTES)), min(-(-listed // BLOCK), TILE_BLOCKS))
    tiles = [(x, y) for x in range(pieces) for y in range(x, pieces)]
    tasks = min(len(tiles), _most(ranked))

    def each(whole: _Map, task: int) -> Iterator[pa.RecordBatch]:
        cuts = np.array_split(whole.by_place[whole.listed[whole.by_place]], pieces)

        def some() -> Iterator[list[np.ndarray]]:
            held, n = [], 0
            for x, y in tiles[task::tasks]:
                for links in _Tile(whole, cuts[x], cuts[y]).links():
                    held.append(links)
                    n += len(links[0])
                    if n >= 100_000:
                        yield [np.concatenate(c) for c in zip(*held, strict=True)]
                        held, n = [], 0
            if n:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]

        yield from work(years, some(), whole)

    return _by_blocks(ranked, tasks, years, schema, each)


def region_links(regions: DataFrame, population: DataFrame, ends: DataFrame | None = None, above: float | None = None, strict: bool = True) -> DataFrame:
    """year, i, j, flux: mobility.flux_matrix_to_edges of region_flux, undirected, made without shuffling a pair.

    ends (geo): only links between two of these are given; all regions still count as nearer
    ones. above: only links with more flux than this (or not less).
    """
    schema = pa.schema([("year", pa.int32()), ("i", pa.string()), ("j", pa.string()), ("flux", pa.float64())])

    def work(years: list[int], links: Iterator, whole: _Map) -> Iterator[pa.RecordBatch]:
        for t, i, j, flux in links:
            if above is not None:
                kept = flux > above if strict else flux >= above
                t, i, j, flux = t[kept], i[kept], j[kept], flux[kept]
            yield _batch(schema, year=np.array(years, np.int32)[t], i=whole.geo.take(pa.array(np.minimum(i, j))), j=whole.geo.take(pa.array(np.maximum(i, j))), flux=flux)

    return _tiled(regions, population, ends, "year int, i string, j string, flux double", work)


def _bins(x: np.ndarray) -> np.ndarray:
    """A whole number of 24 bits that rises with x: its sign, exponent and 12 binary digits."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ 0x7FFFFFFFFFFFFFFF, bits) >> 40


def _counted(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(x, return_inverse=True)
    return values, np.bincount(at, m, len(values)).astype(np.int64)


def link_quantiles(regions: DataFrame, population: DataFrame, shares: Sequence[float], ends: DataFrame | None = None) -> list[float | None]:
    """Interpolated quantiles of region_links' fluxes, exactly: links are counted in their tasks by leading bits, then by value in the few bins that hold the ranks asked for."""

    def counts(of: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
        schema = pa.schema([("x", pa.int64() if kind == "long" else pa.float64()), ("m", pa.int64())])

        def work(years: list[int], links: Iterator, whole: _Map) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for *_, flux in links:
                values, m = np.unique(of(flux[~np.isnan(flux)] + 0.0), return_counts=True)
                held.append((values, m))
                n += len(values)
                if n > 4_000_000:
                    held = [_counted(*map(np.concatenate, zip(*held, strict=True)))]
                    n = 0
            if held:
                values, m = _counted(*map(np.concatenate, zip(*held, strict=True)))
                for k in range(0, len(values), 100_000):
                    yield _batch(schema, x=values[k : k + 100_000], m=m[k : k + 100_000])

        found = _tiled(regions, population, ends, f"x {kind}, m long", work).groupBy("x").agg(F.sum("m").alias("m"))
        return cut(running(found, [], F.col("x"), upto="m"))

    bins = counts(_bins, "long")
    n = bins.agg(F.max("upto")).first()[0]
    if not n:
        return [None] * len(shares)
    ranks = [((n - 1) * q, int((n - 1) * q), min(int((n - 1) * q) + 1, n - 1)) for q in shares]
    wanted = sorted({r for _, *lo_hi in ranks for r in lo_hi})
    holds = lambda start: F.exists(F.array(*map(F.lit, wanted)), lambda r: (r >= start) & (r < start + F.col("m")))
    ahead = {r["x"]: r["upto"] - r["m"] for r in bins.filter(holds(F.col("upto") - F.col("m"))).collect()}
    some = np.array(sorted(ahead))
    values = counts(lambda x: x[np.isin(_bins(x), some)], "double")
    # ranks among the values of the bins alone
    sizes = {r["x"]: r["m"] for r in bins.filter(F.col("x").isin([int(x) for x in some])).collect()}
    left, place = 0, {}
    for x in map(int, some):
        place |= {r: r - ahead[x] + left for r in wanted if ahead[x] <= r < ahead[x] + sizes[x]}
        left += sizes[x]
    inside = F.exists(F.array(*(F.lit(place[r]) for r in wanted)), lambda r: (r >= F.col("upto") - F.col("m")) & (r < F.col("upto")))
    rows = values.filter(inside).collect()
    at = {r: next(row["x"] for row in rows if row["upto"] - row["m"] <= place[r] < row["upto"]) for r in wanted}
    return [at[lo] + (q - lo) * (at[hi] - at[lo]) for q, lo, hi in ranks]


def _by_year_and_bin(key: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], np.add.reduceat(m[order], starts), np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def region_link_strength(regions: DataFrame, population: DataFrame, digits: int = 6) -> DataFrame:
    """year, i, j, flux, strength: mobility.link_strength_percentile of region_links by year, fluxes compared to some digits.

    Links are counted in their tasks by year and leading bits. Bins make ranges of about RANGE
    links, whose links meet in one exchange and are counted along; what lies below a range is
    known. A flux that fills a range by itself needs no counting along, and its links are spread.
    """
    size = lambda flux: np.where(np.isnan(flux), -np.inf, np.rint(np.abs(flux) * 10.0**digits) / 10.0**digits)
    key = lambda t, x: (np.asarray(t, np.int64) << 24) + _bins(x) + (1 << 23)
    schema = pa.schema([("key", pa.int64()), ("m", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def counts(years: list[int], links: Iterator, whole: _Map) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t, _, _, flux in links:
            x = size(flux)
            held.append(_by_year_and_bin(key(t, x), np.ones(len(x), np.int64), x, x))
            n += len(held[-1][0])
            if n > 4_000_000:
                held, n = [_by_year_and_bin(*map(np.concatenate, zip(*held, strict=True)))], 0
        if held:
            found = _by_year_and_bin(*map(np.concatenate, zip(*held, strict=True)))
            for k in range(0, len(found[0]), 100_000):
                yield _batch(schema, **{c: v[k : k + 100_000] for c, v in zip(schema.names, found, strict=True)})

    bins = _tiled(regions, population, None, "key long, m long, low double, high double", counts).groupBy("key").agg(F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"))
    upto = cut(running(bins.withColumn("t", F.shiftright("key", 24).cast("int")), ["t"], F.col("key"), upto="m").withColumn("start", F.col("upto") - F.col("m")))
    most = max(RANGE, (upto.agg(F.sum("m")).first()[0] or 0) // RANGES)
    alone = F.when((F.col("low") == F.col("high")) & (F.col("m") > most), F.col("key"))
    ranges = sorted(upto.groupBy("t", F.floor(F.col("start") / most).alias("r"), alone.alias("alone")).agg(F.min("key").alias("key"), F.sum("m").alias("m"), F.min("start").alias("ahead")).collect(), key=lambda r: r["key"])
    whole_years = {r["t"]: r["n"] for r in upto.groupBy("t").agg(F.sum("m").alias("n")).collect()}
    firsts, single = np.array([r["key"] for r in ranges], np.int64), np.array([r["alone"] is not None for r in ranges], bool)
    link = pa.schema([("part", pa.int64()), ("i", pa.string()), ("j", pa.string()), ("flux", pa.float64()), ("size", pa.float64())])

    def work(years: list[int], links: Iterator, whole: _Map) -> Iterator[pa.RecordBatch]:
        for t, i, j, flux in links:
            x = size(flux)
            part = np.searchsorted(firsts, key(t, x), side="right") - 1
            spread = np.where(single[part], (i + j) % 64, 0)
            yield _batch(link, part=part * 64 + spread, i=whole.geo.take(pa.array(np.minimum(i, j))), j=whole.geo.take(pa.array(np.maximum(i, j))), flux=flux, size=x)

    links = _tiled(regions, population, None, "part long, i string, j string, flux double, size double", work)
    along = links.withColumn("along", F.count("*").over(Window.partitionBy("part").orderBy("size"))).withColumn("k", F.shiftright("part", 6))
    years = sorted(r["year"] for r in population.filter("year is not null").select(F.col("year").cast("int").alias("year")).distinct().collect())
    known = regions.sparkSession.createDataFrame([(k, years[r["t"]], r["ahead"], r["m"] if r["alone"] is not None else None, whole_years[r["t"]]) for k, r in enumerate(ranges)], "k long, year int, ahead long, all long, n long")
    return along.join(F.broadcast(known), "k").select("year", "i", "j", "flux", ((F.col("ahead") + F.coalesce("all", "along")) / F.col("n")).alias("strength"))
