"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are fixed-point numbers x. With X the centred rows, each step multiplies in both
directions in one pass over the rows: p = X q, then X' p. q is the next right vector less what
its image has in common with the left vectors so far; a left vector is kept as the combination
of columns that makes it, u = X a, so that orthogonalising against all of them needs no table
of n rows for each step. Right vectors are orthogonalised against all earlier ones, twice.
A step whose image vanishes gets the diagonal entry 0, and where a right vector vanishes a new
random one goes on, so all directions are gone through, also those of equal deviations.
The SVD of the small bidiagonal matrix gives components and deviations.

The driver holds vectors as long as the rows are wide. What a pass returns is added up by
dimension in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.llm import words as w
from driftmap.llm.tables import settle

COMPONENTS = 8
#: x is floor(SCALE * entry) + OFFSET (fixed values).
SCALE, OFFSET = 1024, 100_000
#: Rows of a stored block.
BLOCK = 4096
SEED = 11
#: Entries beyond this size have no exact x and count as not finite.
_LARGE = float(1 << 40)


def _valid(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places, lengths and first entries of the rows without nulls, infinities, NaN or entries beyond _LARGE, of the given length if one is given."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values
    flat = values.to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        good = np.abs(flat) <= _LARGE
    bad = np.concatenate([[0], np.cumsum(~good)])
    ok = ~lists.is_null().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    size = np.diff(offsets)
    at = np.flatnonzero(ok & (size > 0) & ((size == width) if width else True))
    return at, size[at], offsets[at]


def _widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, n = np.unique(_valid(b.column("vec"))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int64)), pa.array(n.astype(np.int64))], ["width", "n"])


def _stored(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, _, start = _valid(b.column("vec"), width)
        flat = b.column("vec").values
        for lo in range(0, len(at), BLOCK):
            here = at[lo : lo + BLOCK]
            rows = flat.take(pa.array(w.ragged(np.arange(len(flat)), start[lo : lo + BLOCK], np.full(len(here), width)))).to_numpy(zero_copy_only=False)
            x = np.floor(rows.astype(np.float64) * SCALE).astype(np.int64).reshape(-1, width) + OFFSET
            small = np.abs(x).max() < 1 << 31
            yield pa.RecordBatch.from_arrays(
                [
                    w.list_array(b.column("id").take(pa.array(here)), np.array([len(here)])),
                    pa.array([x.astype(np.int32 if small else np.int64).tobytes()], pa.binary()),
                    w.list_array(pa.array(x.sum(0)), np.array([width])),
                ],
                ["ids", "x", "sums"],
            )


def _rows(b: pa.RecordBatch, i: int, width: int) -> np.ndarray:
    data, n = b.column("x")[i].as_buffer(), len(b.column("ids")[i].values)
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * width else np.int64).reshape(n, width)


def _placed(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values.astype(np.float64))], ["place", "value"])


class Centre(NamedTuple):
    """The number of rows and their exact sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the whole part of the mean goes before x becomes a double."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])


def _squares(batches: Iterator[pa.RecordBatch], centre: Centre) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(centre.sums))
    for b in batches:
        for i in range(len(b)):
            total += np.square(centre.centred(_rows(b, i, len(total)))).sum(0)
    yield _placed(total)


def _products(batches: Iterator[pa.RecordBatch], centre: Centre, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """X'(Xq) of the partition, and after it the sum of squares of Xq."""
    total = np.zeros(len(q) + 1)
    for b in batches:
        for i in range(len(b)):
            c = centre.centred(_rows(b, i, len(q)))
            p = c @ q
            total[:-1] += p @ c
            total[-1] += p @ p
    yield _placed(total)


def _moments(batches: Iterator[pa.RecordBatch], centre: Centre, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and products of the whitened values."""
    k = axes.shape[1]
    total = np.zeros((k + 1, k))
    for b in batches:
        for i in range(len(b)):
            y = centre.centred(_rows(b, i, len(axes))) @ axes
            total[0] += y.sum(0)
            total[1:] += y.T @ y
    yield _placed(total.ravel())


def _summed(blocks: DataFrame, f, length: int) -> np.ndarray:
    found = blocks.mapInArrow(f, "place bigint, value double").groupBy("place").agg(F.sum("value")).collect()
    out = np.zeros(length)
    for place, value in found:
        out[place] = value
    return out


def bidiagonalise(product, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The upper bidiagonal B and the right vectors V (as columns) of XV = UB, in width steps.

    product(q) gives X'(Xq) and the sum of squares of Xq.
    """
    rng = np.random.default_rng(seed)
    v = np.zeros((width, width))
    made: list[np.ndarray] = []  # a of each left vector u = Xa
    back: list[np.ndarray] = []  # X'u
    bidiagonal = np.zeros((width, width))
    largest, eps = 0.0, np.finfo(float).eps

    def fresh(j: int) -> np.ndarray:
        while True:
            x = rng.standard_normal(width)
            for _ in range(3):
                x -= v[:, :j] @ (v[:, :j].T @ x)
            if (size := np.linalg.norm(x)) > 1e-3:
                return x / size

    v[:, 0] = fresh(0)
    for j in range(width):
        q = v[:, j].copy()
        for a, z in zip(made, back, strict=True):
            q -= (z @ v[:, j]) * a
        z, square = product(q)
        left = np.array(made).reshape(len(made), width)
        for _ in range(2):  # what the products leave of earlier left vectors
            shared = left @ z
            q = q - shared @ left
            z = z - shared @ np.array(back).reshape(len(back), width)
            square -= shared @ shared
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= 64 * width * eps * largest or not z.any():
            alpha, z = 0.0, np.zeros(width)
        else:
            made.append(q / alpha)
            back.append(z / alpha)
            z = z / alpha
        bidiagonal[j, j] = alpha
        largest = max(largest, alpha)
        if j + 1 == width:
            break
        r = z - alpha * v[:, j]
        for _ in range(2):
            r -= v[:, : j + 1] @ (v[:, : j + 1].T @ r)
        beta = np.linalg.norm(r)
        if beta <= 64 * width * eps * largest:
            v[:, j + 1] = fresh(j + 1)
        else:
            bidiagonal[j, j + 1] = beta
            largest = max(largest, beta)
            v[:, j + 1] = r / beta
    return bidiagonal, v


class Fit(NamedTuple):
    """Exact sums, axes (components over deviations, as columns), shares of the variance, the largest error of the identity."""

    centre: Centre
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of positive deviation of all stored rows, largest first; None where there are none."""
    sums = blocks.select(F.posexplode("sums").alias("place", "s"), F.size("ids").alias("n")).groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("place").collect()
    if not sums:
        return None
    centre = Centre(int(sums[0]["n"]), tuple(int(r["s"]) for r in sums))
    width, x = len(sums), blocks.select("ids", "x")
    total = _summed(x, partial(_squares, centre=centre), width).sum()
    if not total > 0:
        return None

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        found = _summed(x, partial(_products, centre=centre, q=q), width + 1)
        return found[:-1], float(found[-1])

    bidiagonal, v = bidiagonalise(product, width)
    _, sigma, right = np.linalg.svd(bidiagonal)
    keep = int((sigma[:components] > 1e-7 * sigma[0]).sum())
    axes = v @ right[:keep].T
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(keep)])
    axes *= np.sqrt(centre.n) / sigma[:keep]
    moments = _summed(x, partial(_moments, centre=centre, axes=axes), (keep + 1) * keep).reshape(keep + 1, keep) / centre.n
    error = np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(keep)).max()
    return Fit(centre, axes, sigma[:keep] ** 2 / total, float(error))


def _deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """Exact sums of (n * x - S)^2; null where one is no long."""
    most = max(centre.n * int(np.abs(x).max()), max(map(abs, centre.sums)))
    if (2 * most) ** 2 * x.shape[1] < 1 << 63:
        return pa.array(np.square(centre.n * x.astype(np.int64) - np.array(centre.sums, np.int64)).sum(1))
    exact = ((centre.n * x.astype(object) - np.array(centre.sums, object)) ** 2).sum(1)
    return pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64())


def _whitened(batches: Iterator[pa.RecordBatch], fitted: Fit) -> Iterator[pa.RecordBatch]:
    k = fitted.axes.shape[1]
    for b in batches:
        for i in range(len(b)):
            x, ids = _rows(b, i, len(fitted.axes)), b.column("ids")[i].values
            take = np.repeat(np.arange(len(ids)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(take)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(np.full(len(take), fitted.centre.n)),
                    _deviations(x, fitted.centre).take(pa.array(take)),
                    pa.array((fitted.centre.centred(x) @ fitted.axes).ravel()),
                    pa.array(np.tile(fitted.explained, len(ids))),
                    pa.array(np.full(len(take), fitted.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component.

    Rows go whose vector is null, empty, or holds a null, infinite or NaN entry, or one beyond
    2^40. Vectors must have one length: rows of another than the most common one go as well
    (of lengths equally common the greatest counts). Components without variance are left
    out, so equal vectors, a single row and an empty table give no rows. Of components with
    equal deviation any basis may come. deviation is null where it is no long. Repeated rows
    count as often as they come; ids may be null or repeated; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    width = rows.select("vec").mapInArrow(_widths, "width bigint, n bigint").groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    out = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if width is None:
        return spark.createDataFrame([], out)
    blocks = settle(rows.mapInArrow(partial(_stored, width=width["width"]), T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("x", T.BinaryType()), T.StructField("sums", T.ArrayType(T.LongType()))])), "vectors")
    fitted = fit(blocks, components)
    if fitted is None:
        return spark.createDataFrame([], out)
    return blocks.select("ids", "x").mapInArrow(partial(_whitened, fitted=fitted), out)


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
