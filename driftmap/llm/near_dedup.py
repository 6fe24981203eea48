"""MinHash near-dedup with circulant signatures.

One permutation of 32-bit integers scatters the shingles, a second one is shifted in a
circle once for each coordinate of the signature: h_k(S) = min over x in S of
pi((sigma(x) + k * step) mod 2^32). Bands of the signature give candidates; links are
confirmed on the full shingle sets.

Copies with equal sets are one class. In each bucket every class is held against the
least one first; components of those links follow. In buckets that still hold several,
classes outside the largest component are held against one of its members, which hashing
picks. What is left is gone through in full: classes outside a bucket's largest component
against all others, in blocks of bounded size that carry the sets and give one confirmed
link for each class and component it meets. So no link across components is lost, and
none inside one is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm import words as w
from driftmap.llm.components import components
from driftmap.llm.tables import discard, settle

SHINGLE = 5
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
PERCENT = 75
#: Classes of one side of a block.
BLOCK = 256
#: Pairs that one copy of a class's set serves, and how many classes are copied at most.
COPY_PAIRS, MAX_HOT = 256, 10_000
_STEP = np.uint32(0x9E3779B1)


def _permute(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> None:
    """A fixed permutation of 32-bit integers, applied in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=out)
        if factor:
            np.multiply(out, np.uint32(factor), out=out)
        x = out


def shingle_sets(x: w.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes in order, and their number; a document of fewer words has its whole sequence."""
    h = x.hashes(w.LOWER_VALUE)
    at, g = w.grams(h, x.doc, k)
    d, n = x.doc[at], np.diff(x.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        g = np.concatenate([g, w.run_hash(h, x.first[short], x.first[short + 1])])
        d = np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], np.bincount(d[new], minlength=len(n)).astype(np.int64)


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of COORDINATES minima for each nonempty set."""
    starts = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
    out = np.empty((len(starts), COORDINATES), np.uint32)
    if not len(starts):
        return out
    sigma = (values >> np.uint64(32)).astype(np.uint32)
    tmp, y = np.empty_like(sigma), np.empty_like(sigma)
    _permute(sigma, sigma, tmp)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            np.add(sigma, np.uint32(k) * _STEP, out=y)
            _permute(y, y, tmp)
            out[:, k] = np.minimum.reduceat(y, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = w.mix(h ^ w.mix(sig.reshape(-1, BANDS, ROWS)[:, :, r].astype(np.uint64) + np.uint64(r + 1)))
    return h


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, x in w.batches(b.column("text")):
            values, counts = shingle_sets(x)
            some = counts > 0
            ends = np.cumsum(counts)
            starts = ends - counts
            a = w.signed(w.run_hash(values, starts, ends))
            c = w.signed(w.run_hash(w.mix(values), starts, ends))
            keys = band_keys(signatures(values, counts))
            empty = ~some
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).slice(lo, hi - lo) for k in ("doc_id", "ta", "tb")), pa.array(counts), pa.array(a, mask=empty), pa.array(c, mask=empty), w.list_array(pa.array(w.signed(keys.ravel())), np.where(some, BANDS, 0))],
                ["doc_id", "ta", "tb", "n", "a", "c", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("id")
        for lo, _, x in w.batches(b.column("text")):
            values, counts = shingle_sets(x)
            sig = signatures(values, counts)
            where = np.flatnonzero(counts > 0)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(where + lo)), w.list_array(pa.array(w.signed(values)), counts[where]), pa.array([row.tobytes() for row in sig], pa.binary())],
                ["id", "shingles", "sig"],
            )


def _links(block: pa.Table) -> pa.Table:
    """Confirmed links across components of one block: one for each asking class and component.

    A pair is looked at in the first band that it shares, so once in all.
    """
    ids, comp, role, band = (block.column(c).to_numpy() for c in ("id", "component", "role", "band"))
    sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    lists = block.column("shingles").combine_chunks()
    edge, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    told = np.flatnonzero(role == 1)
    us, vs = [], []
    for i in np.flatnonzero(role == 0):
        rest = told[comp[told] != comp[i]]
        same = sig[rest] == sig[i]
        first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]
        rest = rest[first]
        if not len(rest):
            continue
        mine, size = values[edge[i] : edge[i + 1]], edge[rest + 1] - edge[rest]
        shared = np.isin(w.ragged(values, edge[rest], size), mine)
        both = np.add.reduceat(shared, np.cumsum(size) - size, dtype=np.int64)
        near = rest[100 * both >= PERCENT * (size + len(mine) - both)]
        near = near[np.unique(comp[near], return_index=True)[1]]
        us.append(np.full(len(near), ids[i]))
        vs.append(ids[near])
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _similar(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * both >= PERCENT * (F.size(a) + F.size(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose full sets are similar. The set of a class that many pairs have as u is given in several copies, for at most MAX_HOT classes."""
    pairs = settle(pairs, "pairs")
    many = pairs.groupBy("u").agg(F.count("*").alias("n")).filter((F.col("n") > COPY_PAIRS) & (F.col("n") * MAX_HOT > pairs.count()))
    many = F.broadcast(settle(many.select("u", F.ceil(F.col("n") / COPY_PAIRS).cast("int").alias("copies")), "hot"))
    copies = F.coalesce("copies", F.lit(1))
    asked = pairs.join(many, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), copies).cast("int").alias("copy"))
    left = asked.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v")
    given = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")).join(many, "u", "left").select("u", "su", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    return left.join(given, ["u", "copy"]).filter(_similar(F.col("su"), F.col("sv"))).select("u", "v").distinct()


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with several components, with their component, the bucket's largest one (main), and its blocks."""
    labels = found.withColumnRenamed("node", "id")
    placed = members.select("key", "band", "id").distinct().join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    of = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    of = of.select("key", F.col("top.component").alias("main"), F.ceil((F.col("m") - F.col("top.m")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK).cast("int").alias("cols"))
    return placed.join(of, "key")


def _judged(docs: DataFrame) -> DataFrame:
    """near_duplicates, with the key of each row's text (ta, tb)."""
    text = F.col("text").cast("string")
    keys = [F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(6), text, F.length(text)).alias("tb")]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *keys)
    scan = settle(base.mapInArrow(_scan, "doc_id bigint, ta bigint, tb bigint, n bigint, a bigint, c bigint, bands array<bigint>"), "sketches")
    linkable = scan.filter("n > 0 and doc_id is not null")
    # a class is named by a number of its own, as rows of one doc_id may be of several classes
    classes = linkable.groupBy("a", "c").agg(F.min(F.struct("doc_id", "ta", "tb")).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    members = settle(buckets.join(shared.select("key", "hub"), "key"), "members")
    pairs = members.filter("id <> hub.id").filter(f"100 * least(n, hub.n) >= {PERCENT} * greatest(n, hub.n)").select(F.col("hub.id").alias("u"), F.col("id").alias("v")).distinct()
    asked = classes.select("id", "row.doc_id", "row.ta", "row.tb").join(members.select("id").distinct(), "id", "left_semi")
    texts = base.join(asked, ["doc_id", "ta", "tb"]).groupBy("id").agg(F.first("text").alias("text"))
    sets = settle(texts.mapInArrow(_full_sets, "id bigint, shingles array<bigint>, sig binary"), "sets")
    first = settle(_confirm(pairs, sets), "links")
    found = components(first)
    inside = settle(_mixed(members, found), "mixed")
    hub = inside.filter("component = main").groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id")).alias("u"))
    tried = inside.filter("component <> main").join(hub, "key").select("u", F.col("id").alias("v")).distinct()
    second = settle(first.unionByName(_confirm(tried, sets)), "links")
    discard(inside, found)
    found = components(second)
    inside = settle(_mixed(members, found), "mixed")
    number, cells = F.xxhash64("id"), ("key", "band", "id", "component")
    asks = inside.filter("component <> main").select(*cells, F.lit(0).alias("role"), F.pmod(number, F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    told = inside.select(*cells, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(number, F.col("cols")).cast("int").alias("j"))
    blocks = asks.unionByName(told).join(sets, "id")
    last = components(second.unionByName(blocks.groupBy("key", "i", "j").applyInArrow(_links, "u bigint, v bigint")))
    placed = classes.select("a", "c", "id", F.col("row.doc_id").alias("least")).join(last.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = settle(placed.join(least, "component").select("a", "c", "component_id"), "placed")
    discard(members, sets, first, second, inside, found, last, classes)
    linked = linkable.select("doc_id", "ta", "tb", "n", "a", "c").join(by_class, ["a", "c"], "left")
    alone = scan.filter("n = 0 or doc_id is null").select("doc_id", "ta", "tb", "n", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "ta", "tb", "n", "component_id").unionByName(alone)
    return out.select("doc_id", "ta", "tb", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with a
    null doc_id are linked with nothing and kept. Rows that share a doc_id are each judged
    by their own text, and may be of different components. Other columns are ignored.
    """
    return _judged(docs).drop("ta", "tb")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one of each component; of rows equal in doc_id and text, all stay."""
    gone = _judged(docs).filter("not kept").select(F.col("doc_id").alias("_gone"), F.col("ta").alias("_ta"), F.col("tb").alias("_tb")).distinct()
    text = F.col("text").cast("string")
    same = (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(text) == gone["_ta"]) & (F.xxhash64(F.lit(6), text, F.length(text)) == gone["_tb"])
    return docs.join(gone, same, "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 75 * (x.n + y.n - m)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.node = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.node) AS component_id, d.doc_id = min(r.node) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, n.n
"""
