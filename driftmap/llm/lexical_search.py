"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of like size. A block is a table of bits, a row for each
place of its Bloom filters and a column for each document: a document sets PROBES rows for each
of its terms, and for each of LEVELS that the term's count in it reaches. The AND of a term's
rows is a bitmap of the documents that may have the term so often; it can only overestimate.
The sum over an item's terms and levels of these bitmaps, each weighted by what the score gains
at the level, bounds every document's score from above.

A search first scores the texts of the FIRST highest bounds exactly; the last of an item's
best among them is a floor. Every document whose bound reaches the floor is then scored exactly on its whole
text, so only documents that the bound excludes are left out, and the ranks are exact.

Items are taken in runs of at most RUN_ITEMS items and RUN_TERMS terms (one item may have
more); a run's terms and weights go to the tasks, so what is sent is bounded, and every run
meets all blocks of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmap.llm import words as w
from driftmap.llm.tables import discard, settle

TOP = 50
#: Counts of a term in a document that have bits of their own.
LEVELS = (1, 2, 3, 5, 9, 17)
#: Rows of a block for each element of its largest document, and rows that an element sets.
ROWS_PER_ELEMENT, PROBES = 12, 3
SLICE_BYTES = 4 << 20
RUN_ITEMS, RUN_TERMS = 256, 16_384
#: Documents of a block whose bounds are summed at once.
STRIPE = 256
#: Texts of an item that are scored for its floor, and those that a task names for it.
FIRST, NAMED = 400, 100
#: Parts of a hot text's copies.
SALTS = 64
_U = np.uint64
_DOC = "doc_id bigint, a bigint, b bigint"

#: Bytes of terms: ASCII letters and digits, and all bytes of other characters.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms_of(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, term hashes, their bounds by row) of each slice of a string column; A-Z are lower-cased."""
    for lo, hi, data, bounds in w.slices(column, limit):
        x = w.split(data, bounds, _TERM)
        yield lo, hi, x.hashes(w.LOWER_VALUE), x.first


def _counted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, term) of a slice in that order, with counts."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _places(h: np.ndarray, level: int, rows: int) -> np.ndarray:
    """The PROBES rows of each term at a level, one line for each term."""
    x = w.mix(h ^ w.mix(np.array([level + 1], _U)))
    step = (x >> _U(32)) | _U(1)
    return np.stack([((x + _U(i) * step) >> _U(11)) % _U(rows) for i in range(PROBES)], 1).astype(np.int64)


def _bits(row: np.ndarray, h: np.ndarray, tf: np.ndarray, rows: int, width: int) -> bytes:
    on = np.zeros((rows, width), np.uint8)
    for level, least in enumerate(LEVELS):
        some = tf >= least
        for place in _places(h[some], level, rows).T:
            on[place, row[some]] = 1
    return np.packbits(on, axis=1).tobytes()


_BLOCKS = "doc_ids array<bigint>, a array<bigint>, b array<bigint>, n array<bigint>, rows int, bits binary, terms array<bigint>, df array<bigint>"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, a, b = (batch.column(c) for c in ("doc_id", "a", "b"))
        for lo, _, h, first in terms_of(batch.column("text")):
            n = np.diff(first)
            row, term, tf = _counted(h, first)
            elements = np.zeros(len(n), np.int64)
            for least in LEVELS:
                elements += np.bincount(row[tf >= least], minlength=len(n))
            size = np.ceil(np.log2(np.maximum(elements, 8))).astype(np.int64)
            known, df = np.unique(term, return_counts=True)
            for k, s in enumerate(np.unique(size[n > 0])):
                docs = np.flatnonzero((size == s) & (n > 0))
                column = np.full(len(n), -1)
                column[docs] = np.arange(len(docs))
                mine = column[row] >= 0
                rows = ROWS_PER_ELEMENT * int(elements[docs].max())
                take = pa.array(docs + lo)
                pick = known if k == 0 else known[:0]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(w.list_array(c.take(take), np.array([len(docs)])) for c in (ids, a, b)),
                        w.list_array(pa.array(n[docs].astype(np.int64)), np.array([len(docs)])),
                        pa.array([rows], pa.int32()),
                        pa.array([_bits(column[row[mine]], term[mine], tf[mine], rows, len(docs))], pa.binary()),
                        w.list_array(pa.array(w.signed(pick)), np.array([len(pick)])),
                        w.list_array(pa.array(df[: len(pick)].astype(np.int64)), np.array([len(pick)])),
                    ],
                    ["doc_ids", "a", "b", "n", "rows", "bits", "terms", "df"],
                )


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(12), text, F.length(text)).alias("b"))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of every row of docs that has a term, as a table of blocks in the shared folder."""
    return settle(_texts(docs).filter("text is not null").mapInArrow(_index, _BLOCKS), "signatures")


class Run(NamedTuple):
    """A run of items: its distinct terms in order with their weights, and each item's terms as places in them."""

    terms: np.ndarray
    weights: np.ndarray
    members: np.ndarray
    first: np.ndarray
    n_docs: int
    n_terms: int

    def gain(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The part of a score that depends on a term's count and the document's length."""
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _frequencies(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(terms), np.int64)
    for b in batches:
        for lo in range(len(b)):
            h, df = (b.column(c)[lo].values.to_numpy(zero_copy_only=False) for c in ("terms", "df"))
            h = h.view(np.uint64)
            at = np.minimum(np.searchsorted(h, terms), max(len(h) - 1, 0))
            if len(h):
                total += np.where(h[at] == terms, df[at], 0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["t", "df"])


def _bounds(run: Run, n: np.ndarray, rows: int, bits: np.ndarray) -> np.ndarray:
    """The upper bounds of a block's documents, an item in each line."""
    sliced = bits.reshape(rows, -1)
    places = [_places(run.terms, level, rows) for level in range(len(LEVELS))]
    out = np.empty((len(run.first) - 1, len(n)), np.int64)
    most = [x - 1 for x in LEVELS[1:]]
    for lo in range(0, len(n), STRIPE):
        here = slice(lo // 8, (min(lo + STRIPE, len(n)) + 7) // 8)
        size = n[lo : lo + STRIPE]
        value = np.zeros((len(run.terms), len(size)), np.int64)
        live, before = np.arange(len(run.terms)), 0
        may = np.full((len(live), here.stop - here.start), 255, np.uint8)
        for level in range(len(LEVELS)):
            may = may & np.bitwise_and.reduce(sliced[places[level][live]][:, :, here], axis=1)
            some = may.any(1)
            live, may = live[some], may[some]
            if not len(live):
                break
            top = np.minimum(most[level], size) if level < len(most) else size
            gain = run.gain(top, size)
            value[live] += np.unpackbits(may, axis=1)[:, : len(size)] * (gain - before)
            before = gain
        value *= run.weights[:, None]
        out[:, lo : lo + STRIPE] = np.add.reduceat(value[run.members], run.first[:-1], axis=0)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, int, np.ndarray]]:
    for b in batches:
        for i in range(len(b)):
            ids = b.column("doc_ids")[i].values
            keys = [b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("a", "b")]
            yield [ids, *keys], b.column("n")[i].values.to_numpy(zero_copy_only=False), b.column("rows")[i].as_py(), np.frombuffer(b.column("bits")[i].as_buffer(), np.uint8)


def _hits(item: np.ndarray, ids: pa.Array, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), ids, pa.array(a), pa.array(b), pa.array(bound)], ["item", "doc_id", "a", "b", "bound"])


def _highest(batches: Iterator[pa.RecordBatch], run: Run) -> Iterator[pa.RecordBatch]:
    """For each item the texts of the NAMED highest bounds of the partition, each text once."""
    best: list[dict[tuple[int, int], int]] = [{} for _ in range(len(run.first) - 1)]
    floor = np.zeros(len(best), np.int64)
    for (_, a, b), n, rows, bits in _blocks(batches):
        bound = _bounds(run, n, rows, bits)
        for i in np.flatnonzero(bound.max(1) > floor):
            at = np.flatnonzero(bound[i] > floor[i])
            at = at[np.lexsort((b[at], a[at], -bound[i, at]))]
            found = best[i]
            for j in at:
                found[int(a[j]), int(b[j])] = int(bound[i, j])
                if len(found) > 2 * NAMED:
                    break
            if len(found) > NAMED:
                best[i] = dict(sorted(found.items(), key=lambda x: -x[1])[:NAMED])
                floor[i] = min(best[i].values())
    rows = [(i, *key, v) for i, found in enumerate(best) for key, v in found.items()]
    item, a, b, bound = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    yield _hits(item, pa.nulls(len(item), pa.int64()), a, b, bound)


def _reaching(batches: Iterator[pa.RecordBatch], run: Run, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    for (ids, a, b), n, rows, bits in _blocks(batches):
        item, at = np.nonzero(_bounds(run, n, rows, bits) >= np.maximum(floor, 1)[:, None])
        if len(at):
            yield _hits(item, ids.take(pa.array(at)), a[at], b[at], np.zeros(len(at), np.int64))


def _score(batches: Iterator[pa.RecordBatch], run: Run) -> Iterator[pa.RecordBatch]:
    """The exact score of each text for each item that asks for it."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1)
        batch = batch.take(pa.array(np.unique(keys, axis=0, return_index=True)[1]))
        asked = batch.column("items")
        for lo, hi, h, first in terms_of(batch.column("text")):
            row, term, tf = _counted(h, first)
            at = np.minimum(np.searchsorted(run.terms, term), len(run.terms) - 1)
            known = run.terms[at] == term
            width = len(run.terms)
            cell, tf = row[known] * width + at[known], tf[known]
            order = np.argsort(cell)
            cell, tf = cell[order], tf[order]
            lists = asked.slice(lo, hi - lo)
            item = lists.flatten().to_numpy()
            doc = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
            many = np.diff(run.first)[item]
            places = w.ragged(run.members, run.first[item], many)
            want = np.repeat(doc, many) * width + places
            score = np.zeros(len(want), np.int64)
            if len(cell):
                i = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
                some = np.flatnonzero(cell[i] == want)
                size = np.repeat(np.diff(first)[doc], many)
                score[some] = run.weights[places[some]] * run.gain(tf[i[some]], size[some])
            total = np.add.reduceat(score, np.cumsum(many) - many) if len(many) else score
            take = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([pa.array(item), batch.column("a").take(take), batch.column("b").take(take), pa.array(total)], ["item", "a", "b", "score"])


def _exact(texts: DataFrame, asked: DataFrame, run: Run) -> DataFrame:
    """item, a, b, score of each distinct text that asked names. Copies in a batch are scored once."""
    lists = asked.groupBy("a", "b").agg(F.collect_set("item").alias("items"))
    return texts.drop("doc_id").join(lists, ["a", "b"]).mapInArrow(partial(_score, run=run), "item bigint, a bigint, b bigint, score bigint").groupBy("item", "a", "b").agg(F.max("score").alias("score"))


def _first(df: DataFrame, k: int, *by: str, order: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= k)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, h, first in terms_of(b.column("text")):
            row, term, _ = _counted(h, first)
            yield pa.RecordBatch.from_arrays([b.column("item_id").slice(lo, hi - lo), w.list_array(pa.array(w.signed(term)), np.bincount(row, minlength=hi - lo))], ["item_id", "terms"])


def _runs(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, terms = [], []
    for r in items.toLocalIterator():
        if ids and (len(ids) >= RUN_ITEMS or sum(map(len, terms)) + len(r["terms"]) > RUN_TERMS):
            yield ids, terms
            ids, terms = [], []
        ids.append(r["item_id"])
        terms.append(np.array(r["terms"], np.int64).view(np.uint64))
    if ids:
        yield ids, terms


def _prepared(index: DataFrame, ids: list, terms: list[np.ndarray], n_docs: int, n_terms: int) -> tuple[list, Run] | None:
    """A run's weights, from document frequencies over the whole index. Terms that no document has and items left without terms go."""
    known = np.unique(np.concatenate(terms))
    df = np.zeros(len(known), np.int64)
    for t, n in index.select("terms", "df").mapInArrow(partial(_frequencies, terms=known), "t bigint, df bigint").groupBy("t").agg(F.sum("df")).collect():
        df[t] = n
    known, df = known[df > 0], df[df > 0]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    left = [(i, at) for i, t in zip(ids, terms, strict=True) if len(at := np.flatnonzero(np.isin(known, t)))]
    if not left:
        return None
    first = np.cumsum([0, *(len(at) for _, at in left)])
    return [i for i, _ in left], Run(known, weights, np.concatenate([at for _, at in left]), first, n_docs, n_terms)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item, by score and then by least doc_id.

    Null, empty and termless texts have no terms, are not counted and never found; such items
    find nothing. Every row of docs is a document, also where doc_ids repeat; a null doc_id
    comes last among equal scores. Items of equal item_id and equal sets of terms are one.
    Other columns are ignored; an empty table on either side gives no rows. top is at most TOP.
    """
    if not 0 < top <= TOP:
        raise ValueError(f"top must be 1 to {TOP}")
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = "item_id: " + kind.simpleString() + ", rank int, doc_id bigint, score bigint"
    index = build_index(docs)
    size = index.select(F.explode("n").alias("n")).agg(F.count("*"), F.sum("n")).first()
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_item_terms, f"item_id {kind.simpleString()}, terms array<bigint>")
    asked = settle(asked.filter("size(terms) > 0").distinct().orderBy("item_id", "terms"), "items")
    texts, results = _texts(docs), []
    for ids, terms in _runs(asked) if size[0] else ():
        found = _prepared(index, ids, terms, int(size[0]), int(size[1]))
        if found is None:
            continue
        ids, run = found
        high = index.select("doc_ids", "a", "b", "n", "rows", "bits").mapInArrow(partial(_highest, run=run), f"item bigint, {_DOC}, bound bigint")
        high = settle(_first(high, FIRST, "item", order=[F.desc("bound"), "a", "b"]).select("item", "a", "b"), "highest")
        best = _first(_exact(texts, F.broadcast(high), run).filter("score > 0"), top, "item", order=[F.desc("score")])
        floor = np.zeros(len(ids), np.int64)
        for r in best.groupBy("item").agg(F.min("score").alias("floor"), F.count("*").alias("m")).filter(F.col("m") >= top).collect():
            floor[r["item"]] = r["floor"]
        discard(high)
        hits = index.select("doc_ids", "a", "b", "n", "rows", "bits").mapInArrow(partial(_reaching, run=run, floor=floor), f"item bigint, {_DOC}, bound bigint")
        least = [F.asc_nulls_last("doc_id")]
        hits = _first(hits.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), top, "item", "a", "b", "_salt", order=least)
        hits = settle(_first(hits, top, "item", "a", "b", order=least).select("item", "doc_id", "a", "b"), "hits")
        scores = _exact(texts, hits.select("item", "a", "b").distinct(), run).filter("score > 0")
        ranks = _first(hits.join(scores, ["item", "a", "b"]), top, "item", order=[F.desc("score"), *least])
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item bigint, item_id {kind.simpleString()}")
        results.append(settle(ranks.join(F.broadcast(names), "item").select("item_id", F.col("_place").cast("int").alias("rank"), "doc_id", "score"), "ranks"))
        discard(hits)
    discard(index, asked)
    answer = spark.createDataFrame([], out)
    for r in results:
        answer = answer.unionByName(r)
    return answer


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN i USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
