"""Substring dedup with sharded Aho-Corasick automata.

A window is 13 consecutive words. A word goes if a window that covers it also starts in a
document with a smaller doc_id. Steps, each a Spark job over all documents:

1. Anchors. Of the nine 5-word runs in a window the one of the least hash is its anchor, so
   equal windows have equal anchors. Windows of anchors that only one document has can't
   recur and go no further.
2. Confirmed passages. The other windows are counted by their 64-bit hashes; each that two
   documents have belongs to the first of them, its holder. Runs of windows that a document
   holds are its passages, kept as words.
3. Routes. Passages are dealt to shards by holder. A document goes, with its whole text, to
   the shards whose holders it shares a window with; no other shard can find anything in it.
4. Automata. A shard's passages are compiled into an automaton of the 7-word blocks that
   tile them: every window holds one whole block. The documents' words are streamed through
   it; the windows around each place where a block is found are looked up among the shard's
   windows and compared word by word, so that work follows the words of the documents. A
   shard that many documents go to is dealt in parts of bounded size, each with the shard's
   passages.
5. The words found are cut from the whole texts.

The memory of a task follows the part size, the slice size and its longest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.llm import words as w
from driftmap.llm.tables import discard, settle

WINDOW = 13
ANCHOR = 5
#: Words of a pattern: a window of 13 holds a whole one of the blocks that tile a passage.
PATTERN = 7
#: Windows of a shard's passages, on average, and bytes of a part of its documents.
SHARD_WINDOWS = 50_000
PART_BYTES = 4 << 20
#: Words that are compared at once.
COMPARED = 1 << 20
#: Tells rows of one doc_id apart by their texts.
_KEY = "_key bigint"


def anchors(x: w.Words, h: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors, and each window's anchor (its place among them), windows in order.

    A place within the document, modulo 16, breaks ties and tells where the least hash stands.
    """
    at, g = w.grams(h, x.doc, k)
    span = window - k + 1
    n = len(g) - span + 1
    if n <= 0:
        return at[:0], g[:0], np.zeros(0, np.int64)
    place = (at - x.first[x.doc[at]]).astype(np.uint64) & np.uint64(15)
    least, width = (g & ~np.uint64(15)) | place, 1
    key = least
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = np.flatnonzero(at[span - 1 :] - at[:n] == span - 1)
    best = starts + ((least[starts] - key[starts]) & np.uint64(15)).astype(np.int64)
    mask = np.zeros(len(g), bool)
    mask[best] = True
    return at[mask], g[mask], (np.cumsum(mask) - 1)[best]


def _anchor_rows(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id")
        for lo, hi, x in w.batches(b.column("text")):
            at, g, _ = anchors(x, x.hashes())
            doc = x.doc[at]
            if places:
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([pa.array(w.signed(g)), ids.take(take), b.column("_key").take(take), pa.array((at - x.first[doc]).astype(np.int32))], ["anchor", "doc_id", "_key", "at"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(w.signed(g)), ids.take(pa.array(doc + lo))], ["anchor", "doc_id"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document's windows with one of its kept anchors, the first of each hash."""
    for b in batches:
        places = b.column("places")
        for lo, hi, x in w.batches(b.column("text")):
            h = x.hashes()
            at, _, of = anchors(x, h)
            own = places.slice(lo, hi - lo)
            kept = own.flatten().to_numpy() + np.repeat(x.first[:-1], np.diff(own.offsets.to_numpy()))
            start, g = w.grams(h, x.doc, WINDOW)
            some = np.isin(at, kept)[of]
            start, g = start[some], g[some]
            doc = x.doc[start]
            order = np.lexsort((start, g, doc))
            new = np.ones(len(order), bool)
            new[1:] = (g[order][1:] != g[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            first = order[new]
            take = pa.array(doc[first] + lo)
            yield pa.RecordBatch.from_arrays([pa.array(w.signed(g[first])), b.column("doc_id").take(take), b.column("row").take(take), pa.array((start[first] - x.first[doc[first]]).astype(np.int32))], ["passage", "doc_id", "row", "at"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each run of windows that a document holds."""
    for b in batches:
        ids, texts, own = b.column("doc_id").to_numpy(), [], b.column("own")
        rows = []
        for lo, hi, x in w.batches(b.column("text")):
            for i in range(lo, hi):
                at = np.sort(own[i].values.to_numpy()) + x.first[i - lo]
                breaks = np.flatnonzero(np.diff(at) != 1)
                for a, z in zip(at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)] + WINDOW - 1, strict=True):
                    rows.append(i)
                    texts.append(x.data[x.start[a] : x.end[z]].tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def _text(t: pa.Table) -> pa.Array:
    c = t.column("text")
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _symbols(h: np.ndarray) -> str:
    """Three characters for each word, of 64 each: their alphabets differ, so that words meet whole words only."""
    at = np.stack([(h >> np.uint64(6 * k)) & np.uint64(63) for k in range(3)], 1) + np.array([0x100, 0x140, 0x180], np.uint64)
    return at.astype("<u4").tobytes().decode("utf-32-le")


class Automaton:
    """The blocks that tile the passages of a shard, compiled, with the passages' words and their windows, each once, of the least holder."""

    def __init__(self, texts: pa.Array, holders: np.ndarray):
        data, bounds = w.as_bytes(texts)
        self.words = x = w.split(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        self.hashes, self.holders = x.hashes(), holders
        tiles = np.diff(x.first) // PATTERN
        place = np.repeat(x.first[:-1], tiles) + (np.arange(tiles.sum()) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * PATTERN
        symbols = _symbols(self.hashes)
        self.machine = ahocorasick.Automaton()
        for block in {symbols[3 * p : 3 * (p + PATTERN)] for p in place.tolist()}:
            self.machine.add_word(block, True)
        self.machine.make_automaton()
        at, g = w.grams(self.hashes, x.doc, WINDOW)
        order = np.lexsort((at, holders[x.doc[at]], g))
        new = np.ones(len(order), bool)
        new[1:] = g[order][1:] != g[order][:-1]
        self.windows, self.places = g[order][new], at[order][new]

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Word places where a block begins."""
        if not len(self.machine):
            return np.zeros(0, np.int64)
        return (np.fromiter((end for end, _ in self.machine.iter(_symbols(h))), np.int64) + 1) // 3 - PATTERN

    def locate(self, x: w.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first and last + 1 word of each stretch that passages of earlier documents cover.

        Every window holds a whole block, so only windows around a hit are looked at: each meets
        the one equal window of the passages and is compared with it word by word.
        """
        h, y, none = x.hashes(), self.words, np.zeros(0, np.int64)
        p = self.hits(h)
        if not len(p) or not len(self.windows):
            return none, none, none
        near = np.zeros(len(h) + 1, np.int64)
        np.add.at(near, np.maximum(p - (WINDOW - PATTERN), 0), 1)
        np.add.at(near, p + 1, -1)
        at, g = w.grams(h, x.doc, WINDOW)
        some = np.cumsum(near)[at] > 0
        at, g = at[some], g[some]
        found = np.minimum(np.searchsorted(self.windows, g), len(self.windows) - 1)
        q = self.places[found]
        later = (self.windows[found] == g) & (ids[x.doc[at]] > self.holders[y.doc[q]])
        at, q = at[later], q[later]
        covered = np.zeros(len(h), bool)
        for lo in range(0, len(at), COMPARED // WINDOW):
            i = (at[lo : lo + COMPARED // WINDOW, None] + np.arange(WINDOW)).ravel()
            j = (q[lo : lo + COMPARED // WINDOW, None] + np.arange(WINDOW)).ravel()
            whole = _equal(x, i, y, j).reshape(-1, WINDOW).all(1)
            covered[i.reshape(-1, WINDOW)[whole]] = True
        begin, end = w._runs(covered, x.first)
        doc = x.doc[begin]
        return doc, begin - x.first[doc], end - x.first[doc]


def _equal(x: w.Words, i: np.ndarray, y: w.Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of x and j of y are the same bytes."""
    size = x.end[i] - x.start[i]
    same = size == y.end[j] - y.start[j]
    i, j, size = i[same], j[same], size[same]
    differ = w.ragged(x.data, x.start[i], size) != w.ragged(y.data, y.start[j], size)
    if len(size):
        same[same] = np.add.reduceat(differ, np.cumsum(size) - size) == 0
    return same


def _locate(parts: pa.Table, passages: pa.Table) -> pa.Table:
    """Stream the documents of a part of a shard through the shard's automaton."""
    machine = Automaton(_text(passages), passages.column("doc_id").to_numpy())
    ids, keys, rows, begins, ends = parts.column("doc_id").to_numpy(), parts.column("_key").to_numpy(), [], [], []
    for lo, hi, x in w.batches(_text(parts)):
        doc, begin, end = machine.locate(x, ids[lo:hi])
        rows.append(doc + lo)
        begins.append(begin)
        ends.append(end)
    rows, begins, ends = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, begins, ends))
    return pa.table({"doc_id": pa.array(ids[rows], pa.int64()), "_key": pa.array(keys[rows], pa.int64()), "begin": pa.array(begins.astype(np.int32)), "end": pa.array(ends.astype(np.int32))})


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).withColumn("_key", F.xxhash64("text"))


def confirmed_windows(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (row, doc_id, _key) of documents with windows (passage, doc_id, row, at) that may recur, and confirmed (passage, least): those that two documents have."""
    once = base.select("doc_id", "text").mapInArrow(lambda it: _anchor_rows(it, False), "anchor bigint, doc_id bigint")
    seen = once.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor")
    seen = settle(seen, "anchors")
    placed = base.mapInArrow(lambda it: _anchor_rows(it, True), f"anchor bigint, doc_id bigint, {_KEY}, at int")
    by_doc = placed.join(seen, "anchor").groupBy("doc_id", "_key").agg(F.collect_set("at").alias("places"))
    by_doc = settle(by_doc.withColumn("row", F.monotonically_increasing_id()), "places")
    windows = base.join(by_doc, ["doc_id", "_key"]).select("doc_id", "row", "text", "places")
    windows = settle(windows.mapInArrow(_windows, "passage bigint, doc_id bigint, row bigint, at int"), "windows")
    discard(seen)
    confirmed = windows.groupBy("passage").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("passage", "least")
    return by_doc, windows, settle(confirmed, "confirmed")


def locate_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, _key, spans: the word ranges [begin, end) to remove of each document that has some."""
    base = _keyed(docs).filter("doc_id is not null and text is not null")
    rows, windows, confirmed = confirmed_windows(base)
    shards = F.lit(max(1, -(-confirmed.count() // SHARD_WINDOWS)))
    shard_of = lambda c: F.pmod(F.xxhash64(c), shards).cast("int")
    holds, later = F.col("doc_id") == F.col("least"), F.col("doc_id") > F.col("least")
    roles = windows.join(confirmed, "passage").groupBy("row")
    roles = roles.agg(F.collect_set(F.when(holds, F.col("at"))).alias("own"), F.collect_set(F.when(later, shard_of("least"))).alias("shards"))
    roles = settle(roles.join(rows.select("row", "doc_id", "_key"), "row").drop("row"), "roles")
    discard(windows, confirmed, rows)
    met = settle(base.join(roles, ["doc_id", "_key"]).select("doc_id", "_key", "text", "own", "shards"), "met")
    discard(roles)
    held = met.filter(F.size("own") > 0).select("doc_id", "text", "own").mapInArrow(_passages, "doc_id bigint, text string")
    passages = held.withColumn("shard", shard_of("doc_id"))
    routed = met.select("doc_id", "_key", "text", F.explode("shards").alias("shard"))
    size = F.octet_length("text").cast("long")
    parts = settle(routed.groupBy("shard").agg(F.ceil(F.sum(size) / PART_BYTES).cast("int").alias("parts")), "parts")
    dealt = routed.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "_key"), F.col("parts")).cast("int")).drop("parts")
    copied = passages.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = dealt.groupBy("shard", "part").cogroup(copied.groupBy("shard", "part")).applyInArrow(_locate, f"doc_id bigint, {_KEY}, begin int, end int")
    spans = settle(found.groupBy("doc_id", "_key").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")), "spans")
    discard(met, parts)
    return spans


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, text = b.column("spans"), b.column("text")
        n_words, n_removed, digests, texts = [], [], [], []
        for i in range(len(text)):
            whole = text[i].as_py()
            found = (whole or "").encode().split()  # at 0x20 and 0x09-0x0D
            n = len(found)
            if spans[i].is_valid:
                gone = bytearray(n)
                for p in spans[i].as_py():
                    gone[p["begin"] : p["end"]] = b"\1" * (p["end"] - p["begin"])
                found = [x for x, g in zip(found, gone, strict=True) if not g]
            kept = b" ".join(found)
            n_words.append(n)
            n_removed.append(n - len(found))
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode() if len(found) < n else whole)
        cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
            if "_rest" in b.schema.names:
                cols, names = [*cols, b.column("_rest")], [*names, "_rest"]
        yield pa.RecordBatch.from_arrays(cols, names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    A null text counts as empty. A row with a null doc_id keeps all its words and takes
    none from others. Rows that share a doc_id don't take words from each other. Columns
    other than doc_id and text are ignored.
    """
    spans = locate_repeats(docs)
    joined = _keyed(docs).join(spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("_key", "_k"), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_k")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda it: _cut(it, False), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def dedup_texts(docs: DataFrame) -> DataFrame:
    """docs with the kept words as text.

    Rows that lose no word keep their text as it is, others have words joined by one space;
    rows that lose all their words go. Columns and their types stay.
    """
    spans = locate_repeats(docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("_key", "_k")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    more = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")] if rest else []
    joined = _keyed(docs, *more).join(spans, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_k")), "left").drop("_id", "_k", "_key")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    if rest:
        schema = T.StructType.fromDDL(schema).add("_rest", joined.schema["_rest"].dataType)
    cut = joined.mapInArrow(lambda it: _cut(it, True), schema).filter("n_removed = 0 or n_removed < n_words")
    return cut.select(*(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id") if c == "doc_id" else F.col("kept_text").alias("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS passage FROM p),
m AS (SELECT passage, min(doc_id) AS least FROM g GROUP BY passage),
r AS (SELECT g.doc_id, g.i FROM g JOIN m ON g.passage = m.passage WHERE m.least < g.doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r),
k AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d) q
      WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = q.doc_id AND x.i = q.j)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
