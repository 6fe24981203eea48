"""Quality rules: counts of each text, and lines that stand in many documents of a host.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed. A line is above
its limit where more documents of one host have it than MIN_DOCUMENTS and than
HOST_PERCENT of the host's documents. Such lines go; a document that keeps less than
LEFT_PERCENT of its words is rejected, as is one that fails the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.llm import words as w
from driftmap.llm.tables import row_key, settle

MIN_DOCUMENTS = 4
HOST_PERCENT = 5
LEFT_PERCENT = 60
MIN_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_CHAR = ~w.SPACE & ((np.arange(256) & 0xC0) != 0x80)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[bounds])


def _again(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by document and hash, and where in it a new pair begins."""
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return order, new


def lines(x: w.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the \\n-split lines with a word: byte start and end, first and last + 1 word, document."""
    edges = np.concatenate([x.bounds[:-1], np.flatnonzero(x.data == 10) + 1])
    start = np.unique(edges[edges < len(x.data)])
    end = np.append(start[1:], len(x.data))[: len(start)]
    end = end - (x.data[end - 1] == 10)
    a, z = np.searchsorted(x.start, start), np.searchsorted(x.start, end)
    some = z > a
    return start[some], end[some], a[some], z[some], x.doc[a[some]]


def text_counts(x: w.Words) -> dict[str, np.ndarray]:
    docs = len(x.bounds) - 1
    start, end, _, _, line_doc = lines(x)
    _, new = _again(w.run_hash(w.BYTE_VALUE[x.data], start, end), line_doc)
    at, g = w.grams(x.hashes(), x.doc, REPEAT_WINDOW)
    order, first = _again(g, x.doc[at])
    size = np.diff(np.append(np.flatnonzero(first), len(g)))
    twice = at[order[np.repeat(size > 1, size)]]
    cover = np.zeros(len(x.doc) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    ordered_doc = np.sort(line_doc)
    return {
        "n_words": np.diff(x.first),
        "word_chars": _per_doc(_IS_CHAR[x.data], x.bounds),
        "n_symbols": _per_doc(_IS_SYMBOL[x.data], x.bounds),
        "n_dup_lines": np.bincount(ordered_doc[~new], minlength=docs),
        "n_repeat_words": np.bincount(x.doc[covered], minlength=docs),
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, x in w.batches(b.column("text")):
            counts = text_counts(x)
            _, _, a, z, doc = lines(x)
            h = w.run_hash(x.hashes(w.LOWER_VALUE), a, z)
            order, new = _again(h, doc)
            begins = np.flatnonzero(new)
            n = np.add.reduceat((z - a)[order], begins) if len(begins) else np.zeros(0, np.int64)
            items = pa.StructArray.from_arrays([pa.array(w.signed(h[order][begins])), pa.array(n.astype(np.int32))], ["h", "n"])
            per = np.bincount(doc[order][begins], minlength=hi - lo)
            cols = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "host", "_key")]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS), w.list_array(items, per)], ["doc_id", "host", "_key", *_COUNTS, "lines"])


def _base(docs: DataFrame) -> DataFrame:
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")]
    return docs.select(*cols).withColumn("_key", row_key("doc_id", "source", "text")).withColumn("host", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))).drop("source")


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and verdict of each row, and the lines to remove of each document that has some."""
    schema = "doc_id bigint, host string, _key struct<a: bigint, b: bigint>, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", lines array<struct<h: bigint, n: int>>"
    scan = settle(_base(docs).mapInArrow(_scan, schema), "lines")
    hosts = scan.groupBy("host").agg(F.countDistinct("doc_id").alias("documents"))
    each = scan.select("doc_id", "host", "_key", F.explode("lines").alias("line")).select("doc_id", "host", "_key", "line.h", "line.n")
    spread = each.groupBy("host", "h").agg(F.countDistinct("doc_id").alias("spread")).filter(F.col("spread") > MIN_DOCUMENTS)
    above = spread.join(hosts, "host").filter(100 * F.col("spread") > HOST_PERCENT * F.col("documents")).select("host", "h")
    hit = each.join(above, ["host", "h"]).dropDuplicates(["_key", "h"])
    gone = settle(hit.groupBy("_key").agg(F.sum("n").alias("gone"), F.collect_set("h").alias("hashes")), "removed")
    out = scan.drop("lines", "host").join(gone, "_key", "left").withColumn("gone", F.coalesce("gone", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("gone") > 0) & (100 * (F.col("n_words") - F.col("gone")) < LEFT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted), gone


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, n_removed_words, base_failed and kept for each row of docs.

    A null text counts as empty, so it fails the base rule. Null hosts (column source) are
    one host. Rows of equal doc_id count once for a line; null doc_ids don't count for any.
    """
    judged, _ = _judged(docs)
    return judged.select("doc_id", *_COUNTS, "base_failed", F.col("gone").alias("n_removed_words"), "kept")


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, hashes = b.column("text"), b.column("_hashes")
        out = []
        for lo, _, x in w.batches(text):
            _, _, a, z, doc = lines(x)
            h = w.signed(w.run_hash(x.hashes(w.LOWER_VALUE), a, z))
            at = np.searchsorted(doc, np.arange(len(x.bounds)))
            for i in range(len(x.bounds) - 1):
                whole = text[lo + i].as_py()
                if hashes[lo + i].is_valid and whole:
                    drop = np.isin(h[at[i] : at[i + 1]], hashes[lo + i].values.to_numpy())
                    left, k = [], 0
                    for line in whole.split("\n"):
                        if line.encode().split():
                            k += 1
                            if drop[k - 1]:
                                continue
                        left.append(line)
                    whole = "\n".join(left)
                out.append(whole)
        i = b.schema.names.index("text")
        yield b.drop_columns(["_hashes"]).set_column(i, "text", pa.array(out, pa.string()))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of docs without their lines above the limit; columns and types stay."""
    judged, gone = _judged(docs)
    verdict = judged.select(F.col("_key").alias("_k"), "kept").distinct()
    keyed = docs.withColumn("_key", row_key("doc_id", "source", "text"))
    joined = keyed.join(verdict, F.col("_key") == F.col("_k")).filter("kept").drop("_k", "kept")
    joined = joined.join(gone.select(F.col("_key").alias("_k"), F.col("hashes").alias("_hashes")), F.col("_key") == F.col("_k"), "left").drop("_k", "_key")
    return joined.mapInArrow(_cut_lines, T.StructType(docs.schema.fields)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('+' || source, '-') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, host, l, array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS h,
       len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
       FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM d) q WHERE len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 0),
du AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5) q),
tw AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
rp AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 5)) AS j FROM g JOIN tw ON g.doc_id = tw.doc_id AND g.g = tw.g) q GROUP BY doc_id),
ho AS (SELECT host, count(DISTINCT doc_id) AS documents FROM d GROUP BY host),
sp AS (SELECT host, h, count(DISTINCT doc_id) AS spread FROM ln GROUP BY host, h),
ab AS (SELECT sp.host, sp.h FROM sp JOIN ho ON sp.host = ho.host WHERE spread > {MIN_DOCUMENTS} AND 100 * spread > {HOST_PERCENT} * documents),
gn AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS gone FROM ln JOIN ab ON ln.host = ab.host AND ln.h = ab.h GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS n_removed_words
      FROM d LEFT JOIN du ON d.doc_id = du.doc_id LEFT JOIN rp ON d.doc_id = rp.doc_id LEFT JOIN gn ON d.doc_id = gn.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0 AND 100 * (n_words - n_removed_words) < {LEFT_PERCENT} * n_words) AS kept
FROM m
"""
