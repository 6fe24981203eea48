"""Media columns: texts stored as 8-bit audio, cut into content-defined chunks.

A text's UTF-8 bytes, padded with zeros, are the samples of a mono WAV file. The samples are cut
where a rolling gear hash of the last 32 bytes has its top bits zero, so equal passages give
equal chunks wherever they stand. Each distinct chunk is stored once, each file as the ordered
list of its chunks' digests. A file is put together again from both tables by a join, and is
verified by its digest before samples are read back from it. The header holds the file's length,
so it stays out of the chunks and is built anew.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.llm import words as w
from driftmap.llm.tables import discard, settle

HEADER = 44
UNIT = 64
RATE = 8000
#: A text is 1.5 KB long in the median; chunks are MIN_CHUNK + 2 ** MASK_BITS long on average.
MIN_CHUNK, MAX_CHUNK = 64, 2_048
MASK_BITS = 8
#: References that one copy of a stored chunk serves, and how many chunks are copied at most.
COPY_ROWS, MAX_HOT = 256, 10_000
#: Parts in which chunks are written and files rebuilt, one after the other, so that a job's shuffle files are those of a part.
WRITES, BUCKETS = 4, 12
_GEAR = (w.BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
_RESULT = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_FIELDS = [x.split()[0] for x in _RESULT.split(", ")]


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != HEADER + n or size != 36 + n:
        raise ValueError("not a mono WAV file of 8-bit samples")
    return media[HEADER:]


def cut_points(samples: bytes) -> list[int]:
    """Ends of the chunks of a file's samples."""
    b = np.frombuffer(samples, np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum of gear[b[i - j]] << j over 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    ends, last, n = [], 0, len(samples)
    for m in marks[marks >= MIN_CHUNK].tolist():
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK:
            last = m
            ends.append(last)
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks_of(samples: bytes) -> list[bytes]:
    ends = cut_points(samples)
    return [samples[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def read_back(media: bytes, n_bytes: int, expected: bytes) -> tuple:
    """Verify a file that was put together, and compute the row's features from its samples."""
    if hashlib.sha256(media).digest() != expected:
        raise ValueError("a file differs from the one that was stored")
    payload = from_wav(media)
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    feature = f"samples={len(x)};sum={int(x.sum())};squares={int((x * x).sum())};peak={int(x.max())};turns={turns}"
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), expected.hex(), feature


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, wholes, lists = [], [], []
        for t in b.column("text"):
            text = (t.as_py() or "").encode()
            payload = payload_of(text)
            sizes.append(len(text))
            wholes.append(hashlib.sha256(to_wav(payload)).digest())
            lists.append([digest(c) for c in chunks_of(payload)])
        cols = [pa.array(sizes, pa.int64()), pa.array(wholes, pa.binary()), pa.array(lists, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("bucket"), *cols], ["doc_id", "row", "bucket", "n_bytes", "whole", "digests"])


def _chunks(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Chunks of a part of the digests, each once for each bucket of its files in a partition."""
    seen = set()
    for b in batches:
        digests, buckets, data = [], [], []
        for t, bucket in zip(b.column("text"), b.column("bucket").to_pylist(), strict=True):
            for c in chunks_of(payload_of((t.as_py() or "").encode())):
                d = digest(c)
                if d[0] % WRITES == part and (d, bucket) not in seen:
                    seen.add((d, bucket))
                    digests.append(d)
                    buckets.append(1 << bucket)
                    data.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], ["digest", "buckets", "data"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        results = []
        for n, whole, parts in zip(*(b.column(c) for c in ("n_bytes", "whole", "parts")), strict=True):
            there = sorted((p["ord"], p["data"]) for p in parts.as_py() or ())
            results.append(read_back(to_wav(b"".join(data for _, data in there)), n.as_py(), whole.as_py()))
        cols = zip(*results, strict=True) if results else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *_FIELDS])


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, lists and chunks of docs, as tables in the shared folder.

    files: doc_id, row, bucket, n_bytes, whole (the file's digest), one for each row of docs.
    lists: row, bucket, ord, digest, the chunks of each file in order. chunks: digest, buckets
    (a bit for each bucket whose files have it), data, each distinct chunk once. Files are
    kept as their samples; the header follows from their number.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS)).cast("int"))
    entries = base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_entries, "doc_id bigint, row bigint, bucket int, n_bytes bigint, whole binary, digests array<binary>")
    entries = settle(entries, "entries")
    chunks = None
    for k in range(WRITES):
        found = base.select("text", "bucket").mapInArrow(partial(_chunks, part=k), "digest binary, buckets int, data binary")
        one = settle(found.groupBy("digest").agg(F.bit_or("buckets").alias("buckets"), F.first("data").alias("data")), "chunks")
        chunks = one if chunks is None else chunks.unionByName(one)
    lists = entries.select("row", "bucket", F.posexplode("digests").alias("ord", "digest"))
    return entries.drop("digests"), lists, chunks


def rebuild_media(files: DataFrame, lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """The columns of stored_media, for files put together from the chunks of their lists.

    A chunk that many files have is given in several copies, so that its references are
    dealt over tasks; at most MAX_HOT chunks are.
    """
    total = lists.count()
    counts = lists.groupBy("digest").agg(F.count("*").alias("n")).filter((F.col("n") > COPY_ROWS) & (F.col("n") * MAX_HOT > total))
    hot = counts.select("digest", F.ceil(F.col("n") / COPY_ROWS).cast("int").alias("copies"))
    hot = settle(hot, "hot")
    copies = F.coalesce("copies", F.lit(1))
    out = None
    for k in range(BUCKETS):
        asked = lists.filter(F.col("bucket") == k).join(F.broadcast(hot), "digest", "left").select("row", "ord", "digest", F.pmod(F.xxhash64("row"), copies).cast("int").alias("copy"))
        given = chunks.filter(F.col("buckets").bitwiseAND(1 << k) != 0).join(F.broadcast(hot), "digest", "left").select("digest", "data", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
        # no bound holds for the size of either: never broadcast, the same plan at every size
        found = asked.join(given.hint("merge"), ["digest", "copy"]).select("row", "ord", "data")
        parts = found.groupBy("row").agg(F.collect_list(F.struct("ord", "data")).alias("parts"))
        there = files.filter(F.col("bucket") == k).join(parts.hint("merge"), "row", "left").select("doc_id", "n_bytes", "whole", "parts")
        one = settle(there.mapInArrow(_rebuild, f"doc_id bigint, {_RESULT}"), "media")
        out = one if out is None else out.unionByName(one)
    discard(hot)
    return out


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for each row of docs.

    Every file is stored by store_media and computed on as rebuild_media reads it back. A
    null text counts as empty. Repeated rows stay. Other columns are ignored. Of the tables
    that this makes, only the result stays in the shared folder.
    """
    files, lists, chunks = store_media(docs)
    out = rebuild_media(files, lists, chunks)
    discard(files, chunks)
    return out


def op10_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
