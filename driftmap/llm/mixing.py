"""Mixing sources to target weights, by blocks of words.

Each source's documents, in a pseudorandom order, are one stream of words that is packed
into blocks of BLOCK_WORDS; the last block of a stream may be shorter. Every output shard
draws how many blocks it takes of each source, a multinomial over all its slots. Over all
shards a source's draws are numbered; the j-th takes the block at place j of a pseudorandom
permutation of the source's blocks, a new one for each pass over them, and blocks are joined
by that index. So the draws alone decide what is taken: a source that is due s slots is off
its target by a standard deviation of at most sqrt(s) blocks, a share of 1 / sqrt(s), which
is why blocks are short. A draw beyond a source's third pass is void, so that no document is
taken more than three times.

Sources, shards and slots are tables; the driver holds sums over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmap.llm import words as w
from driftmap.llm.tables import discard, numbered, row_key, settle, sums_before

BLOCK_WORDS = 16
SHARD_SLOTS = 8192
#: Blocks of a run, in which slots meet documents.
RUN_BLOCKS = 64
#: Documents of a part of a stream, on average.
PART_DOCUMENTS = 1_000
WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
SEED = 20240229
#: Slots are parts of a line in this unit.
_UNIT = 1 << 20
_WORD = r"[^\x20\x09-\x0D]+"


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each index in a pseudorandom permutation of range(n) that key picks: a Feistel network on an even number of bits, walked until it lands below n."""
    half = np.maximum(1, (np.frexp((n - 1).astype(float))[1] + 1) // 2).astype(np.uint64)
    low, top = (np.uint64(1) << half) - np.uint64(1), n.astype(np.uint64)
    keys = [w.mix(key.astype(np.uint64) + r) for r in w._BASE * np.arange(1, 5, dtype=np.uint64)]
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m = out[todo], half[todo], low[todo]
        a, b = x >> h, x & m
        for k in keys:
            a, b = b, a ^ (w.mix(b ^ k[todo]) & m)
        out[todo] = x = (a << h) | b
        todo = todo[x >= top[todo]]
    return out.astype(np.int64)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """source, no, documents, source_size, target of each source.

    Sources are numbered by code point, null last. Targets share the total by weight; those
    above most times their source's size stop there and the others share what is left, by
    weight, until none is above. Each round is one aggregate over the sources.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    by = numbered(by, F.col("source").asc_nulls_last(), "no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    by = settle(by.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))), "sources")
    level, before = 0.0, -1
    while True:
        stops = F.col("_cap") <= F.col("_w") * F.lit(level)
        sums = (F.count_if(stops), F.sum(F.when(stops, F.col("_cap"))), F.sum(F.when(~stops, F.col("_w"))), F.sum("source_size"))
        stopped, capped, open_weight, total = by.agg(*sums).first()
        if stopped == before or not open_weight:
            break
        before, level = stopped, (total - (capped or 0.0)) / open_weight
    target = F.when(F.col("_cap") <= F.col("_w") * F.lit(level), F.col("_cap")).otherwise(F.col("_w") * F.lit(level))
    return by.select("source", "no", "documents", "source_size", target.alias("target"))


def draw_shards(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, no, n: how many slots of each shard a source gets, a multinomial draw over all slots of the shard. sources: no, slots (expected over all shards).

    Every slot falls on a point of a line that the sources divide; the two meet by cells of
    the line. A shard's slots are counted in the task that draws them.
    """
    spark = sources.sparkSession
    by = settle(sources.filter("slots > 0").select("no", F.greatest(F.floor(F.col("slots") * _UNIT), F.lit(1)).cast("long").alias("mass")), "shares")
    mass, count = by.agg(F.sum("mass"), F.count("*")).first()
    total = round(sources.agg(F.sum("slots")).first()[0] or 0)
    if not total:
        return spark.createDataFrame([], "shard bigint, no bigint, n bigint")
    width = -(-mass // count)
    line = sums_before(by, "mass", "no").withColumn("end", F.col("before") + F.col("mass"))
    line = line.select("no", "before", "end", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("end") - 1) / width))).alias("cell"))
    points = spark.range(total).withColumn("shard", F.floor(F.col("id") / shard_slots)).select("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(mass)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    return points.join(line, "cell").filter("before <= point and point < end").groupBy("shard", "no").agg(F.count("*").alias("n"))


def _fill(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """The block of each slot, by the permutation of its source and pass."""
    for b in batches:
        shard, no, j, n = (b.column(c).to_numpy() for c in ("shard", "no", "j", "blocks"))
        turn, k = j // n, j % n
        key = w.mix(no.astype(np.uint64) * np.uint64(MOST_PASSES) + turn.astype(np.uint64) + w.mix(np.array([seed], np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, no, j, turn, permute(k, n, key))], ["shard", "no", "j", "turn", "block"])


def _placed(sized: DataFrame, sources: DataFrame, documents: int, seed: int) -> DataFrame:
    """Each row's place in its source's stream: sums of parts first, then sums in each part."""
    parts = max(1, -(-documents // PART_DOCUMENTS))
    rows = sized.join(sources.select(F.col("source").alias("_source"), "no"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "_key", "no")
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(parts)))
    sums = sums_before(rows.groupBy("no", "part").agg(F.sum("size").alias("n")), "n", "part", ("no",)).select("no", "part", F.col("before").alias("base"))
    inner = Window.partitionBy("no", "part").orderBy(F.xxhash64("_key"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(sums, ["no", "part"]).select("doc_id", "size", "_key", "no", (F.col("start") + F.col("base")).alias("start"))


def _sized(docs: DataFrame) -> DataFrame:
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")]
    base = docs.select(*cols).withColumn("_key", row_key("doc_id", "source", "text"))
    return base.select("doc_id", "source", "_key", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables of the mix: sources, slots, placed, pieces.

    sources: source, no, documents, source_size, target, blocks, slots (expected).
    slots: shard, no, j, turn, block: what each output shard holds.
    placed: doc_id, _key, size, no, start: where each row stands in its source's stream;
    start is unique for rows of a source that have words.
    pieces: shard, no, j, turn, block, _key, start, size, begin, words: the words of a slot
    that come from one document. A null text has no words; null sources are one source, the
    last.
    """
    sized = settle(_sized(docs), "sizes")
    targets = source_targets(sized)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    expected = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)
    sources = settle(targets.withColumn("blocks", blocks).withColumn("slots", expected), "sources")
    discard(targets)
    drawn = settle(draw_shards(sources, shard_slots, seed), "draws")
    dealt = sums_before(drawn, "n", "shard", ("no",)).withColumn("j", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    dealt = dealt.join(sources.select("no", "blocks"), "no").filter(F.col("j") < MOST_PASSES * F.col("blocks")).select("shard", "no", "j", "blocks")
    slots = settle(dealt.mapInArrow(partial(_fill, seed=seed), "shard bigint, no bigint, j bigint, turn bigint, block bigint"), "slots")
    placed = settle(_placed(sized, sources, sources.agg(F.sum("documents")).first()[0] or 0, seed), "placed")
    discard(sized, drawn)
    # slots and documents meet by runs of blocks, each a row with its slots (at most MOST_PASSES for a block)
    b, run = F.lit(block), F.lit(block * RUN_BLOCKS)
    runs = slots.groupBy("no", F.floor(F.col("block") / RUN_BLOCKS).alias("run")).agg(F.collect_list(F.struct("block", "shard", "j", "turn")).alias("_slots"))
    spread = placed.filter("size > 0").withColumn("run", F.explode(F.sequence(F.floor(F.col("start") / run), F.floor((F.col("start") + F.col("size") - 1) / run))))
    spread = spread.select("_key", "no", "start", "size", "run", F.floor(F.col("start") / b).alias("_from"), F.floor((F.col("start") + F.col("size") - 1) / b).alias("_to"))
    met = spread.join(runs, ["no", "run"]).withColumn("_slot", F.explode(F.filter("_slots", lambda s: (s["block"] >= F.col("_from")) & (s["block"] <= F.col("_to")))))
    met = met.select("_key", "no", "start", "size", "_slot.*")
    begin = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
    return sources, slots, placed, met.select("shard", "no", "j", "turn", "block", "_key", "start", "size", begin.alias("begin"), (end - begin).alias("words"))


def mixed_sizes(docs: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs; see mix for nulls. Repeated rows stay and may differ in what is taken of them."""
    sources, _, placed, pieces = mix(docs, block, shard_slots, seed)
    taken = pieces.groupBy("no", F.col("start").alias("_start")).agg(F.sum("words").alias("taken"))
    place = F.when(F.col("size") > 0, F.col("start"))
    rows = placed.withColumn("_start", place).join(taken, ["no", "_start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return rows.join(sources.select("no", "source_size", "target"), "no").select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, slot, source, turn, block, doc_ids, text: the blocks of each output shard, in a pseudorandom order from slot 0.

    A block's words are joined by one space; doc_ids are its documents in order.
    """
    sources, _, _, pieces = mix(docs, block, shard_slots, seed)
    own = pieces.groupBy("_key", "no", "start").agg(F.collect_list(F.struct("shard", "j", "turn", "block", "begin", "words")).alias("_pieces"))
    keyed = docs.select("doc_id", "text", row_key("doc_id", "source", "text").alias("_k")).dropDuplicates(["_k"])
    each = own.join(keyed, F.col("_key") == F.col("_k")).withColumn("_words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    each = each.select("doc_id", "no", "start", "_words", F.explode("_pieces").alias("p"))
    part = F.array_join(F.slice("_words", (F.col("p.begin") + 1).cast("int"), F.col("p.words").cast("int")), " ")
    each = each.select("no", "p.shard", "p.j", "p.turn", "p.block", F.struct("start", "doc_id", part.alias("text")).alias("part"))
    whole = each.groupBy("shard", "no", "j", "turn", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "no", "j"), "no", "j")) - 1
    whole = whole.withColumn("slot", slot).join(sources.select("no", "source"), "no")
    return whole.select("shard", "slot", "source", "turn", "block", F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.text", " ").alias("text"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs of which the mix takes words, with those words as text, once for each turn; columns and types stay.

    Words are joined by one space; a text that is taken whole and once stays as it is.
    Rows of equal doc_id, source and text are told apart by what is taken of them only.
    """
    _, _, _, pieces = mix(docs)
    lists = pieces.groupBy("_key", "no", "start", "size").agg(F.sort_array(F.collect_list(F.struct("turn", "begin", "words"))).alias("_pieces"))
    lists = lists.select(F.col("_key").alias("_k"), F.col("size").alias("_size"), "_pieces")
    keyed = docs.withColumn("_key", row_key("doc_id", "source", "text")).dropDuplicates(["_key"])
    joined = keyed.join(lists, F.col("_key") == F.col("_k"))
    whole = (F.element_at("_pieces", -1)["turn"] == F.element_at("_pieces", 1)["turn"]) & (F.aggregate("_pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("_size"))
    cut = lambda words: F.transform("_pieces", lambda p: F.slice(words, (p["begin"] + 1).cast("int"), p["words"].cast("int")))
    # as a lambda's argument the words are found once for a text, not once for each piece
    taken = F.transform(F.array(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))), lambda words: F.array_join(F.flatten(cut(words)), " "))[0]
    return joined.withColumn("text", F.when(whole, F.col("text")).otherwise(taken)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
