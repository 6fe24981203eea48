"""Chunk tables of media: what is stored, and that every file comes from it."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftmap.llm import media_chunks


def test_every_file_is_read_back_from_the_stored_chunks(docs):
    files, lists, chunks = media_chunks.store_media(docs)
    held = {bytes(r.digest): bytes(r.data) for r in chunks.collect()}
    assert chunks.count() == len(held) and all(media_chunks.digest(c) == d for d, c in held.items())
    assert {bytes(r.digest) for r in lists.collect()} == set(held)
    assert files.count() == docs.count() == lists.filter("ord = 0").count()
    # a text that no other shares: once its stored bytes differ, reading it back must fail
    alone = files.filter(F.col("n_bytes") == max(r.n_bytes for r in files.collect()))
    for bad in (chunks.withColumn("data", F.expr("concat(data, X'00')")), chunks.limit(0)):
        with pytest.raises(Exception, match="differs from the one that was stored"):
            media_chunks.rebuild_media(alone, lists, bad).collect()


def test_files_of_a_very_common_chunk_come_back(spark, monkeypatch):
    monkeypatch.setattr(media_chunks, "COPY_ROWS", 4)
    same = spark.createDataFrame([(i % 30, "the same text") for i in range(40)], "doc_id bigint, text string")
    got = media_chunks.stored_media(same).collect()
    assert len(got) == 40 and len({r.media_sha256 for r in got}) == 1


def test_only_the_result_stays_in_the_shared_folder(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "driftmap"
    before = set(folder.glob("*"))
    got = media_chunks.stored_media(spark.createDataFrame([(1, "a"), (2, None), (2, "a" * 5000)], "doc_id bigint, text string"))
    assert {p.name.split("-")[0] for p in set(folder.glob("*")) - before} == {"media"}
    assert sorted(r.n_bytes for r in got.collect()) == [0, 1, 5000]


def test_starts_of_texts_of_other_length_share_chunks(spark):
    rng = random.Random(2)
    start = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    docs = spark.createDataFrame([(1, start), (2, start + "x" * 400)], "doc_id bigint, text string")
    _, lists, _ = media_chunks.store_media(docs)
    first, other = ([bytes(r.digest) for r in rows] for rows in (lists.filter(F.col("row") == k.row).orderBy("ord").collect() for k in lists.select("row").distinct().collect()))
    assert first[0] == other[0] and len(set(first) & set(other)) >= 2
