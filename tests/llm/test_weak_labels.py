"""Weak labels: EM against enumeration, the whole query against one process, held-out labels."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftmap.llm import weak_labels
from driftmap.llm import words as w

FOLDER = "/root/testdata/sf0.01"


def em_by_hand(docs):
    """Posteriors of a list of vote tuples, document by document."""
    post = [0.9 if v.count(1) > v.count(0) else 0.1 for v in docs]
    while True:
        prior = (sum(post) + 1) / (len(docs) + 2)
        rate = {}
        for k in range(len(docs[0])):
            for y in (0, 1):
                mass = {v: 1.0 + sum((p if y else 1 - p) for p, d in zip(post, docs, strict=True) if d[k] == v) for v in (0, 1, 2)}
                for v in mass:
                    rate[k, y, v] = mass[v] / sum(mass.values())
        new = []
        for d in docs:
            good, bad = prior, 1 - prior
            for k, v in enumerate(d):
                good, bad = good * rate[k, 1, v], bad * rate[k, 0, v]
            new.append(good / (good + bad))
        moved = max(abs(a - b) for a, b in zip(new, post, strict=True))
        post = new
        if moved <= 1e-9:
            return post


def test_em_is_that_of_enumeration():
    rng = random.Random(4)
    docs = []
    for _ in range(300):
        good = rng.random() < 0.7
        docs.append(tuple(2 if rng.random() < 0.3 else int(good == (rng.random() < acc)) for acc in (0.95, 0.9, 0.8, 0.6, 0.5)))
    counts = Counter(docs)
    keys = sorted(counts)
    post, rates = weak_labels.estimate(np.array(keys), np.array([counts[k] for k in keys], float))
    want = dict(zip(docs, em_by_hand(docs), strict=True))
    assert all(math.isclose(p, want[k], abs_tol=1e-6) for p, k in zip(post, keys, strict=True))
    acc = rates[:, 1, 1] / rates[:, 1, :2].sum(1)
    assert acc[0] > 0.85 and acc[4] < 0.75  # the labeller that guesses is found out


def test_estimates_have_their_effect():
    # a labeller that calls good documents bad is outvoted: one bad vote alone doesn't decide
    patterns = np.array([[1, 1, 1, 1], [1, 1, 1, 0], [0, 0, 1, 0], [0, 0, 1, 1], [0, 1, 1, 1]])
    post, rates = weak_labels.estimate(patterns, np.array([800.0, 60, 20, 120, 10]))
    assert post[0] > 0.5 and post[1] > 0.5 and post[2] < 0.5 and post[3] < 0.5
    assert rates[3, 1, 0] > 0.05


def scored(docs):
    return {r.doc_id: (r.posterior, r.score, r.kept) for r in weak_labels.classify(docs).collect()}


def test_query_is_that_of_one_process_however_rows_are_dealt(spark, docs, rows):
    texts = [t or "" for _, t, *_ in rows]
    x = w.split(*w.as_bytes(pa.array(texts)))
    votes = weak_labels.votes(x)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = weak_labels.estimate(patterns, counts.astype(float))[0][which.ravel()]
    distinct = sorted({t: p for (_, t, *_), p in zip(rows, post, strict=True) if t is not None}.items())
    weights = weak_labels.train(pa.array([t for t, _ in distinct]), np.array([p for _, p in distinct]))
    got = scored(docs)
    for k, (i, *_) in enumerate(rows):
        at, v = (weights[:0], weights[:0])
        d, at, v = weak_labels.features(w.split(*w.as_bytes(pa.array([texts[k]]))))
        score = 1 / (1 + math.exp(-min(30, max(-30, weights[at] @ v + weights[-1])))) if texts[k].split() else 0.0
        assert math.isclose(got[i][0], post[k], abs_tol=1e-9) and math.isclose(got[i][1], score, abs_tol=1e-9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert scored(docs.repartition(5)) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_labels(spark):
    got = weak_labels.classify(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    known = got.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    accuracy = sum(r.kept == (r.quality == 1) for r in known) / len(known)
    by_label = sum((r.posterior >= 0.5) == (r.quality == 1) for r in known) / len(known)
    clean = [r.kept for r in known if r.quality == 1]
    print(f"held-out accuracy {accuracy:.3f}, of posteriors {by_label:.3f}, clean kept {sum(clean) / len(clean):.3f}")
    assert accuracy >= 0.9 and by_label >= 0.97 and sum(clean) / len(clean) >= 0.95
