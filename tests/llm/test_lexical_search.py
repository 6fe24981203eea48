"""Ranked search against brute force, bounds against exact scores, and odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from driftmap.llm import lexical_search as s


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, top=50):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, len(w), Counter(w)) for i, w in docs if w]
    total, df = sum(n for _, n, _ in docs), Counter(t for _, _, c in docs for t in c)
    out = []
    for item, asked in {(i, frozenset(terms(t))) for i, t in items}:
        found = []
        for i, n, c in docs:
            m = 50 + 50 * n * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -v) for r, (v, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id int, text string").selectExpr("*", "1 as doc_id", "2 as score", "3 as item", "4 as rank")


def test_matches_brute_force(spark, docs, rows):
    rng = random.Random(5)
    words = sorted({t for _, x, *_ in rows for t in terms(x)})
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "-- !"), (33, "nowhere unknown"), (34, "AB ab so"), (34, "so"), (34, "SO so"), (None, "one")]
    want = ranked([(i, t) for i, t, *_ in rows], items)
    assert got(s.ranked_search(docs, items_of(spark, items))) == want
    assert len(want) > 500
    assert got(s.ranked_search(docs, items_of(spark, items), top=3)) == [r for r in want if r[1] <= 3]


def test_runs_of_items_and_levels(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)] + ["é", "ÀB", "x1"]
    docs = [(k, " ".join(rng.choice(words[: rng.randrange(2, 43)]) for _ in range(rng.choice((3, 30, 700))))) for k in range(300)]
    items = [(i, " ".join(rng.sample(words, 4))) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(s, "RUN_ITEMS", 4)
    assert got(s.ranked_search(df, items_of(spark, items))) == ranked(docs, items)


def test_bounds_are_never_below_scores():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.choice((1, 5, 60, 2000)))) for _ in range(90)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(90)), "text": texts, "a": list(range(90)), "b": list(range(90))})
    index = list(s._index([batch]))
    n_terms = sum(len(terms(t)) for t in texts)
    vocabulary = np.sort(np.concatenate([h for *_, h, _ in s.terms_of(pa.array(["a b c d ee gg zz"]))]))
    run = s.Run(vocabulary, np.arange(1, 8) * 100, np.arange(7), np.array([0, 3, 7]), 90, n_terms)
    names = {int(h): t for t in "a b c d ee gg zz".split() for *_, x, _ in s.terms_of(pa.array([t])) for h in x}
    seen = 0
    for (ids, _, _), n, rows, bits in s._blocks(index):
        bound = s._bounds(run, n, rows, bits)
        for j, i in enumerate(ids.to_pylist()):
            c = Counter(terms(texts[i]))
            for item, places in enumerate(((0, 1, 2), (3, 4, 5, 6))):
                exact = sum(int(run.weights[p]) * int(run.gain(np.int64(c[names[int(run.terms[p])]]), np.int64(n[j]))) for p in places if c[names[int(run.terms[p])]])
                assert exact <= bound[item, j]
                seen += 1
    assert seen == 180


def test_copies_and_repeated_ids(spark):
    docs = [(k % 200, "same words here") for k in range(400)] + [(None, "same words here"), (7, "other words"), (7, "same")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    items = [(1, "same words"), (2, "other")]
    assert got(s.ranked_search(df, items_of(spark, items))) == ranked(docs, items)


def test_empty_tables_and_clashing_columns(spark, docs, empty, odd):
    items = items_of(spark, [(1, "p q other"), (2, "x")])
    assert got(s.ranked_search(empty, items)) == []
    assert got(s.ranked_search(docs, items.filter("false"))) == []
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(s.ranked_search(odd, items)) == ranked(rows, [(1, "p q other"), (2, "x")])
    assert s.ranked_search(odd, items).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
