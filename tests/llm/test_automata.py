"""Automata of repeated passages: what they find, and that nothing is found without them."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from driftmap.llm import substring_dedup as sd


def tables(docs, passages):
    parts = pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "_key": pa.array(range(len(docs)), pa.int64()), "text": pa.array([t for _, t in docs])})
    return parts, pa.table({"doc_id": pa.array([i for i, _ in passages], pa.int64()), "text": pa.array([t for _, t in passages])})


def found(docs, passages):
    return sorted((r["doc_id"], r["begin"], r["end"]) for r in sd._locate(*tables(docs, passages)).to_pylist())


def test_every_window_of_a_passage_is_found():
    passage = [f"p{k}" for k in range(40)]
    for a in range(28):
        for size in (12, 13, 17):
            part = passage[a : a + size]
            want = [(5, 2, 2 + len(part))] if len(part) >= 13 else []
            assert found([(5, "x y " + " \n".join(part) + " z")], [(1, " ".join(passage))]) == want


def test_holders_come_first_and_documents_stay_apart():
    passage = " ".join(f"p{k}" for k in range(13))
    half = passage.split()
    assert found([(1, passage), (0, passage), (2, passage)], [(1, passage)]) == [(2, 0, 13)]
    assert found([(3, " ".join(half[:6])), (4, " ".join(half[6:]))], [(1, passage)]) == []


def test_repeated_words():
    got = found([(9, " ".join(["so"] * 500))], [(1, " ".join(["so"] * 13))])
    covered = np.zeros(500, bool)
    for _, a, z in got:
        covered[a:z] = True
    assert covered.all()


def test_work_follows_the_words_where_all_are_alike(spark):
    """150,000 equal words in both texts, and a block of words that all passages share."""
    began = time.time()
    assert found([(9, "so " * 150_000)], [(1, "so " * 150_000)]) == [(9, 0, 150_000)]
    common = "the very same words stand here again"
    passages = [(1, f"p{k} {common} q{k} r{k} s{k} t{k} u{k} v{k}") for k in range(4000)]
    docs = [(2, " ".join(f"x{k} {common} y{k}" for k in range(4000)) + " " + passages[7][1])]
    assert [e - b for _, b, e in found(docs, passages)] == [14]
    rows = [(i, "so " * 150_000) for i in (1, 2)]
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 150_000}
    assert time.time() - began < 60


def test_agrees_with_brute_force():
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(200)))) for i in range(2, 40)]
    passages = [(1, " ".join(rng.choice("ab") for _ in range(n))) for n in (13, 14, 60, 300)]
    known = {tuple(t.split()[k : k + 13]) for _, t in passages for k in range(len(t.split()) - 12)}
    want = {(i, j) for i, t in docs for k in range(len(t.split()) - 12) if tuple(t.split()[k : k + 13]) in known for j in range(k, k + 13)}
    assert {(i, j) for i, a, z in found(docs, passages) for j in range(a, z)} == want


def test_without_the_automaton_nothing_is_found(monkeypatch):
    passage = " ".join(f"p{k}" for k in range(20))
    assert found([(2, passage)], [(1, passage)])
    monkeypatch.setattr(sd.Automaton, "hits", lambda self, h: np.zeros(0, np.int64))
    assert not found([(2, passage)], [(1, passage)])


def test_words_of_equal_symbols_are_told_apart(monkeypatch):
    monkeypatch.setattr(sd.w.Words, "hashes", lambda self, values=None: np.zeros(len(self.start), np.uint64))
    assert found([(2, " ".join(f"q{k}" for k in range(20)))], [(1, " ".join(f"p{k}" for k in range(20)))]) == []


@pytest.mark.parametrize("texts", [[], [""], ["a b c"]])
def test_small_inputs(texts):
    assert found([(2, t) for t in texts], [(1, " ".join("abcdefghijklm"))]) == []
    assert found([(2, t) for t in texts], []) == []
