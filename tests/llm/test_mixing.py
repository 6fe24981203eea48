"""Source mixing: targets, draws that decide, permutations, and the blocks of shards."""

import bisect
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from driftmap.llm import mixing


def words(text):
    return (text or "").encode().split()


def by_hand(size):
    """Targets of sources by repeated sharing. size: source -> words."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    left, total, want = set(order), float(sum(size.values())), {}
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * size[s]}
        if not over:
            return want | share
        for s in over:
            want[s] = 3.0 * size[s]
            total -= want[s]
            left.discard(s)
    return want


@pytest.fixture(scope="module")
def many(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1 + i * 7 % 90)), f"s{min(i % 11, 6)}" if i % 5 else "s0") for i in range(900)]
    rows += [(9000, "only a few words", "small"), (9001, None, "empty"), (9002, "of no source", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows


def taken_of(got, rows):
    source, size, taken, target = {i: s for i, _, s in rows}, Counter(), Counter(), {}
    for r in got:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    return size, taken, target


def test_targets_and_draws(many):
    docs, rows = many
    runs = {}
    for seed in (1, 2):
        got = mixing.mixed_sizes(docs, block=16, seed=seed).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows)
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
        size, taken, target = taken_of(got, rows)
        want = by_hand(size)
        for s, t in want.items():
            assert abs(target[s] - t) < 1e-6 * max(1, t)
            assert abs(taken[s] - t) <= 16 + 4 * (16 * t) ** 0.5  # four standard deviations
        runs[seed] = {r.doc_id: r.taken for r in got}
    assert runs[1] != runs[2]
    again = mixing.mixed_sizes(docs.repartition(7), block=16, seed=1).collect()
    assert {r.doc_id: r.taken for r in again} == runs[1]


def test_the_draws_decide_what_is_taken(many, monkeypatch):
    docs, _ = many
    plain = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs, block=16).collect()}
    real = mixing.draw_shards
    monkeypatch.setattr(mixing, "draw_shards", lambda *a: real(*a).filter("shard % 2 = 0"))
    half = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs, block=16, shard_slots=100).collect()}
    assert sum(half.values()) < 0.7 * sum(plain.values())


def test_draws_are_multinomial(spark):
    """Every slot of a shard is drawn: counts have a multinomial's means and variances, also where a shard's expected numbers are large."""
    slots = {0: 50_050.0, 1: 25_025.0, 2: 12_425.0, 3: 12_500.0}
    sources = spark.createDataFrame(list(slots.items()), "no bigint, slots double")
    rows = mixing.draw_shards(sources, shard_slots=1000).collect()
    counts = np.zeros((100, 4))
    for r in rows:
        counts[r.shard, r.no] = r.n
    assert (counts.sum(1) == 1000).all()
    for no, mean in slots.items():
        share = mean / 100_000
        assert abs(counts[:, no].sum() - mean) < 4 * (mean * (1 - share)) ** 0.5
        assert 0.6 < counts[:, no].var() / (1000 * share * (1 - share)) < 1.6
    both = np.cov(counts[:, 0], counts[:, 1])[0, 1] / (-1000 * 0.5005 * 0.25025)
    assert 0.3 < both < 1.8


M = 1 << 64


def spark_hash(*values, seed=42):
    """xxhash64 of a row of null, bool, int (as ("int", v)), long and string values."""
    for v in values:
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else (int(v).to_bytes(4, "little") if isinstance(v, bool) else v[1].to_bytes(4, "little") if isinstance(v, tuple) else (v % M).to_bytes(8, "little"))
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - M if seed >= M // 2 else seed


def scrambled(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * factor % M
    return x ^ (x >> 33)


def permuted(k, n, key):
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        a, b = k >> half, k & low
        for r in range(1, 5):
            a, b = b, a ^ (scrambled(b ^ scrambled((key + r * 0x9E3779B97F4A7C15) % M)) & low)
        k = (a << half) | b
        if k < n:
            return k


def taken_by_hand(rows, block, shard_slots, seed):
    """The words taken of each row: sizes, targets, draws of every slot, permutations and packing, in plain Python."""
    size = [len(words(t)) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    order, target = sorted(total, key=lambda s: (s is None, s or "")), by_hand(total)
    blocks = {s: -(-total[s] // block) for s in order}
    due = {s: target[s] * blocks[s] / total[s] if total[s] else 0.0 for s in order}
    line, end = [], 0
    for s in order:
        if due[s] > 0:
            end += max(1, int(due[s] * (1 << 20)))
            line.append((end, s))
    drawn, times = Counter(), {s: Counter() for s in order}
    for i in range(round(sum(due.values()))):
        s = line[bisect.bisect_right([e for e, _ in line], spark_hash(("int", seed), i) % end)][1]
        drawn[s] += 1
    for no, s in enumerate(order):
        for j in range(min(drawn[s], 3 * blocks[s])):
            key = scrambled((no * 3 + j // blocks[s] + scrambled(seed)) % M)
            times[s][permuted(j % blocks[s], blocks[s], key)] += 1
    parts, streams = -(-len(rows) // mixing.PART_DOCUMENTS), defaultdict(list)
    for at, (i, t, s) in enumerate(rows):
        cols = [i is None, i, s is None, s, t is None, t]
        key = spark_hash(*cols), spark_hash(("int", 71), *reversed(cols))
        streams[s].append((spark_hash(("int", seed), *key) % parts, spark_hash(*key), key, at))
    out = [0] * len(rows)
    for s, stream in streams.items():
        start = 0
        for *_, at in sorted(stream):
            for k in range(start, start + size[at]):
                out[at] += times[s][k // block]
            start += size[at]
    return out


@pytest.mark.parametrize("block, shard_slots, seed", [(16, 64, 3), (5, 1000, 4)])
def test_agrees_with_plain_python(many, block, shard_slots, seed):
    docs, rows = many
    got = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs, block, shard_slots, seed).collect()}
    assert got == {i: n for (i, *_), n in zip(rows, taken_by_hand(rows, block, shard_slots, seed), strict=True)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_sources_come_near_their_targets(spark):
    got = mixing.op2_source_mix(spark, "/root/testdata/sf0.01").groupBy("source_size", "target").sum("taken").collect()
    slots = [r.target / mixing.BLOCK_WORDS for r in got]
    errors = [abs(r["sum(taken)"] / r.target - 1) for r in got]
    assert all(e < 4 / n**0.5 + 1 / n for e, n in zip(errors, slots, strict=True))
    assert max(errors) < 0.12 and sum(errors) / len(errors) < 0.05


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 256, 1000):
        at = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 5))
        assert sorted(at.tolist()) == list(range(n))
    assert not np.array_equal(mixing.permute(np.arange(99), np.full(99, 99), np.full(99, 1)), mixing.permute(np.arange(99), np.full(99, 99), np.full(99, 2)))


def test_blocks_hold_the_words_taken(many):
    docs, rows = many
    text = {i: words(t) for i, t, _ in rows}
    got = mixing.mixed_blocks(docs, block=16, shard_slots=50).collect()
    slots, seen, taken = defaultdict(list), Counter(), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        seen[r.source, r.turn, r.block] += 1
        found = words(r.text)
        assert 0 < len(found) <= 16
        held = [x for i in r.doc_ids for x in text[i]]
        assert any(held[k : k + len(found)] == found for k in range(len(held) - len(found) + 1))
        for x in found:
            taken[int(x.split(b"x")[0][1:]) if x.startswith(b"w") and b"x" in x else None] += 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(seen.values()) == 1  # in a pass each block comes up once
    sizes = Counter()
    for r in mixing.mixed_sizes(docs, block=16, shard_slots=50).collect():
        sizes[r.doc_id if r.doc_id < 9000 else None] += r.taken
    assert {k: v for k, v in sizes.items() if v} == dict(taken)


def test_mixed_texts_have_the_words_taken(docs):
    sizes, texts = Counter(), Counter()
    for r in mixing.mixed_sizes(docs).collect():
        sizes[r.doc_id] += r.taken
    for r in mixing.mixed_documents(docs).collect():
        texts[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in sizes.items() if v} == dict(texts)
