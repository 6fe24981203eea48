"""The pipeline's stages, each against brute force on what the stage before it kept."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from driftmap.llm import bpe


def words(text):
    return (text or "").encode().split()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def after_rules(rows):
    spread, size = defaultdict(set), defaultdict(set)
    norm = lambda line: tuple(low(line).encode().split())
    for i, t, _, s, _ in rows:
        size[s].add(i)
        for line in (t or "").split("\n"):
            spread[s, norm(line)].add(i)
    out = {}
    for i, t, _, s, _ in rows:
        w, at, again = words(t), defaultdict(list), set()
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        for v in at.values():
            again |= {j for k in v if len(v) > 1 for j in range(k, k + 5)}
        common = lambda x: norm(x) and len(spread[s, norm(x)]) > 4 and 100 * len(spread[s, norm(x)]) > 5 * len(size[s])  # noqa: B023, E731
        left = [x for x in (t or "").split("\n") if not common(x)]
        n = len(words("\n".join(left)))
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and (n == len(w) or 100 * n >= 50 * len(w)):
            out[i] = "\n".join(left)
    return out


def after_near(docs):
    sets = {}
    for i, t in docs.items():
        w = low(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: t for i, t in docs.items() if label[i] == i}


def after_substring(docs):
    first, out = {}, {}
    for i, t in docs.items():
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    for i, t in docs.items():
        w = words(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        if not gone:
            out[i] = t
        elif len(gone) < len(w):
            out[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
    return out


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    folder, at, out = tmp_path_factory.mktemp("stages"), docs, []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        found = f(spark, at, "")
        if k < 4:
            assert found.columns == docs.columns and [t for _, t in found.dtypes] == [t for _, t in docs.dtypes], name
        found.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        out.append(at.collect())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "bpe"]


def test_filters_and_dedup(stages, rows):
    want = after_rules(rows)
    for got, step in zip(stages[:3], (None, after_near, after_substring), strict=True):
        want = step(want) if step else want
        assert {r.doc_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert len(want) < len(rows)


def test_the_mix_takes_words_of_its_documents(stages):
    before = {r.doc_id: r for r in stages[2]}
    size, taken = Counter(), Counter()
    for r in stages[2]:
        size[r.source] += len(words(r.text))
    for r in stages[3]:
        had, got = Counter(words(before[r.doc_id].text)), Counter(words(r.text))
        assert all(n <= 3 * had[x] for x, n in got.items()) and r.source == before[r.doc_id].source
        taken[r.source] += sum(got.values())
    assert abs(sum(taken.values()) - sum(size.values())) < 0.1 * sum(size.values())


def test_encoding_is_the_librarys(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    texts = {r.doc_id: r.text for r in stages[3]}
    assert {r.doc_id for r in stages[4]} == set(texts) and len(stages[4]) == len(texts)
    for r in stages[4]:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_and_odd_tables(spark, empty, odd):
    for table in (empty, odd):
        for _, f in corpus_pipeline.STAGES:
            found = f(spark, table, "").collect()
            assert found or table is empty
