"""Operators against brute force on small documents, and on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict

from driftmap.llm import bpe, license_scan, media_chunks, mixing, near_dedup, quality_rules, substring_dedup, url_filter, warc, weak_labels


def words(text):
    return (text or "").encode().split()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_substring_dedup_matches_brute_force(docs, rows):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want
    assert any(n for _, n, _ in want.values())


def test_near_dedup_matches_brute_force(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = low(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_dedup_links_a_chain_whose_least_member_is_far(spark):
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):  # neighbours share most words, ends share few
        rows.append((i, " ".join(base[i : i + 0] + [f"w{k}" for k in range(i, i + 60)])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_url_rules_of_one_length_are_judged_alike_in_both_ways(spark, monkeypatch):
    rules = [("block", "b.com", "/aa"), ("allow", "a.b.com", "/"), ("block", "x.org", "/p"), ("allow", "x.org", "/p")] + [("block", f"r{k}.net", "/") for k in range(220)]
    urls = ["http://a.b.com/aa", "http://b.com/aa", "http://x.org/pq", "http://r7.net/", "http://s.r7.net", "nothing", None, "http:///p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    listed = spark.createDataFrame([("b.com/aa",)], "canonical string")
    by_join = sorted(map(tuple, url_filter.filter_urls(pages, listed, rules).collect()))
    monkeypatch.setattr(url_filter, "EXPRESSION_RULES", 1000)
    assert by_join == sorted(map(tuple, url_filter.filter_urls(pages, listed, rules).collect()))
    assert {r[0]: r[4] for r in by_join} == {0: "b.com/aa", 1: "b.com/aa", 2: "x.org/p", 3: "r7.net/", 4: None, 5: None, 6: None, 7: None}
    assert {r[0]: r[6] for r in by_join}[2] == "allow"


def test_near_dedup_keeps_a_row_of_every_component_where_ids_repeat(spark):
    prose = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    edited = [t + " end" for t in prose]
    rows = [(1, edited[0]), (5, prose[0]), (5, prose[1]), (6, edited[1]), (5, prose[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (5, 5, True), (6, 5, False)]
    assert sorted(map(tuple, near_dedup.drop_near_duplicates(df).collect())) == [(1, edited[0]), (5, prose[1])]


def test_quality_counts(docs, rows):
    for r in quality_rules.quality_rules(docs).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        w = words(text)
        assert r.n_words == len(w)
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        lines = [x for x in text.split("\n") if words(x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        assert r.n_repeat_words == len({j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)})
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))


def test_quality_rules_remove_lines_of_many_documents(spark):
    rows = [(i, "A Common  line of this host\n" + f"own words of number {i} are here and stay " * 1, "s") for i in range(30)] + [(99, "a common line of this host a b c d\nA common line of this host", "s"), (100, "A common line of this host\n" * 3, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert got[0].n_removed_words == 6 and got[0].kept
    assert not got[100].kept
    texts = {r.doc_id: r.text for r in quality_rules.clean_documents(df).collect()}
    assert "Common" not in texts[0] and texts[0].startswith("own words")
    assert 100 not in texts


def test_bpe_is_the_library(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    extra = ["<|endoftext|>", "a  <|endoftext|>  b\n\n c", "don't I'LL 'sfoo #'s a'", "x  y　 z", "12ab34 $%^é", "\x1c \x85 x", "🙂 👩‍👧 ok  "]
    every = [(i, x) for i, x, *_ in rows] + list(enumerate(extra, 1000))
    df = docs.sparkSession.createDataFrame(every, "doc_id bigint, text string")
    ids = {r.doc_id: list(r.ids) for r in bpe.encode(df).collect()}
    assert ids == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in every}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t.decode(ids[i], skip_special_tokens=False) for i in ids}


def test_media_come_back(docs, rows):
    for r in media_chunks.stored_media(docs).collect():
        text = (next(t for i, t, *_ in rows if i == r.doc_id) or "").encode()
        payload = media_chunks.payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media_chunks.to_wav(payload)).hexdigest()


def test_chunks_follow_content():
    a = random.Random(1).randbytes(60_000)
    cut = {media_chunks.digest(c) for c in media_chunks.chunks_of(media_chunks.to_wav(b"0123" * 300 + a))}
    other = {media_chunks.digest(c) for c in media_chunks.chunks_of(media_chunks.to_wav(a))}
    assert cut & other
    assert b"".join(media_chunks.chunks_of(media_chunks.to_wav(a))) == media_chunks.to_wav(a)


def test_licenses(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "x " * 30 + "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"), (3, "CC BY all rights reserved"), (4, None), (5, "license apache under licensed the"), (6, "General Public License")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].labels == "apache-2.0" and got[1].score == 1.0
    assert got[2].labels == "mit" and 0.6 <= got[2].score < 1
    assert (got[3].base_labels, got[3].n_base, got[3].first_word, got[3].last_word) == ("cc-by,reserved", 2, 0, 2)
    assert (got[4].labels, got[4].n_words, got[4].first_word, got[4].score) == ("", 0, None, 0.0)
    assert got[5].labels == "" and got[6].labels == "gpl"


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?y"), (2, "http://example.net/de"), (3, "no scheme"), (4, None), (5, "http://x.org"), (6, "http://x.org/fr/1"), (7, "http://notnet/"), (8, "http://www.spam.com/a.html#f"), (9, "http://example.com/de/"), (10, "http://net")]
    listed = spark.createDataFrame([("spam.com/a",), (None,), ("",), ("spam.com/a",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), listed).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "/de", "net/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("x.org", "", None, "allow"), 6: ("x.org", "/fr/1", "org/fr/", "allow"), 7: ("notnet", "/", None, "allow"), 8: ("www.spam.com", "/a.html", None, "block"),
        9: ("example.com", "/de/", "example.com/de/", "block"), 10: ("net", "", None, "allow"),
    }


def test_bloom_passes_every_listed_url(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.com/p') as canonical")
    pages = spark.range(6000).selectExpr("id as page_id", "concat('http://h', id, '.com/p/') as url")
    got = url_filter.filter_urls(pages, listed).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 3000, "allow": 3000}


def test_urls_by_the_large_ways(spark, monkeypatch):
    """Rules as a joined table, and a filter that is joined by block number."""
    rng = random.Random(9)
    hosts = ["net", "a.net", "example.net", "x.example.net", "example.com", "y.example.com", "a.org", "org", "spam.com", "www.spam.com", ""]
    rows = [(i, rng.choice([f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/x', '/de/1', '/fr/', '/a.html'])}", None, "x"])) for i in range(300)]
    pages, listed = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame([("spam.com/a",), ("a.org",)], "canonical string")
    want = sorted(map(tuple, url_filter.filter_urls(pages, listed).collect()), key=str)
    assert {r[4] for r in want} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"} and any(r[5] for r in want)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, url_filter.filter_urls(pages, listed).collect()), key=str) == want
    monkeypatch.setattr(url_filter, "EXPRESSION_RULES", 0)
    assert sorted(map(tuple, url_filter.filter_urls(pages, listed).collect()), key=str) == want


def test_odd_pages(spark):
    rows = [(None, "http://a.net/x", "<p>x"), (1, None, None), (1, None, None), (2, "", ""), (3, "http://b/", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'q' as host", "'r' as rule", "1 as text", "2 as block", "3 as payload", "'h' as http")
    listed = spark.createDataFrame([], "canonical string")
    assert url_filter.filter_urls(pages, listed).count() == 5 and url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert warc.derivatives(warc.responses(pages)).count() == 10 and warc.derivatives(warc.responses(pages.limit(0))).count() == 0


ODD = {
    "dedup": substring_dedup.remove_repeats,
    "texts": substring_dedup.dedup_texts,
    "near": near_dedup.near_duplicates,
    "drop": near_dedup.drop_near_duplicates,
    "rules": quality_rules.quality_rules,
    "clean": quality_rules.clean_documents,
    "bpe": bpe.round_trip,
    "mix": mixing.mixed_sizes,
    "mixed": mixing.mixed_documents,
    "media": media_chunks.stored_media,
    "license": license_scan.scan_licenses,
    "weak": weak_labels.classify,
}


def test_empty_tables(empty):
    for name, f in ODD.items():
        assert f(empty).count() == 0, name


def test_nulls_repeats_and_clashing_columns(odd):
    for name, f in ODD.items():
        n = len(f(odd).collect())
        if name not in ("texts", "drop", "clean", "mixed"):
            assert n == odd.count(), name


def test_repeated_rows_have_one_result(odd):
    got = [r for r in substring_dedup.remove_repeats(odd).collect() if r.doc_id == 5]
    assert [r.n_removed for r in got] == [0, 0, 0]
    assert [r.n_removed for r in substring_dedup.remove_repeats(odd).collect() if r.doc_id == 6] == [15]
    assert Counter(r.component_id for r in near_dedup.near_duplicates(odd).collect() if r.doc_id == 6) == {5: 1}


def test_a_very_long_text_is_worked_on_whole(spark):
    """Two copies of 150,000 words, the second with a changed first word, beside a short text."""
    long = " ".join(f"w{k * 7919 % 50021}" for k in range(150_000))
    table = spark.createDataFrame([(1, long, "en", "s", 1), (2, "x" + long, "en", "s", 1), (3, "short text", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    dedup = {r.doc_id: r for r in substring_dedup.remove_repeats(table).collect()}
    assert (dedup[1].n_removed, dedup[2].n_removed) == (0, 149_999)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(table).collect()} == {1: 150_000, 2: 150_000, 3: 2}
    back = {r.doc_id: r for r in bpe.round_trip(table).collect()}
    assert back[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert {r.doc_id: r.n_bytes for r in media_chunks.stored_media(table).collect()}[2] == len(long) + 1
    assert sum(r.size for r in mixing.mixed_sizes(table).collect()) == 300_002
    assert {r.doc_id: r.n_words for r in license_scan.scan_licenses(table).collect()}[1] == 150_000
    assert {r.doc_id: r.n_words for r in weak_labels.classify(table).collect()}[1] == 150_000


def test_near_copies_of_one_document_are_dealt_in_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "COPY_PAIRS", 4)
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(base[: i % 40 + 5] + [f"x{i}"] + base[i % 40 + 6 :])) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}
