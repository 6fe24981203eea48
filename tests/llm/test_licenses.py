"""License templates: whole texts and headers, in part, changed, and beside each other."""

import pytest

from driftmap.llm import license_scan as ls


@pytest.fixture(scope="module")
def scanned(spark):
    by = {}
    for label, text in ls.license_templates():
        by.setdefault(label, []).append(text)
    pick = lambda label, start: next(t for t in by[label] if t.lstrip().startswith(start))
    mit, gpl = pick("mit", "Permission"), pick("gpl-3.0", "This program")
    changed = gpl.split()
    changed[20:20] = ["inserted", "words", "here"]
    del changed[60:63]
    rows = [
        (1, mit), (2, mit.split("\n\n", 1)[1]), (3, " ".join(changed)), (4, pick("gpl-2.0", "This program")), (5, pick("lgpl-3.0", "This library")), (6, max(by["gpl-3.0"], key=len)),
        (7, max(by["apache-2.0"], key=len)), (8, "prose " * 50 + mit + " more prose " * 50 + by["isc"][0]), (9, " ".join(sorted(mit.split()))), (10, "the software and the license of the program"),
        (11, by["bsd-3-clause"][0]), (12, max(by["mpl-2.0"], key=len)), (13, by["cc0-1.0"][0]),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, {r.doc_id: r for r in ls.scan_licenses(docs).collect()}


def test_labels(scanned):
    _, got = scanned
    labels = {i: set(r.labels.split(",")) - {"", "gpl", "reserved"} for i, r in got.items()}
    assert labels == {1: {"mit"}, 2: {"mit"}, 3: {"gpl-3.0"}, 4: {"gpl-2.0"}, 5: {"lgpl-3.0"}, 6: {"gpl-3.0"}, 7: {"apache-2.0"}, 8: {"mit", "isc"}, 9: set(), 10: set(), 11: {"bsd-3-clause", "bsd"}, 12: {"mpl-2.0"}, 13: {"cc0-1.0"}}
    assert got[1].score == 1 and 0.5 <= got[2].score < 1


def test_texts_without_a_telling_word_hold_nothing(scanned, monkeypatch):
    docs, got = scanned
    monkeypatch.setattr(ls, "telling_words", lambda t: sorted({x for _, text in t for x in ls._split(text)}))
    assert {r.doc_id: r for r in ls.scan_licenses(docs).collect()} == got


def test_templates_as_a_joined_table(scanned, monkeypatch):
    docs, got = scanned
    monkeypatch.setattr(ls, "BROADCAST_WORDS", 0)
    assert {r.doc_id: r for r in ls.scan_licenses(docs).collect()} == got
