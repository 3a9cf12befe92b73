"""Language ID, license scans, decontamination and URL filters."""

import re
import zlib
from collections import Counter

import pytest

from tesseral.llm.common import cut
from tesseral.llm.decontaminate import Gate, contained, decontaminate
from tesseral.llm.language_id import RANKS, UNKNOWN, held_out, identify, learn, predict
from tesseral.llm.license_scan import NOTICES, PHRASES, WORD, license_scan
from tesseral.llm.url_filter import intervals, url_filter

from .conftest import EDGES, docs

SMALL = "/root/testdata/sf0.01"


def test_languages_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def brute_profile(texts, ranks=RANKS):
    count = Counter()
    for t in texts:
        chars = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        for word in chars.split():
            for n in (1, 2, 3):
                w = word if n == 1 else f"\U0010ffff{word}\U0010ffff"
                count.update(w[k : k + n] for k in range(len(w) - n + 1))
    # the edge comes after all letters, and codes of longer n-grams are larger
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))][:ranks]


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (0x110000 if c == "\U0010ffff" else ord(c))
    return out


def test_profiles_and_distances_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = table.collect()
    langs = sorted({r.lang for r in rows})
    profiles = learn(table)
    mine = {x: brute_profile([r.text for r in rows if r.lang == x]) for x in langs}
    assert {x: [code(g) for g in p] for x, p in mine.items()} == profiles
    places = {x: {g: k for k, g in enumerate(p)} for x, p in mine.items()}
    for r in predict(table, profiles).collect():
        top = brute_profile([r.text])
        apart = [sum(abs(places[x][g] - k) if g in places[x] else RANKS for k, g in enumerate(top)) for x in langs]
        assert r.lang_pred == langs[apart.index(min(apart))]
        assert r.score == pytest.approx(1 - min(apart) / (RANKS * len(top)))


def test_languages_on_edges(spark, edges, nothing):
    rows = identify(edges).collect()
    assert len(rows) == len(EDGES) and {r.lang_pred for r in rows} == {UNKNOWN} and {r.score for r in rows} == {0.0}
    taught = docs(spark, EDGES, "xx")
    got = {r.doc_id: r for r in identify(taught).collect()}
    assert got[1].lang_pred == UNKNOWN and got[3].score == 0.0 and got[6].lang_pred == "xx"
    assert got[9].held_out == (zlib.crc32(b"9") % 4 == 2)
    out = predict(taught, {"xx": [97]})
    assert out.columns == [c for c in taught.columns if c != "score"] + ["lang_pred", "score"] and out.count() == len(EDGES)
    assert identify(nothing).count() == 0


def brute_base(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(k, label) for label, phrase in PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_base_equals_brute_force(spark, corpus):
    extra = [(9001, "Under the MIT-license and UNDER THE MIT LICENSE, under the mit"), (9002, "cc by nc cc by nc-by/nc CC BY NC"), (9003, "Apache License, Version 2.0 apache license version 20"), (9004, "KMIT under the mit licenseé under the mit license é")]
    table = corpus + extra
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(docs(spark, table)).collect()}
    assert got == {d: brute_base(t) for d, t in table}
    assert got[9002][1] == 3 and got[9001][1] == 2


def test_licenses_survive_slips(spark):
    notice = dict((label, text) for label, text in NOTICES)["bsd"]
    words = notice.split()
    near = [(1, notice), (2, " ".join(words[:8] + ["and", "so"] + words[8:])), (3, " ".join(words[:6] + words[7:])), (4, " ".join(words[:9])), (5, " ".join(reversed(words)))]
    got = {r.doc_id: r for r in license_scan(docs(spark, [(k, f"intro words {t} outro") for k, t in near])).collect()}
    assert [got[k].labels for k in range(1, 6)] == ["bsd", "bsd", "bsd", "", ""]
    assert got[1].score == 1 and 0.8 <= got[3].score < 1 and got[5].score == 0 and got[1].base_labels == ""


def test_licenses_do_not_count_rows(spark):
    """A row has the same labels alone and repeated; words put in at many places are found by the votes that are left."""
    notice = dict((label, text) for label, text in NOTICES)["bsd"].split()
    put_in = [*notice[:4], "any", *notice[4:8], "all", *notice[8:12], *notice[13:17], "the", "very", *notice[17:]]
    text = " ".join(["intro", *put_in, "outro"])
    rows = license_scan(docs(spark, [(1, text), (2, text), (2, text), (2, text), (3, " ".join(notice[:3]))])).collect()
    found = {(r.doc_id, r.labels, round(r.score, 9), r.n_words) for r in rows}
    assert len(rows) == 5 and found == {(1, "bsd", round(1 - 1 / len(notice), 9), len(put_in) + 2), (2, "bsd", round(1 - 1 / len(notice), 9), len(put_in) + 2), (3, "", 0.0, 3)}


def test_licenses_on_edges(edges, nothing):
    rows = license_scan(edges).collect()
    assert len(rows) == len(EDGES) and all(r.labels == "" and r.score == 0 and r.n_base == 0 for r in rows)
    assert {r.doc_id: r.n_words for r in rows if r.doc_id}[9] == 120_000
    assert license_scan(nothing).count() == 0


def test_contained_equals_brute_force_in_one_scan(spark, corpus, monkeypatch):
    items = [(k, " ".join(t.split()[10 : 10 + 5 + k % 40])) for k, (_, t) in enumerate(corpus[:60])] + [(100, "of the"), (101, ""), (102, None), (103, "zz yy xx")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def grams(text, n):
        w = "".join(c if not c.isascii() or c.isalnum() else " " for c in (text or "").lower()).split()
        return set(zip(*(w[k:] for k in range(n))))

    expected = set()
    for item, text in items:
        n = min(5, max(len(grams(text, 1)) and len("".join(c if not c.isascii() or c.isalnum() else " " for c in text.lower()).split()), 0))
        own = grams(text, n) if n else set()
        for d, t in corpus if own else []:
            shared = len(own & grams(t, n))
            if shared >= 0.8 * len(own) - 1e-9:
                expected.add((d, item, shared, len(own)))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    table = cut(docs(spark, corpus))
    seen = table.mapInArrow(counted, table.schema)
    whole = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contained(seen, benchmark).collect()}
    assert whole == expected and len(expected) >= 60 and read.value == len(corpus)
    # filters that let everything pass cost rows, not results
    own = Gate.of
    monkeypatch.setattr(Gate, "of", staticmethod(lambda hashes: own(hashes, 1)))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contained(table, benchmark).collect()} == expected
    left = {r.doc_id for r in decontaminate(table, benchmark.where("item_id < 100")).collect()}
    assert left == {d for d, _ in corpus} - {d for d, item, *_ in expected if item < 100}


def test_contained_reports_repeated_rows_each(spark):
    text = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (3, "w1 w2"), (4, "common words")], "item_id long, text string")
    table = docs(spark, [(5, text), (5, text), (None, text.upper()), (6, " ".join(f"w{k}" for k in range(24))), (7, "w1, w2!"), (8, None)])
    got = sorted((r.doc_id or 0, r.item_id, r.n_shared) for r in contained(table, items).collect())
    full = [(1, 26), (1, 26), (2, 26), (3, 1)]
    assert got == sorted([*[(d, *x) for d in (5, 5, 0) for x in full], (6, 3, 1), (7, 3, 1)])
    assert sorted(r.doc_id or 0 for r in decontaminate(table, items.where("item_id < 3")).collect()) == [6, 7, 8]


def test_contained_on_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, "tok10 tok11 tok12 tok13 tok14 tok15"), (2, "")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in contained(edges, items).collect())
    assert got == [(-1, 1), (6, 1), (7, 1), (8, 1)]
    assert decontaminate(edges, items).columns == edges.columns and decontaminate(edges, items).count() == len(EDGES) - 4
    assert contained(nothing, items).count() == 0 and contained(edges, items.limit(0)).count() == 0 and decontaminate(edges, items.limit(0)).count() == len(EDGES)


EVENTS = [
    ("a", "Bad.example.", "2024-01-10", True), ("a", "bad.example", "2024-02-01", False), ("a", "bad.example", "2024-05-20", True), ("a", "bad.example", "2024-05-20", False),
    ("a", "bad.example", "2024-07-01", False), ("b", "x.bad.example", "2023-12-31", True), ("b", "x.bad.example", "2024-03-01", True), ("c", None, "2024-01-01", True), ("c", "nodate", None, True),
]
CAPTURES = [
    (1, "http://bad.example/p", "2024-01-09"), (2, "http://bad.example/p", "2024-01-10"), (3, "https://u:p@WWW.Bad.Example.:8080?q", "2024-01-31"), (4, "http://bad.example", "2024-02-01"),
    (5, "http://x.bad.example/", "2024-01-15"), (6, "http://x.bad.example/", "2025-01-15"), (7, "http://notbad.example", "2024-01-15"), (8, None, "2024-01-15"), (9, "no url", "2024-01-15"), (10, "http://bad.example", None), (2, "http://bad.example/p", "2024-01-10"), (None, "http://bad.example", "2024-01-20"),
]


def test_addresses_have_no_parents(spark):
    events = spark.createDataFrame([("l", "[2001:DB8::1]", "2024-01-01", True), ("l", "2.3.4", "2024-01-01", True), ("l", "1.2.3.4", "2024-01-01", True)], "list string, pattern string, day string, listed boolean")
    urls = ["http://[2001:db8::1]/x", "http://u@[2001:DB8::1]:80?q", "http://1.2.3.4:8080/", "http://9.2.3.4/", "http://a.2.3.4/", "http://[bad/", "http://[::ffff:9.2.3.4]/"]
    captures = spark.createDataFrame([(k, u, "2024-02-02") for k, u in enumerate(urls)], "page_id long, url string, fetched string")
    got = {r.page_id: (r.host, r.blocked) for r in url_filter(captures, events).collect()}
    assert got == {
        0: ("[2001:db8::1]", True), 1: ("[2001:db8::1]", True), 2: ("1.2.3.4", True), 3: ("9.2.3.4", False), 4: ("a.2.3.4", True), 5: (None, False), 6: ("[::ffff:9.2.3.4]", False),
    }


def test_urls(spark):
    events = spark.createDataFrame(EVENTS, "list string, pattern string, day string, listed boolean")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched string").selectExpr("*", "'h' AS host", "1 AS month", "2 AS k")
    out = url_filter(captures, events)
    assert out.columns == ["page_id", "url", "fetched", "month", "k", "host", "lists", "n_entries", "blocked"]
    rows = out.collect()
    assert len(rows) == len(CAPTURES)
    got = {r.page_id: (r.lists, r.n_entries, r.blocked) for r in rows}
    assert got == {1: ("", 0, False), 2: ("a", 1, True), 3: ("a", 1, True), 4: ("", 0, False), 5: ("a,b", 2, True), 6: ("b", 1, True), 7: ("", 0, False), 8: ("", 0, False), 9: ("", 0, False), 10: ("", 0, False), None: ("a", 1, True)}
    assert {r.page_id: r.host for r in rows}[3] == "www.bad.example"
    spans = sorted((r.pattern, str(r.since), str(r.until)) for r in intervals(events).collect())
    assert spans == [("bad.example", "2024-01-10", "2024-02-01"), ("x.bad.example", "2023-12-31", "9999-12-31")]
    assert url_filter(captures.limit(0), events).count() == 0 and url_filter(captures, events.limit(0)).where("blocked").count() == 0
