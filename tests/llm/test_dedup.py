"""Exact, line, near and suffix dedup against brute force."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesseral.llm.common import cut, maybe_in
from tesseral.llm.components import components
from tesseral.llm.exact_dedup import exact_dedup, possibly_repeated
from tesseral.llm import line_dedup as line_module
from tesseral.llm.line_dedup import line_dedup
from tesseral.llm.near_dedup import near_dedup
from tesseral.llm.suffix_dedup import SPAN, LoserTree, anchors, front_decoded, pack, range_bits, suffix_dedup, unpack

from .conftest import BASE, EDGES, docs


def test_exact_on_edges(edges):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup(edges).collect()}
    rows = exact_dedup(edges).collect()
    assert len(rows) == len(EDGES)
    groups = defaultdict(list)
    for d, t in EDGES:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(d)
    for (d, h), r in got.items():
        ids = [x for x in groups[h] if x is not None]
        assert r.group_size == len(groups[h]) and r.keep_id == (max(ids) if ids else None)
        assert r.kept == (d == r.keep_id)


def test_exact_with_a_filter_too_large_to_broadcast(spark, corpus):
    table = docs(spark, corpus + [(d + 10**6, t) for d, t in corpus[::3]])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(exact_dedup(table, max_words=0)) == key(exact_dedup(table))


def test_lines_shuffle_only_places_that_may_be_repeated(spark, monkeypatch):
    """One document in twenty repeats another's lines: few places go into the joins, however many there are."""
    texts = [(k, "\n".join(f"line {j} of {k - k % 20 if k % 20 == 1 else k}" for j in range(12))) for k in range(1000)]
    sent = []
    own = line_module.join_groups
    monkeypatch.setattr(line_module, "join_groups", lambda rows, groups, keys: sent.append(rows.count()) or own(rows, groups, keys))
    out = {r.doc_id: r.text for r in line_dedup(docs(spark, texts)).collect()}
    assert out == {k: "" if k % 20 == 1 else t for k, t in texts}
    assert sum(sent) < 0.4 * 1000 * 11, sent


@pytest.mark.parametrize("n", [3_000, 300_000])
def test_exact_shuffles_the_same_share_at_any_size(spark, n):
    """One row in ten has an equal; the filter lets through these and few others, however many rows there are."""
    rows = cut(spark.range(n).selectExpr("xxhash64(if(id % 10 = 0, id - id % 20, id)) AS h"))
    assert 0.1 <= possibly_repeated(rows).where("maybe").count() / n < 0.115


def test_filters_lose_nothing(spark):
    rows = spark.range(20_000).selectExpr("id", "xxhash64(id) AS h")
    keys = cut(rows.where("id % 50 = 0").select("h"))
    met = {r.id for r in maybe_in(rows, F.col("h"), keys, F.col("h")).collect()}
    assert met >= set(range(0, 20_000, 50)) and len(met) < 900
    assert maybe_in(rows, F.col("h"), cut(keys.limit(0)), F.col("h")).count() == 0


def test_exact_on_nothing(nothing):
    assert exact_dedup(nothing).count() == 0


def test_lines_on_edges(edges, nothing):
    out = line_dedup(edges)
    assert out.columns == [*edges.columns, "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == len(EDGES)
    by = {(r.doc_id, r.n_chars): r for r in rows}
    assert by[1, 0].text is None and by[1, 0].n_lines == 0 and by[2, 0].text == ""
    assert by[16, 10].text == "One\r\nTwo\r\n" and by[16, 10].n_lines == 3
    assert by[15, 6000].n_removed >= 0 and by[6, len(BASE)].text == BASE
    assert line_dedup(nothing).count() == 0


def test_lines_keep_the_first_copy(spark):
    shared = "\n".join(f"shared line number {k} of the passage" for k in range(40))
    table = docs(spark, [(3, f"c one\n{shared}\nc two"), (1, f"a one\na two\n{shared}"), (2, f"{shared}\nb two"), (4, "nothing here\nis shared")])
    got = {r.doc_id: r for r in line_dedup(table).collect()}
    assert got[1].n_removed == 0 and got[4].n_removed == 0
    assert got[2].n_removed > 20 and got[3].n_removed > 20
    for k in (2, 3):
        assert got[k].n_lines - got[k].n_removed == len(got[k].text.split("\n"))
    clash = line_dedup(table.withColumnRenamed("size", "n_lines"))
    assert clash.columns[-2:] == ["_n_lines", "n_removed"] and clash.count() == 4


def brute_lines(pairs, min_lines=2):
    """The lines that stay: of each run of lines that an earlier place has, all go."""
    seen, out = set(), {}
    for d, t in sorted((d, t) for d, t in pairs if t):
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - min_lines + 1):
            window = tuple(lines[i : i + min_lines])
            if window in seen:
                gone.update(range(i, i + min_lines))
            seen.add(window)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)
    return out


@pytest.mark.parametrize("n", range(2, 9))
def test_lines_take_short_passages_whole(spark, n):
    """Passages of n lines between neighbours that differ go from all places but the first, with no line left."""
    table = []
    for p in range(12):
        shared = [f"line {k} of passage {p} among {n}" for k in range(n)]
        for copy in range(3):
            own = [f"own {p} {copy} {k}" for k in range(5)]
            table.append((100 * copy + p, "\n".join(own[: 1 + copy] + shared + own[1 + copy :])))
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(docs(spark, table)).collect()}
    for d, t in table:
        own = "\n".join(x for x in t.split("\n") if x.startswith("own"))
        assert got[d] == ((t, 0) if d < 100 else (own, n))


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_lines_equal_brute_force(spark, corpus, min_lines):
    part = [(d, t) for d, t in corpus if t] + [(10**6, "x\n" * 3000), (10**6 + 1, "x\nx"), (10**6 + 2, "y\nx\nx\n\nz"), (10**6 + 3, "z\n\nz\n\nz")]
    rows = line_dedup(docs(spark, part), min_lines=min_lines).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows} == brute_lines(part, min_lines)


def sets_of(pairs, gram=5):
    out = {}
    for d, t in pairs:
        w = tuple((t or "").encode().lower().split())
        out[d] = set(zip(*(w[k:] for k in range(gram)))) if len(w) >= gram else ({w} if w else set())
    return out


def brute_components(sets, percent):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_equals_brute_force(spark, corpus, percent):
    sets = sets_of(corpus)
    expected = brute_components(sets, percent)
    got = {r.doc_id: r for r in near_dedup(docs(spark, corpus), percent=percent).collect()}
    assert {d: r.component_id for d, r in got.items()} == expected
    assert all(r.n_shingles == len(sets[d]) and r.kept == (r.component_id == d) for d, r in got.items())


def test_near_links_chains_and_stars(spark):
    """Copies that resemble an original, or only each other's neighbours, are one component; others stay apart."""
    words = BASE.split() * 1
    star = [(100 + k, " ".join(w if j != 5 + 2 * k else f"new{k}" for j, w in enumerate(words))) for k in range(40)]
    chain = [(500 + k, " ".join(f"c{j}" if j >= 2 * k else f"d{j}" for j in range(150))) for k in range(30)]
    table = star + [(300, BASE)] + chain + [(900, " ".join(f"z{j}" for j in range(100)))]
    got = {r.doc_id: r.component_id for r in near_dedup(docs(spark, table)).collect()}
    assert got == brute_components(sets_of(table), 85)


def test_near_links_all_texts_of_a_repeated_doc_id(spark):
    """Two texts of one doc_id, each with a near copy of its own: one component, named by its smallest doc_id."""
    one, two = (" ".join(f"{c}{k}" for k in range(120)) for c in "pq")
    table = [(5, one), (5, two), (9, one + " more"), (3, two + " more"), (8, " ".join(f"z{k}" for k in range(120))), (5, two), (-7, None), (8, None)]
    rows = near_dedup(docs(spark, table)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == [
        (-7, 0, -7, True), (3, 117, 3, True), (5, 116, 3, False), (5, 116, 3, False), (5, 116, 3, False), (8, 0, 8, True), (8, 116, 8, True), (9, 117, 3, False),
    ]


def test_near_on_edges(edges, nothing):
    rows = near_dedup(edges).collect()
    assert len(rows) == len(EDGES)
    got = {(r.doc_id, r.n_shingles): r for r in rows}
    assert got[1, 0].kept and got[2, 0].component_id == 2 and got[3, 0].kept
    assert got[4, 1].component_id == 4 and got[14, 1].component_id == 4 and got[17, 1].component_id == 4
    assert got[7, 116].component_id == 6 and got[8, 116].component_id == 6 and got[10, got_n(rows, 10)].component_id == 9
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup(nothing).count() == 0


def got_n(rows, doc):
    return next(r.n_shingles for r in rows if r.doc_id == doc)


def test_components(spark):
    path = [(k, k + 1) for k in range(60)]
    edges = path + [(200, 201), (201, 200), (300, 300)] + [(400, k) for k in range(401, 440)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 201: 200, **{k: 400 for k in range(401, 440)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffix(pairs):
    seen, out = set(), {}
    for d, t in sorted(pairs):
        b = (t or "").encode()
        mark, new = bytearray(len(b)), []
        for i in range(len(b) - SPAN + 1):
            if b[i : i + SPAN] in seen:
                mark[i : i + SPAN] = b"\1" * SPAN
            else:
                new.append(b[i : i + SPAN])
        seen.update(new)
        runs = sum(1 for i in range(len(b)) if mark[i] and not (i and mark[i - 1]))
        out[d] = (bytes(c for c, m in zip(b, mark) if not m), len(b), runs)
    return out


def test_suffix_equals_brute_force(spark, corpus):
    part = corpus[:120] + [(10**6, LONG_RUN), (10**6 + 1, LONG_RUN[7:] + "tail"), (10**6 + 2, "ab" * 4000), (10**6 + 3, "xx" + "ab" * 300), (10**6 + 4, "\0" * 300), (10**6 + 5, "q" + "\0" * 120)]
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_spans) for r in suffix_dedup(docs(spark, part)).collect()}
    assert got == brute_suffix(part)


def test_suffix_tells_rows_of_a_doc_id_apart(spark):
    """Texts of one doc_id are not each other's smaller document, and each loses what is its own."""
    x, y, z = (" ".join(f"{c}{k * k}" for k in range(60)) for c in "xyz")
    least = -(1 << 63)
    table = [(1, x), (2, x), (2, y), (2, x), (3, y + z), (3, z + x), (least, z), (4, None), (4, z)]
    got = sorted((r.doc_id, bytes(r.kept).decode(), r.n_bytes, r.n_spans) for r in suffix_dedup(docs(spark, table)).collect())
    assert got == sorted([
        (1, x, len(x), 0), (2, "", len(x), 1), (2, y, len(y), 0), (2, "", len(x), 1), (3, "", len(y + z), 1 if len(y + z) else 0), (3, "", len(z + x), 1), (least, z, len(z), 0), (4, "", 0, 0), (4, "", len(z), 1),
    ])


def test_suffix_ranges_have_no_ceiling():
    assert [range_bits(n) for n in (0, 100 << 20, 1 << 43, 100 << 40, 1 << 60)] == [3, 4, 21, 24, 31]


LONG_RUN = "".join(chr(97 + (k * k * 7 + k // 13) % 26) for k in range(3_000_000 // 2))


def test_suffix_on_edges(edges, nothing):
    rows = suffix_dedup(edges).collect()
    assert len(rows) == len(EDGES)
    assert sorted(bytes(r.kept) for r in rows if r.doc_id is None) == [b"", f"no id {BASE}".encode()]
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_bytes == 0 and bytes(by[7].kept) == b"" and bytes(by[10].kept) in (b" end", b"end", b"")
    assert suffix_dedup(nothing).count() == 0


@given(st.lists(st.lists(st.binary(min_size=4, max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=9))
@settings(max_examples=150)
def test_loser_tree_merges_and_knows_prefixes(runs):
    def prefix(a, b):
        return next((k for k in range(4) if a[k] != b[k]), 4)

    runs = [sorted(r) for r in runs]
    coded = [(r, [0] + [prefix(a, b) for a, b in zip(r, r[1:])]) for r in runs]
    if not runs:
        return
    of, at, shared = LoserTree(coded).merge()
    out = [runs[r][k] for r, k in zip(of, at)]
    assert out == sorted(x for r in runs for x in r)
    assert shared[1:] == [prefix(a, b) for a, b in zip(out, out[1:])]


@given(st.binary(min_size=SPAN, max_size=400), st.binary(max_size=30))
def test_equal_windows_have_equal_anchors(text, before):
    """Every window of a text has an anchor, wherever the text stands."""
    one = {int(p): int(h) for _, p, h in zip(*anchors([text]))}
    other = {int(p) - len(before): int(h) for _, p, h in zip(*anchors([before + text]))}
    for start in range(len(text) - SPAN + 1):
        inside = [p for p in one if start <= p <= start + SPAN - 24]
        assert inside and any(other.get(p) == one[p] for p in inside)


def test_packing():
    import numpy as np

    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([-1, 2**62]), np.array([7], np.uint8)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    assert front_decoded(np.array([0, 2, 3], np.uint8), np.frombuffer(b"abcd", np.uint8), 3) == [b"abc", b"abd", b"abd"]
