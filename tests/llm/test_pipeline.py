"""The pipeline's stages against brute force, and their defined cases."""

import json

import pytest

import corpus_pipeline
from tesseral.llm.language_id import RANKS

from ..conftest import SMALL
from .test_dedup import brute_components, brute_lines, sets_of

COLUMNS = corpus_pipeline.COLUMNS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=True):
    """Rows (doc_id, text, lang) with columns whose names clash with those that stages use inside."""
    df = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], SCHEMA)
    return df.selectExpr("*", "1 AS ids", "'x' AS decoded", "2 AS score", "'y' AS lang_pred", "3 AS bucket", "4 AS _key", "5 AS word") if extra else df


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    return [tuple(r) for r in rows]


def brute_score(text, profiles):
    """The best score of a text, by plain lists: out-of-place distance to each language's ranked n-grams."""
    grams = brute_grams(text)
    top = [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))][:RANKS]
    if not top:
        return 0.0
    return max(1 - sum(abs(p.index(g) - k) if g in p else RANKS for k, g in enumerate(top)) / (RANKS * len(top)) for p in profiles)


def brute_grams(text):
    out = {}
    word = []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(ord(c))
            continue
        if word:
            edged = [0x110000, *word, 0x110000]
            for g in [(x,) for x in word] + list(zip(edged, edged[1:])) + list(zip(edged, edged[1:], edged[2:])):
                # the order of codes: shorter n-grams have smaller ones
                key = (len(g), g)
                out[key] = out.get(key, 0) + 1
        word = []
    return out


def test_language_stage(spark, small):
    part = small[:60] + [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "123 456 !", "fr"), (10**6 + 3, small[0][1], None), (None, small[1][1], "xx"), (10**6 + 4, "qxz zqx " * 30, None)]
    profiles = []
    for lang in sorted({x for _, _, x in part if x}):
        sums = {}
        for _, t, x in part:
            if x == lang and t is not None:
                for g, n in brute_grams(t).items():
                    sums[g] = sums.get(g, 0) + n
        profiles.append([g for g, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0]))][:RANKS])
    expected = sorted((d or -1, t) for d, t, _ in part if brute_score(t, profiles) >= corpus_pipeline.LEAST_SCORE)
    out = corpus_pipeline.language_id(spark, table(spark, part), SMALL)
    assert out.columns == COLUMNS
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == expected
    assert {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 4}.isdisjoint(d for d, _ in expected) and (10**6 + 3, small[0][1]) in expected
    unlabelled = corpus_pipeline.language_id(spark, table(spark, [(d, t, None) for d, t, _ in part[:3]]), SMALL)
    assert unlabelled.count() == 0


def test_line_stage(spark, small):
    part = [(d, t) for d, t, _ in small if t] + [(10**6, "x\n" * 40), (10**6 + 1, "x\nx"), (10**6 + 2, "a\nb\nc"), (10**6 + 3, "q\na\nb\nc\nr")]
    out = corpus_pipeline.line_dedup_stage(spark, table(spark, [(d, t, None) for d, t in part] + [(10**7, None, None), (10**7 + 1, "", None)]), SMALL)
    rows = {r.doc_id: r for r in out.collect()}
    expected = {d: t for d, (t, _, _) in brute_lines(part).items()}
    assert out.columns == COLUMNS and {d: r.text for d, r in rows.items() if d < 10**7} == expected
    assert rows[10**7].text is None and rows[10**7].n_chars is None and rows[10**7 + 1].text == "" and all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)


def test_near_stage(spark, small):
    long = " ".join(f"w{k}" for k in range(40_000))
    part = [(d, t) for d, t, _ in small[:120]] + [(10**6, long), (10**6 + 1, long + " end"), (10**6 + 2, None), (10**6 + 3, "")]
    kept = {d for d, c in brute_components(sets_of(part), corpus_pipeline.SIMILAR).items() if c == d}
    twice = part + [part[5], (None, part[0][1]), (None, None)]
    out = corpus_pipeline.near_dedup_stage(spark, table(spark, [(d, t, None) for d, t in twice]), SMALL)
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert out.columns == COLUMNS and got == sorted([*[d for d, _ in part if d in kept], *([part[5][0]] if part[5][0] in kept else []), -1, -1])


def test_decontamination_stage(spark, small, tmp_path):
    items = [(k, " ".join(t.split()[:30])) for k, (_, t, _) in enumerate(small[:9])] + [(100, None), (101, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def grams(text):
        w = "".join(c if not c.isascii() or c.isalnum() else " " for c in (text or "").lower()).split()
        n = min(5, len(w))
        return set(zip(*(w[k:] for k in range(n)))) if n else set()

    sets = [grams(t) for _, t in items if grams(t)]
    rows = small[:80] + [(10**6, None, None), (None, "", None), (10**6 + 1, "Before. " + items[3][1].upper() + " after", None)]
    expected = sorted((d if d is not None else -1) for d, t, _ in rows if not any(len(s & grams(t)) >= 0.8 * len(s) - 1e-9 for s in sets))
    out = corpus_pipeline.decontaminate_stage(spark, table(spark, rows), str(tmp_path))
    assert out.columns == COLUMNS and sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == expected and len(expected) < 75


def test_sentencepiece_stage(spark, small):
    import sentencepiece

    from tesseral.llm.sentencepiece_codec import MODEL

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = small[:20] + [(10**6, None, None), (10**6 + 1, "", None), (None, "日本語" * 90, None), (None, "日本語" * 90, None)]
    out = corpus_pipeline.sentencepiece(spark, table(spark, rows), SMALL)
    assert out.columns == ["doc_id", "source", "ids", "n_tokens", "round_trip"]
    got = sorted((json.dumps([r.doc_id, r.ids, r.n_tokens]) for r in out.collect()))
    want = [(d, None if t is None else library.encode(t)) for d, t, _ in rows]
    assert got == sorted(json.dumps([d, x, len(x or [])]) for d, x in want)
    assert out.where("not round_trip").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_stages_on_nothing(spark, name, stage):
    out = stage(spark, table(spark, []), SMALL)
    assert out.count() == 0 and (out.columns == COLUMNS or "round_trip" in out.columns)


def test_run_leaves_its_result_only(spark):
    from tesseral.llm import common

    common.release(spark)
    out = corpus_pipeline.run(spark, SMALL)
    assert len(common._written) == 1 and len(common._written[0]) == 1 and out.count() > 0
