"""Chat formatting and SentencePiece: exact round trips, and parity with the library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesseral.llm.chat_format import CONTROLS, MARKS, RANKS, assemble, escape, format_chat, parse, read_back, render, reserved, tokenizer, unescape
from tesseral.llm.sentencepiece_codec import LONG_WORD, MARK, MODEL, Model, decode, encode, load

from .conftest import EDGES

_texts = st.lists(st.sampled_from([*CONTROLS, "\\", "a", " é", "🙂", "\n", "</tur", "### "]), max_size=12).map("".join)


@given(_texts)
def test_escaping_is_reversible(text):
    assert unescape(escape(text)) == text
    assert unescape(escape(escape(text))) == escape(text)


@given(_texts)
def test_escaped_text_has_no_bare_control(text):
    hidden = escape(text)
    for c in CONTROLS:
        at = hidden.find(c)
        while at >= 0:
            assert hidden[at - 1 : at] == "\\"
            at = hidden.find(c, at + 1)


@given(st.sampled_from(["user", "assistant", "</turn>", ""]), _texts)
@settings(max_examples=60)
def test_turns_read_back(role, text):
    ids, lo, hi, n = assemble(role, text, RANKS)
    assert parse(ids, RANKS) == [(role, text)] and len(render(ids, RANKS)) == n
    assert sum(int(x in reserved(RANKS)) for x in ids) == 3
    assert (hi > lo) == (role == "assistant" and text != "")
    assert render(ids, RANKS) == f"{MARKS[0]}{escape(role)}{MARKS[1]}{escape(text)}{MARKS[2]}"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "assistant", "x"), (1, 2, "assistant", ""), (1, None, "system", "s" * 50_000), (3, 0, "user", "t"), (3, 0, "user", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS n_chars")
    got = {r.conv_id: r for r in read_back(format_chat(table)).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest(("system", "s" * 50_000), ("user", "a"), ("assistant", "b </turn>"), ("assistant", ""))
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 9, hashlib.sha256(b"b </turn>").hexdigest())
    assert got[2].turns_sha256 == digest(("", "")) and got[2].loss_chars == 0 and got[None].loss_chars == 1 and got[3].n_turns == 2
    assert read_back(format_chat(table.limit(0))).count() == 0
    formatted = format_chat(table).where("conv_id = 1").orderBy("turn").collect()
    starts = [r.token_start for r in formatted]
    assert starts == [0, *np.cumsum([len(r.ids) for r in formatted])[:-1].tolist()]
    # the mask is of the conversation's sequence
    whole = np.concatenate([r.ids for r in formatted])
    learnt = [tokenizer(RANKS).decode_bytes(whole[r.loss_from : r.loss_to].tolist()).decode() for r in formatted if r.role == "assistant"]
    assert learnt == [escape("b </turn>"), ""]
    plan = read_back(format_chat(table))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") == 1


def test_a_conversation_with_a_gap_is_refused(spark):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="a stretch for place"):
        read_back(format_chat(table).where("turn = 1")).collect()


def texts():
    random.seed(3)
    made = ["".join(random.choice("abcdeilnorst  THE.,\n0123é日▁") for _ in range(random.randint(1, 90))) for _ in range(200)]
    return [t or "" for _, t in EDGES if t is None or len(t) < 30_000] + ["   ", "Hello  world\n\nfoo\tbar ", " lead", "tail  ", "ab" * 400, "日本語𠮷é\x00 x"] + made


def test_ids_are_the_librarys(corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = texts() + [t for _, t in corpus[:80]]
    mine = load(MODEL).encode(some)
    assert [x.tolist() for x in mine] == library.encode(some, num_threads=1)
    assert [load(MODEL).decode(x) for x in mine] == [t.replace(MARK, " ") for t in some]


def test_long_words_take_the_same_pass():
    """Texts without spaces, alone and beside others: cut where no piece can cross, and whole where they can't be cut."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = ["a" * 3000, "日本語テキスト" * 400, "x1y2" * 700, "ThequickbrownfoxJumpsOver" * 80, "".join(chr(97 + k * k % 26) for k in range(2500)), "the" * 33 + " " + "ing" * 40, "é" * 97, "z" * 97, "z" * 96]
    model = load(MODEL)
    assert max(len(p) for p in model.parts("▁" + "日本語テキスト" * 400)) < LONG_WORD
    assert model.parts("a" * 300) == ["a" * 300]
    assert [x.tolist() for x in model.encode(some)] == library.encode(some)
    model.forget()
    for t in some:
        assert model.encode([t])[0].tolist() == library.encode(t)


def test_neighbours_by_their_borders_are_neighbours_by_merging():
    """Pairs of pieces at random, and pairs that are the two parts of a piece, which BPE mostly merges."""
    model = load(MODEL)
    rng = np.random.default_rng(5)
    some = np.flatnonzero(model.whole & model.direct)
    number = {model.pieces[k]: k for k in some.tolist()}
    parts = [(number[p[:i]], number[p[i:]]) for p in list(number)[::9] for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
    a, b = np.concatenate([rng.choice(some, (4000, 2)), np.array(parts)]).T
    fits = model.apart(a, b)
    assert (fits == model.apart_by_merging(a, b)).all() and fits[:4000].mean() > 0.9 and not fits[4000:].any()
    assert (~model.direct).sum() < 30


def test_results_take_the_place_of_columns_with_their_names(spark):
    table = spark.createDataFrame([(1, "some text", 5, "x")], "doc_id long, text string, ids int, decoded string")
    out = encode(table, decoded="decoded")
    assert out.columns == ["doc_id", "ids", "decoded"] and out.first().decoded == "some text"
    assert decode(encode(table)).columns == ["doc_id", "ids", "decoded"] and decode(encode(table)).first().decoded == "some text"


def test_the_model_file_is_read_as_the_library_reads_it():
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), load(MODEL)
    assert model.pieces == [library.id_to_piece(k) for k in range(library.get_piece_size())]
    assert model.score.tolist() == [library.get_score(k) for k in range(library.get_piece_size())]
    assert model.bpe and sorted(model.bytes) == list(range(256)) and model.unknown == library.unk_id()


def test_columns(edges, nothing):
    back = decode(encode(edges))
    assert back.columns == [*[c for c in edges.columns if c != "text"], "ids", "decoded"]
    rows = back.collect()
    assert len(rows) == len(EDGES)
    assert sorted((r.decoded is None, r.decoded or "") for r in rows) == sorted((t is None, t or "") for _, t in EDGES)
    assert all((r.ids is None) == (r.decoded is None) for r in rows)
    assert decode(encode(nothing)).count() == 0
    once = encode(edges, decoded="decoded")
    assert once.columns == back.columns and sorted(map(str, once.collect())) == sorted(map(str, rows))


_pieces = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "ca", "aa", MARK, f"{MARK}a", f"{MARK}ab"]


@given(st.text("abcd ", max_size=12), st.lists(st.floats(-9, -0.1), min_size=11, max_size=11))
@settings(max_examples=80)
def test_unigram_viterbi_is_the_best_of_all_segmentations(text, scores):
    model = Model(_pieces, [0.0, *scores], {}, {0}, bpe=False)

    def best(word):
        table = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in _pieces[1:]:
                    table[end] = max(table[end], table[start] + scores[_pieces.index(word[start:end]) - 1])
            table[end] = max(table[end], table[end - 1] + model.worst) if word[end - 1] not in _pieces else table[end]
        return table[-1]

    ids = model.encode([text])[0]
    whole = (MARK + text.replace(" ", MARK)) if text else ""
    got = sum(model.worst if k == 0 else model.score[k] for k in ids.tolist())
    assert got == pytest.approx(sum(best(w) for w in model.cut.findall(whole)))
    assert "".join(whole) == "".join(_pieces[k] if k else "d" for k in ids.tolist()) if "d" in whole or 0 not in ids else True


def test_only_words_without_pieces_are_spelt(monkeypatch):
    """A character without a piece costs its own word, not those of the same length beside it."""
    model = load(MODEL)
    plain = [f"w{k:03d}" for k in range(500)]
    model.forget()
    alone = [x.tolist() for x in model.encode(plain)]
    model.forget()
    spelt = []
    own = type(model).spelling
    monkeypatch.setattr(type(model), "spelling", lambda self, ids: spelt.append(ids) or own(self, ids))
    beside = [x.tolist() for x in model.encode([*plain, "w\U0001f9ff01"])]
    model.forget()
    assert beside[:-1] == alone and model.decode(np.array(beside[-1])) == "w\U0001f9ff01"
    assert len(spelt) == 1
